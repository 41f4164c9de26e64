"""Each operator against a plain version, on a table with nulls, empty and long texts, repeated rows, ties and clashing names."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import common, decontam, langid, lines, lm, mixing, quality, sharding, simhash, suffix, tokens

KIND = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size string, kept string, items string, spans string, _h int, target string, n_words string"


def _texts():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(120)
    near = base.split()
    near[50] = "changed"
    passage = say(40)
    out = [
        base, base, " ".join(near), "", None, "   \n\t ", "One", "one two three", "ABC abc\nABC abc\nabc ABC\n", "x" * 300, "ab " * 200, passage + " " + say(30), say(30) + "\n" + passage, "é€😀 ñ ü " * 20,
        say(3000), "a\0b " * 40, say(60) + "\n" + say(60), "#$% |<>& *** " * 30, passage.upper(), "\n".join([say(12)] * 3 + [say(12)]), "0", "thor " * 60, say(13), "don't stop.\n\nGo,  now", "<|endoftext|> a",
    ]
    return out, passage


TEXTS, PASSAGE = _texts()


@pytest.fixture(scope="module")
def rows():
    out = [(i + 1, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), i, "s", "k", "i", "p", 1, "t", "w") for i, t in enumerate(TEXTS)]
    return [*out, (None, "null id " + PASSAGE, None, None, None, None, None, None, None, None, None, None, None), out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_golay_anchors_are_those_within_the_radius():
    low, high, near, one, _ = simhash.golay()
    words = np.array([x ^ int(low[x & 4095] ^ high[x >> 12]) for x in range(0, 1 << 23, 1 << 11)])
    values = np.random.default_rng(1).integers(0, 1 << 23, 50)
    for t in (0, 1, 2):
        row, anchor, home = simhash.anchors(values, t)
        for i, v in enumerate(values):
            d = np.bitwise_count(words ^ v)
            assert sorted(anchor[row == i]) == list(np.flatnonzero(d <= 3 + t))
            assert list(anchor[(row == i) & home]) == [int(d.argmin())]


def test_simhash_groups(docs, empty, rows):
    fps = {r[0]: brute.fingerprint(r[1]) for r in rows}
    expected = brute.classes({k: v for k, v in fps.items() if k is not None})
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["node"] & (2**64 - 1) == fps[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]][1]
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("most", [1 << 15, 3])
def test_links_join_what_differs_in_four_bits(spark, most):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = {s for s in seeds}
    for s in seeds:
        for n in (1, 2, 3, 4, 5):
            x = s
            for b in r.sample(range(64), n):
                x ^= 1 << b
            fps.add(x)
    nodes = {i: f for i, f in enumerate(sorted(fps))}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f), f.to_bytes(8, "little")) for f in nodes.values()], "node long, fp binary")
    found = common.components(simhash.links(table, simhash.CONTRACT, most)).collect()
    got = defaultdict(set)
    for x in found:
        got[x["root"]].add(x["node"] & (2**64 - 1))
    want = defaultdict(set)
    for i, (_, root) in brute.classes(nodes).items():
        want[root].add(nodes[i])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("part", [simhash.PART_BYTES, 200])
def test_a_nearer_third_does_not_hide_a_near_pair(spark, part):
    r = random.Random(11)
    a = r.getrandbits(1536)
    b = a ^ sum(1 << i for i in range(0, 100, 10))
    c = a ^ sum(1 << i for i in range(0, 50, 10)) ^ sum(1 << i for i in range(600, 1200))  # nearer to both in 128 bits
    table = spark.createDataFrame([(i, x.to_bytes(192, "little")) for i, x in enumerate((a, b, c))], "node long, fp binary")
    got = common.components(simhash.links(table, simhash.SIMILAR)).collect()
    assert sorted((x["node"], x["root"]) for x in got) == [(0, 0), (1, 0)]
    members = table.withColumn("family", F.lit(0).cast("long"))
    assert [(x["a"], x["b"]) for x in simhash._judged(members.select("node", "family", "fp"), simhash.SIMILAR, part).collect()] in ([(0, 1)], [(1, 0)])


def test_near_dedup_goes_by_the_exact_similarity_of_shingle_sets(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    texts = []
    for changed in [0.05] * 10 + [0.02] * 10:  # families that share a passage of 0.7 and 0.85 of their shingles
        base = [word() for _ in range(400)]
        tail = int(400 * changed * 3.4)
        texts += [" ".join(base[: 400 - tail] + [word() for _ in range(tail)]) for _ in range(12)]
    texts += ["thor " * 300 + " ".join(word() for _ in range(30)) for _ in range(3)]  # one shingle outvotes the others
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    assert 120 < len(set(root)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in simhash.near_dedup(docs).collect()) == sorted(set(root))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_near_dedup_keeps_one_of_each_group(docs, empty):
    kept = simhash.near_dedup(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 not in ids and 15 in ids
    assert simhash.near_dedup(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_files_round_trip(spark, docs, empty, rows, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "IDS_PER_FILE", 2000)
    plain = Tokenizer.from_file(tokenizer)
    path = common.scratch(spark)
    tokens.write_tokens(docs, path, tokenizer, 0)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows) and [r["doc_id"] is not None for r in got][0] is False
    at, before = 0, None
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["start"] == at and r["n_tokens"] == len(ids)
        assert before is None or r["doc_id"] >= before
        at, before = at + len(ids), r["doc_id"]
    none = common.scratch(spark)
    tokens.write_tokens(empty, none, tokenizer, 0)
    assert tokens.read_tokens(spark, none).count() == 0


def test_pieces_do_not_change_ids(tokenizer):
    r, known = random.Random(5), tokens.encoder(tokenizer)
    for _ in range(3000):
        x = "".join(r.choice(["a", "b", " ", " ", ".", ",", "'s", "\n", "\t", "é", "1", "<|endoftext|>", " ", "\x1f"]) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(known.ids(x, b""), known.width).tolist() == known.tokenizer.encode(x, add_special_tokens=False).ids


def test_codes_of_one_to_four_bytes():
    ranks = [np.array([0, 255, 256, 65535, 65536, 1 << 24, 3]), np.zeros(0, np.int64), np.array([70000])]
    flat, n = np.concatenate(ranks), np.array([len(x) for x in ranks])
    table = np.arange((1 << 24) + 1, dtype=np.uint32)
    for part in (flat, flat % 60000):
        control, data = zip(*tokens.encode(part, n), strict=True)
        assert tokens.decode(control, data, n, table).tolist() == part.tolist()
        assert len(control[1]) == len(data[1]) == 0


def test_quality_measures(docs, empty, rows):
    texts = {r[0]: r[1] for r in rows}
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, rep, failed = brute.measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, rep, failed)
        assert not (failed and r["kept"]) and r["kept"] is not None
    assert quality.quality(empty).count() == 0


def test_quality_fences_follow_the_group(spark):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))
    plain = [(i, say(60), "en", "prose") for i in range(60)]
    code = [(100 + i, " ".join(f"{w} {{|" for w in say(40).split()), "en", "code") for i in range(60)]
    odd = [(200, " ".join(f"{w}$$$" for w in say(60).split()), "en", "prose")]
    kept = {x["doc_id"]: x["kept"] for x in quality.quality(spark.createDataFrame(plain + code + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i, *_ in plain + code) and not kept[200]


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(150):
        s = [r.randint(1, r.choice([2, 3, 20])) for _ in range(r.randint(1, 60))] + [0]
        assert suffix.suffix_array(np.array(s), 30).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_bytes(docs, empty, rows):
    got = suffix.repeats(docs.where("doc_id IS NOT NULL")).collect()
    expected = brute.removed({r[0]: r[1] for r in rows if r[0] is not None})
    assert len(got) == len(rows) - 1
    import hashlib

    for r in got:
        n = sum(x["end"] - x["start"] for x in r["spans"])
        assert (r["n_bytes"], n, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == expected[r["doc_id"]], r["doc_id"]
    assert suffix.repeats(empty).count() == 0
    assert suffix.repeats(docs).count() == len(rows)


def test_repeats_across_pieces_and_shards(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(suffix, "SHARD", 300)
    long = "".join(r.choice("abcd") for _ in range(5000))
    texts = {1: long, 2: long[1000:1800] + "z" * 150 + long[4000:4100], 3: long[3990:4089] + "y", 4: "ab" * 400, 5: long[:99]}
    for shard in (300, 2):
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = suffix.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        expected = brute.removed(texts)
        for x in got:
            assert (sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"])) == expected[x["doc_id"]][1:3], x["doc_id"]


def _removed_lines(texts):
    sets, out = [], {}
    for d in sorted(texts):
        out[d] = []
        for i, line in enumerate((texts[d] or "").split("\n")):
            s = frozenset(brute.WORD.findall(brute.low(line)))
            if len(s) >= 3:
                if any(5 * len(s & t) >= 4 * len(s | t) for t in sets):
                    out[d].append(i)
                sets.append(s)
    return out


@pytest.mark.parametrize("partners", [2, 1])
def test_line_dedup(spark, docs, empty, rows, partners, monkeypatch):
    monkeypatch.setattr(lines, "FIRST_PARTNERS", partners)
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    texts = {1000 + i: "\n".join(" ".join(r.sample(words, r.randint(2, 12))) for _ in range(6)) for i in range(30)}
    base = " ".join(words[:15])
    for i in range(20):
        texts[2000 + i] = " ".join(w if j != i % 15 else f"v{i}" for j, w in enumerate(base.split()))
    texts |= {x[0]: x[1] for x in rows if x[0] is not None}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = _removed_lines(texts)
    for x in lines.line_dedup(table).collect():
        assert x["removed"] == expected[x["doc_id"]], x["doc_id"]
        if texts[x["doc_id"]] is not None:
            kept = [t for i, t in enumerate(texts[x["doc_id"]].split("\n")) if i not in x["removed"]]
            assert x["text"] == "\n".join(kept) and x["n_lines"] == len(kept) + len(x["removed"])
    assert lines.line_dedup(empty).count() == 0
    assert lines.line_dedup(docs).count() == len(rows)


def test_language_identification(spark, docs, empty):
    r = random.Random(6)
    sounds = {"xx": "abcde", "yy": "vwxyz", "zz": "lmnop"}
    say = lambda k: " ".join("".join(r.choice(sounds[k]) for _ in range(r.randint(2, 6))) for _ in range(40))
    table = spark.createDataFrame([(i, say(k), k) for i, k in enumerate(list(sounds) * 40)], "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id % 4 <> 2"))
    held = {x["doc_id"]: x for x in langid.identify(table.where("doc_id % 4 = 2"), model).collect()}
    truth = {x["doc_id"]: x["lang"] for x in table.collect()}
    assert sum(v["lang_pred"] == truth[k] for k, v in held.items()) >= 0.95 * len(held)
    assert all(0 <= v["score"] <= 1 for v in held.values())
    odd = {x["doc_id"]: x for x in langid.identify(docs, model).collect()}
    assert odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[21]["lang_pred"] == "und" and odd[15]["lang_pred"] in sounds
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    model = langid.Model({"a": Counter({"abba": 3, "cab": 2, "b": 5})})
    bits, _ = model.word_bits(["abba", "cab", "b"])
    assert (bits > 0).all() and bits[2, 0] < bits[0, 0]


def test_mixing(docs, empty, rows, spark):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in mixed:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["epochs"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["epochs"] <= 2
    total = sum(sizes.values())
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(targets[s] <= 2 * sizes[s] for s in sizes)
    largest = max(r["size"] for r in mixed)
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    assert mixing.mix(empty).count() == 0
    again = {(r["doc_id"], r["epochs"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["epochs"]) for r in mixed}


def test_water_filling_is_resharing(spark):
    r = random.Random(8)
    for _ in range(5):
        sizes = {f"s{i}": r.randint(0, 1000) for i in range(7)}
        got = {x["source"]: x["target"] for x in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        target, open_ = {}, set(sizes)
        left = 1.5 * sum(sizes.values())
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
            if not full:
                target |= {s: level * weight[s] for s in open_}
                break
            for s in full:
                target[s] = 2.0 * sizes[s]
                left -= target[s]
            open_ -= full
        assert got == pytest.approx(target)


def test_sharding(docs, empty, rows):
    got = sharding.shard(docs, [1.0] * 40).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(empty, [1.0] * 40).count() == 0


def test_shards_get_their_weight(spark):
    ids = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in sharding.shard(ids, [1.0, 2.0, 0.0, 3.0]).collect())
    assert 2 not in n and abs(n[0] - 1000) < 150 and abs(n[1] - 2000) < 200 and abs(n[3] - 3000) < 200


ITEMS = {1: PASSAGE, 2: "One", 3: None, 4: " !! ", 5: "don't stop", 10: PASSAGE + " more words follow here", 6: PASSAGE}


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_contamination(spark, docs, empty, rows, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(list(ITEMS.items()) + [(1, PASSAGE)], "item_id long, text string")
    texts = {r[0]: r[1] for r in rows}
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, items, _, bad = brute.contamination(texts[r["doc_id"]], ITEMS)
        assert (r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"]) == (n, hit, items, bad), r["doc_id"]
        data = (texts[r["doc_id"]] or "").encode()
        assert sum(len(decontam.normalised(data[s["start"] : s["end"]])) for s in r["spans"]) == hit
        assert all(a["end"] < b["start"] for a, b in pairwise(r["spans"]))
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_lines_of_one_and_two_words_are_removed(spark, tmp_path):
    from tabsight.llm import queries

    r = random.Random(3)
    short = ["Read more", "more READ", "Share this", "share", "Share share", "this", "0", "", "  ", "read that"]
    texts = {i: "\n".join(r.choice([*short, f"line number {i} of its own", "one more line like others"]) for _ in range(8)) for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, expected = [], {}
    for d in sorted(texts):
        expected[d] = []
        for i, line in enumerate(texts[d].split("\n")):
            s = frozenset(brute.WORD.findall(brute.low(line)))
            if s and any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                expected[d].append(i)
            if s:
                seen.append(s)
    got = {x["doc_id"]: x["removed_lines"] for x in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: ",".join(map(str, v)) for d, v in expected.items()}


def test_fences_follow_a_group_of_long_words(spark):
    r = random.Random(8)
    line = lambda: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(r.randint(45, 75)))
    rows = [(i, "\n".join(line() for _ in range(14)), "zh", "web") for i in range(60)]
    rows.append((60, "\n".join(line() * 8 for _ in range(14)), "zh", "web"))
    got = {x["doc_id"]: x["kept"] for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(60)) >= 55 and not got[60]


def test_a_family_has_about_as_many_links_as_nodes(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    fps = simhash.stored(simhash.fingerprints(docs, simhash.SIMILAR).select("node", "fp"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = simhash.stored(simhash.candidates(fps, simhash.SIMILAR))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.count() < 5 * len(texts)
    assert common.components(found).groupBy("root").count().collect()[0]["count"] == len(texts)


def test_what_an_encoder_remembers(monkeypatch):
    import public_tokenizers

    known = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    known.tokenize = lambda x: asked.append(x) or []
    word = lambda i: " " + "".join("abcdefghij"[int(c)] for c in str(i))
    for _ in range(2):
        for lo in range(0, 850_000, 50_000):
            known.ids("".join(word(i) for i in range(lo, lo + 50_000)), b"")
    assert len(asked) == len(set(asked))  # no piece of 850,000 is tokenized twice

    monkeypatch.setattr(tokens, "CACHE", 100)
    known = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["ab" * 100 + "cdefghij"[i % 8] * i for i in range(200)] + ["ab" * 20_000]
    found = [known.ids(x, b"") for x in texts]
    assert sum(map(len, known)) + sum(map(len, known.older)) <= 2 * (100 * 16 + 256)
    assert found == [np.array(known.tokenizer.encode(x, add_special_tokens=False).ids, known.width).tobytes() for x in texts]


def test_lines_travel_packed(spark):
    r = random.Random(4)
    text = "\n".join(" ".join(str(r.randint(0, 10**6)) for _ in range(8)) for _ in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string").coalesce(1)
    rows = lines._documents(docs, "doc_id", "text")
    index = lines._index(rows, spark.sparkContext.broadcast(lines._rarity(rows)), 1)
    assert index.count() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # of some 7,500 prefix rows


def test_texts_split_in_parts_are_the_same(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("aB \n\t,") for _ in range(r.choice([0, 1, 5, 60]))).encode() for _ in range(300)]
    whole = lines.Splitter()(texts)
    for size in (1, 64, 1000):
        monkeypatch.setattr(lines, "_SPLIT", size)
        assert all((x == y).all() for x, y in zip(whole, lines.Splitter()(texts), strict=True))
