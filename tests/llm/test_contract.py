"""The registered queries themselves, all their contract's columns, against plain versions on a small table."""

import random
import zlib

import brute
import brute_pipeline
import pytest

from tabsight.llm import queries

SF = "/root/testdata/sf0.001"


def _texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = say(40), say(80)
    near = base.split()
    near[70] = "changed"
    texts = [base, base, " ".join(near), "", None, " \n\t ", "One", passage + "\n" + say(20), say(20) + " " + passage.upper(), say(10) + passage, "x" * 400, "é€😀 ñ " * 40, say(4000), "ab " * 150, "a b\nb a\nc d e f g\nc d e f h\n\nC D E F G"]
    return {i * 7 + 3: t for i, t in enumerate(texts)}


TEXTS = _texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("contract")
    rows = [(d, t, ["en", "de", None][d % 3], ["a", None, "b"][d % 3], len(t or "")) for d, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _by_id(df):
    rows = df.collect()
    assert len(rows) == len(TEXTS) and {r["doc_id"] for r in rows} == set(TEXTS)
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, folder):
    want = brute.classes({d: brute.fingerprint(t) for d, t in TEXTS.items()})
    got = _by_id(queries.op1_simhash(spark, folder))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == want


def test_op2(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, got = 0, _by_id(queries.op2_token_ids(spark, folder))
    for d in sorted(TEXTS):
        ids = [*coder.encode(TEXTS[d] or "", add_special_tokens=False).ids, 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_op4(spark, folder):
    got = _by_id(queries.op4_suffix_dedup(spark, folder))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute.removed(TEXTS)


def test_op5(spark, folder):
    seen, got = [], _by_id(queries.op5_line_dedup(spark, folder))
    for d in sorted(TEXTS):
        gone = []
        for i, line in enumerate((TEXTS[d] or "").split("\n")):
            s = frozenset(brute.WORD.findall(brute.low(line)))
            if s and any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                gone.append(str(i))
            if s:
                seen.append(s)
        assert (got[d]["n_removed"], got[d]["removed_lines"]) == (len(gone), ",".join(gone)), d


def test_op6(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learned = {r["lang"] for d, r in rows.items() if r["lang"] is not None and not brute.held_out(d, 4)}
    right, asked = 0, 0
    for r in queries.op6_language_id(spark, SF).collect():
        assert r["held_out"] == brute.held_out(r["doc_id"], 4) and r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1
        text = rows[r["doc_id"]]["text"]
        if not any(x.isalpha() for x in text or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and rows[r["doc_id"]]["lang"]:
            asked += 1
            right += r["lang_pred"] == rows[r["doc_id"]]["lang"]
    assert asked > 20 and right >= 0.9 * asked


def test_op8(spark, folder):
    want = brute_pipeline.sharded([{"doc_id": d, "text": t} for d, t in TEXTS.items()])
    got = _by_id(queries.op8_sharding(spark, folder))
    for d, r in got.items():
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == want[d, TEXTS[d]] and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 40)
    for shard in {r["shard"] for r in got.values()}:
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_op10(spark, folder):
    got = _by_id(queries.op10_lm_scoring(spark, folder))
    for d, r in got.items():
        n = len(brute.WORD.findall(TEXTS[d] or "")) + 1
        assert (r["held_out"], r["n_tokens"]) == (brute.held_out(d, 7), n) and r["score"] < 0
