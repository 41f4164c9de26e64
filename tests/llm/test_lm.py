"""Operator 10 against a plain context mixer."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import contextmix, lm, queries

SLOTS = ((18,) * 3, (18,) * 4)


def words(text):
    return [x.encode() for x in brute.WORD.findall(brute.low(text or ""))]


def kind_of(tokens):
    c = Counter(w for w in tokens if len(w) <= 3)
    return zlib.crc32(max((n, w) for w, n in c.items())[1]) % 256 if c else 0


def decisions(text, code):
    """(head or tail, bit, depth, the key of each predictor's counts) of a text's decisions."""
    tokens = words(text)
    kind, before, whole = kind_of(tokens), b"\n", b""
    for w in [*tokens, None]:
        coded = b"\n" if w is None else w + b" "
        for i, byte in enumerate(coded):
            p = coded[:i]
            word = (p[-8:], i)
            head = [(kind, p), (before + p)[-6:] + b"|%d" % i, (kind, whole, p)]
            contexts = head if i < 2 else [(kind, p[-2:]), p[-3:], word, (kind, word)]
            for d, bit in enumerate(code.words[byte]):
                yield int(i >= 2), int(bit), d, [(i >= 2, j, x, code.words[byte][:d]) for j, x in enumerate(contexts)]
        before, whole = coded, (w or b"")[-8:] + b"|%d" % len(w or b"")


def plain_bits(model, counts, text):
    total = 0.0
    for tail, bit, d, keys in decisions(text, model.mixers[0].code):
        m = model.mixers[tail]
        x, seen = [], []
        for k in keys:
            zeros, ones = counts.get(k, (0, 0))
            n = zeros + ones
            x.append(round(math.log((ones + 0.3) / (zeros + 0.3)) * 512) / 512 if n else 0.0)
            seen.append(0 if n == 0 else 1 + (n > 1) + (n > 3))
        gate = ((min(d, 7) * 4 + seen[-3]) * 4 + seen[-2]) * 4 + seen[-1]
        mix = m.weights[-1, gate] + sum(m.weights[j, gate] * v for j, v in enumerate(x))
        at = (min(max(mix, -7.999), 7.999) + 8) * 2
        low, part = int(at), at - int(at)
        p = (1 / (1 + math.exp(-mix)) + m.refined[d, low] * (1 - part) + m.refined[d, low + 1] * part) / 2
        p = min(max(p, 1e-6), 1 - 1e-6)
        total -= math.log2(p if bit else 1 - p)
    return total


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    some = ["the", "of", "river", "stone", "a", "Blue", "water", "under", "naïve", "internationalisation"]
    texts = {i: " ".join(r.choice(some) for _ in range(r.randint(1, 30))) for i in range(1, 40)} | {40: None, 41: "", 42: "x" * 3000, 43: "  A\n\tb ", 44: "unseen wörds", 45: "the river the river the"}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_scores_are_those_of_a_plain_mixer(table):
    texts, docs = table
    taught = lambda d: d % 7 != 2
    training = F.col("doc_id") % 7 != 2
    slots = ((23,) * 3, (23,) * 4)
    block = lm.stored(lm.blocks(docs, training))
    byte, kind = lm.frequencies(block)
    model = lm.train(block, contextmix.Code(byte), slots)
    assert kind.sum() == sum(map(taught, texts)) and byte.sum() == sum(sum(map(len, words(t))) + len(words(t)) + 1 for d, t in texts.items() if taught(d))
    counts = defaultdict(lambda: [0, 0])
    for d, t in texts.items():
        if taught(d):
            for _, bit, _, keys in decisions(t, model.mixers[0].code):
                for k in keys:
                    counts[k][bit] += 1
    kinds = Counter(kind_of(words(t)) for d, t in texts.items() if taught(d))
    exact = 0
    for r in lm.score(docs, training, slots=slots).collect():
        t = texts[r["doc_id"]]
        bits = plain_bits(model, counts, t) - math.log2((kinds[kind_of(words(t))] + 1) / (kinds.total() + 256))
        assert r["score"] == pytest.approx(-bits * math.log10(2), rel=2e-2), r["doc_id"]
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / r["n_bytes"])
        exact += r["score"] == pytest.approx(-bits * math.log10(2), rel=1e-4)
    assert exact >= 0.6 * len(texts)  # in the others two contexts share slots


def test_the_order_of_words_changes_the_score(spark, table):
    _, docs = table
    more = docs.unionByName(spark.createDataFrame([(100, "stone under the river of water"), (101, "water of river the under stone")], docs.schema))
    got = {r["doc_id"]: r["score"] for r in lm.score(more, F.col("doc_id") < 100, slots=SLOTS).collect()}
    assert abs(got[100] - got[101]) > 0.01


@pytest.mark.parametrize("prefix", [b"", b"a", b"ab", b"abc"])
def test_continuations_add_up_to_one(prefix):
    """The chances of all bytes that may come next, under one context."""
    taught = contextmix.Tally()
    for x in (b"ab abc b", b"ba ab", b"ab the ab"):
        taught.add(x.split())
    taught.close()
    code = contextmix.Code(np.bincount(np.frombuffer(b"ab abc b ba the", np.uint8), minlength=256))
    found = [contextmix.Learner(code, x) for x in SLOTS]
    for _ in range(3):
        contextmix.learn(found, taught, np.ones(3, bool))
    t = contextmix.Tally()
    every = [x for x in range(256) if x not in (10, 32)]
    for x in every:
        t.add([b"ab", prefix + bytes([x])])
    t.kinds = [7] * len(t.words)  # the class is given
    t.close()
    chance = 0.0
    for tail, (m, u) in enumerate(zip((x.mixer for x in found), contextmix.units(t), strict=True)):
        bits, at = m.bits(u), {}
        for i, owner in zip(u.of.tolist(), u.owner.tolist(), strict=True):
            at.setdefault(owner, []).append(i)
        if len(prefix) < 2 and not tail:
            for i in range(len(every)):
                chance += 2.0 ** -bits[at[int(t.which[3 * i + 1])][len(prefix)]]
        elif len(prefix) >= 2 and tail:
            for i in range(len(every)):
                chance += 2.0 ** -bits[at[int(t.at[3 * i + 1])][len(prefix) - 2]]
    assert 0.05 < chance < 1 + 1e-5  # the rest is the blank's and the line feed's


def test_a_token_costs_by_its_length_and_learning_pays(spark, table):
    texts, docs = table
    r = random.Random(2)
    junk = "".join(r.choice("QWXZ0123456789/+") for _ in range(20_000))
    more = docs.unionByName(spark.createDataFrame([(100, junk[:2000]), (101, junk)], docs.schema))
    got = {x["doc_id"]: x for x in lm.score(more, F.col("doc_id") < 100, slots=SLOTS).collect()}
    assert np.isfinite(got[101]["score"]) and got[101]["score"] < 5 * got[100]["score"] < 5 * -600


def test_two_megabytes_suffice_to_reach_the_base(spark):
    rows = queries.op10_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 1.01 * rows[1]


@pytest.fixture(scope="module")
def odd(spark):
    kind = "doc_id long, text string, score string, block long, n int"
    rows = [(1, "a b a", "s", 1, 1), (1, "a b a", "s", 1, 1), (None, "c", None, None, None), (2, None, "s", 1, 1), (9, "b the", "s", 1, 1), (5, "word " * 5000, None, 2, 2)]
    return rows, spark.createDataFrame(rows, kind)


def test_counts_and_base(odd):
    rows, docs = odd
    training = F.col("doc_id") % 7 != 2
    got = lm.score(docs, training, slots=SLOTS).collect()
    assert len(got) == len(rows)
    each = lambda t: [*words(t), b""]
    c = Counter(w for r in rows if r[0] is not None and r[0] % 7 != 2 for w in each(r[1]))
    n, v = sum(c.values()), len(c)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        w = each(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    assert lm.score(docs.limit(0), training, slots=SLOTS).count() == 0
    assert lm.score(docs, F.lit(False), slots=SLOTS).where("n_known > 0").count() == 0


def some_texts(n, sizes):
    r = random.Random(8)
    word = lambda: bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice(sizes)))
    return [[word() for _ in range(50)] + [b"the"] for _ in range(n)]


def test_memory_of_a_block_does_not_follow_its_bytes(monkeypatch):
    """Contexts are held for some bytes at once, so most of what a block takes is its tokens' numbers."""
    import tracemalloc

    monkeypatch.setattr(contextmix, "UNITS", 1 << 14, raising=False)
    taught = contextmix.Tally()
    for x in some_texts(400, [30, 40, 50]):
        taught.add(x)
    taught.close()
    found = [contextmix.Learner(contextmix.Code(np.ones(256, np.int64)), (8,) * len(x)) for x in SLOTS]
    tracemalloc.start()
    contextmix.learn(found, taught, np.ones(400, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(len(w) + 1 for w in taught.words)


def test_parts_of_a_block_score_as_the_whole(monkeypatch):
    t = contextmix.Tally()
    for x in [*some_texts(20, [1, 2, 3, 9]), [b"x" * 5000, b"a"], [], [b"x" * 5000]]:
        t.add(x)
    t.close()
    code = contextmix.Code(np.arange(256))
    found = [contextmix.Learner(code, x) for x in SLOTS]
    contextmix.learn(found, t, np.ones(len(t.sizes), bool))
    model = contextmix.Model(code, SLOTS)
    model.mixers = [x.mixer for x in found]
    heads, tails = (u.add_up(m.bits(u)) for u, m in zip(contextmix.units(t), model.mixers, strict=True))
    whole = np.add.reduceat(heads[t.which] + tails[t.at], np.cumsum(t.sizes) - t.sizes)
    for most in (7, 1000, 1 << 20):
        monkeypatch.setattr(contextmix, "UNITS", most)
        assert model.text_bits(t) == pytest.approx(whole)
        assert all(len(u.of) <= most for u in contextmix.some_tails(t, np.arange(len(t.kinds))))


def test_the_limit_of_batches_is_put_back(spark, table):
    _, docs = table
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    assert lm.score(docs, F.col("doc_id") % 7 != 2, slots=SLOTS).count() == 45 and spark.conf.get(name) == before
