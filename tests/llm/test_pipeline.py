"""The pipeline's stages, each on all its predecessor kept."""

from collections import Counter

import brute
import brute_pipeline
import corpus_pipeline
import pytest

from tabsight.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert set(after) <= set(before)
        if name != "sharding":
            assert docs.columns == names
        if name == "quality rules":
            failed = {d for d, r in before.items() if brute.measures(r["text"])[-1]}
            assert not failed & set(after)
            good = [d for d, q in labels.items() if q == 1 and d in before and d not in failed]
            assert sum(d in after for d in good) >= 0.97 * len(good)
        elif name == "simhash near-dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(before[d]["text"], d)
            assert not {d for d in before if first[before[d]["text"]] != d} & set(after)
        elif name == "benchmark decontamination":
            assert set(after) == {d for d, r in before.items() if not brute.contamination(r["text"], items)[-1]}
        elif name == "mixing":
            assert max(sum(r["doc_id"] == d for r in rows) for d in list(after)[:50]) <= 2
        else:
            assert {(r["shard"], r["slot"]) for r in rows}.__len__() == len(rows)
        before = after


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_run_is_what_a_plain_version_gives(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = brute_pipeline.run(docs, items)
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(want) > 50
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got) == Counter((d["doc_id"], d["text"], d["n_chars"]) for d in want)
    where = brute_pipeline.sharded(want)
    for r in got:
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == where[r["doc_id"], r["text"]]
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


@pytest.fixture(scope="module")
def odd(spark):
    say = lambda s, n: " ".join(f"{s}{i * i % 97}word" for i in range(n))
    clash = "n_lines long, n_words string, size string, items string, law string, slot string, _fence0 string, kept string, node long, cell string, epochs string"
    more = (7, "w", "s", "i", "l", "t", "f", "k", 3, "c", "e")
    rows = [
        (1, say("a", 40), "en", "x"), (1, say("a", 40), "en", "x"), (2, None, "en", "x"), (3, "", None, None), (None, say("b", 40), None, "y"), (None, say("c", 40), "en", None),
        (4, say("d", 60_000), "en", "x"), (5, say("e", 50), "en", "x"), (5, say("f", 50), "en", "x"), (6, say("f", 50), "de", "y"),
    ]
    return spark.createDataFrame([r + more for r in rows], f"doc_id long, text string, lang string, source string, {clash}")


def test_stages_with_odd_rows_and_clashing_names(spark, odd):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, odd, SF))
        rows = out.collect()
        if i < 4:
            assert out.columns == odd.columns
            assert all((r["n_words"], r["size"], r["items"], r["kept"], r["n_lines"]) == ("w", "s", "i", "k", 7) for r in rows)
        else:
            assert sorted(out.columns) == sorted({*odd.columns, "text_crc32", "shard", "grown_shard"}) and len(rows) == 10
            assert all(isinstance(r["size"], int) and r["law"] == "key" for r in rows)
        if name == "quality rules":
            assert all(r["text"] for r in rows)
        if name == "simhash near-dedup":  # texts decide: neither null ids nor a shared id makes copies
            assert Counter(r["doc_id"] for r in rows) == Counter({None: 2, 1: 1, 2: 1, 4: 1, 5: 2})
        if name == "benchmark decontamination":
            assert len(rows) == 10
        assert out.count() > 0
