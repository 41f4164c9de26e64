"""From raw documents to shards: five stages, each an operator of tabsight.llm applied to all its predecessor kept.

Only the columns that an operator reads stand beside a struct of all the others, so a column of the documents may have any
name. A stage's docstring says what becomes of nulls, empty and long texts, repeated rows; an empty table passes through all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import decontam, mixing, quality, sharding, simhash
from tabsight.llm.common import stored

SHARDS = 40
READ = ("doc_id", "text", "lang", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others in one."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in READ]
    return docs.select(*READ, *([F.struct(*rest).alias("_others")] if rest else []))


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, out of what ``_packed`` made of it."""
    return [F.col(c) if c in READ else F.col("_others")[c].alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects go: null, empty and short texts too. Repeated rows are judged each, texts of any length whole."""
    return quality.quality(_packed(docs)).where("kept").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the least doc_id, null
    last. Of rows that repeat id and text one stays; others with the same or no id are documents of their own."""
    return simhash.near_dedup(_packed(docs)).select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts stay, repeated rows are judged each."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(_packed(docs), benchmark).where("not contaminated").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands as often as it is taken, 0 to 2 times. Null sources are one, the last; rows that repeat an
    id are taken alike; a text without words has no size and is taken with its neighbours."""
    packed = _packed(docs)
    return mixing.repeated(mixing.mix(packed), packed.columns).select(*_columns(docs))


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with size, checksum, law, shard, slot and grown_shard, which take the place of columns so
    named. Every copy of a repeated document has its own slot; null ids are one key."""
    packed = _packed(docs)
    done = sharding.shard(packed, [1.0] * SHARDS, extra=[c for c in packed.columns if c != "doc_id"])
    kept = [c for name, c in zip(docs.columns, _columns(docs), strict=True) if name.lower() not in sharding.RESULT or name == "doc_id"]
    return done.select(*kept, *(c for c in sharding.RESULT if c != "doc_id"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: SimHash and the automaton have no SQL form; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
