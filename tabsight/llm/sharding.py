"""Operator 8: sharding by rendezvous hashing of stable keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash60, utf8

#: Cells a shard is numbered in.
CELLS = 512


#: The columns that ``shard`` gives.
RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: that of the largest score weight / -ln(u), u a hash of (key, shard) in (0, 1).

    A key's scores on the old shards do not change when a shard is added, so it stays or goes to the new one; a
    shard of twice the weight gets twice the keys. Only key and weights decide. Null is a key like any other.
    """

    def score(i: int, weight: float) -> Column:
        u = (hash60(key, f"{i}:").cast("double") + 0.5) / float(1 << 60)
        return F.struct((F.lit(float(weight)) / -F.ln(u)).alias("score"), F.lit(i).alias("shard"))

    return F.array_max(F.array(*(score(i, x) for i, x in enumerate(weights) if x > 0)))["shard"]


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *extra) of each row.

    weights: of the shards. grown: the weights with which grown_shard is worked out (one more shard of the mean
    weight unless given). slot numbers a shard's rows from 0 without gaps: rows are counted per (shard, cell of the
    key's hash), the cells' counts are added up over one small row a cell, and rows are numbered within their cell, so
    that no shard is gathered or sorted in one task. Rows with one key (repeated, or null) share a cell; their slots
    are dealt in the order of size and checksum. A null text has no bytes, one of any length counts whole. An empty table
    gives no rows. Other columns are not read; of ``extra`` those named like a result are left out.
    """
    extra = [c for c in extra or [] if c.lower() not in RESULT]
    grown = [*weights, sum(weights) / len(weights)] if grown is None else grown
    data = utf8(F.col(text_col).cast("string"))
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), grown).alias("grown_shard"),
        (hash60(F.col(id_col), "cell:") % CELLS).cast("int").alias("_cell"),
        *([F.struct(*extra).alias("_extra")] if extra else []),
    )
    counts = d.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    first = counts.select(F.col("shard").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy("shard", "_cell").orderBy("doc_id", "size", "text_crc32")) - 1
    out = d.withColumn("_within", within).join(first, (F.col("shard") == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_first") + F.col("_within")).alias("slot"), "grown_shard", *(F.col("_extra")[c].alias(c) for c in extra))


#: The query's rows. The checksum is worked out byte by byte: the polynomial's table comes from its rule.
ORACLE = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
b AS (SELECT doc_id, k, t, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d, t),
c AS (SELECT doc_id, k, len(b)::BIGINT + 16 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b),
s AS (SELECT c.*, i, 1.0::DOUBLE / -ln((('0x' || substr(md5(i || ':' || k), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976.0::DOUBLE) AS score FROM c, range(41) r(i)),
g AS (SELECT doc_id, k, size, text_crc32, arg_max(i, score) FILTER (i < 40)::INT AS shard, arg_max(i, score)::INT AS grown_shard, ('0x' || substr(md5('cell:' || k), 1, 15))::BIGINT % 512 AS cell FROM s GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM g
"""
