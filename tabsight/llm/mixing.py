"""Operator 7: mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, hash60

#: Fixed values of the contract: weights in the order of the sources, share of all sizes, most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1)), " "), lambda w: w != "")).cast("long")


def water_fill(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target: min(EPOCHS * source_size, level * weight), the level such that the targets
    add up to SHARE of all sizes.

    That is the end of resharing the excess by weight until no target is above its cap: sources reach their caps in the
    order of cap / weight, so the level is found with running sums over one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (EPOCHS * F.col("source_size")).cast("double"))
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(SHARE)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    last = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(last * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and epochs (how often the mix takes the document: 0, 1 or 2).

    Each source is taken floor(target / source_size) times whole. The rest of its target is a seeded sample without
    replacement: its documents are ordered by a hash of their id, and those whose running size stays within the rest
    are taken once more. The running sums are built from sums per hash bucket, so that only the documents of the one
    bucket in which the rest runs out are ordered; no source is gathered in one task. Reruns agree.

    A null text has size 0. A null source is a source, the last. Rows that repeat an id share their hash and are
    taken or left together. Columns of ``docs`` named like a result are replaced.
    """
    d = docs.drop("size", "source_size", "target", "epochs").withColumns({"size": n_words(F.col(text_col).cast("string")), "_s": F.col(source_col).cast("string"), "_h": hash60(F.col(id_col), f"{seed}:")})
    d = d.withColumn("_b", (F.col("_h") % BUCKETS).cast("int"))
    cells = d.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    sources = water_fill(cells.groupBy(F.col("_s").alias("source")).agg(F.sum("_n").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = sources.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumnRenamed("source", "_source")
    run = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).join(sources, F.col("_s").eqNullSafe(F.col("_source"))).withColumnsRenamed({"_s": "_cs", "_b": "_cb"}).drop("_source")
    j = d.join(cells, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_b") == F.col("_cb")))
    # The document on which the rest runs out is taken if that brings the sum nearer.
    before, rest = F.col("_before"), F.col("_rest")
    edge = j.where((before < rest) & (before + F.col("_n") > rest)).groupBy("_cs", "_cb", "_h", "_before", "_rest").agg(F.sum("size").alias("_tie"))
    upto = F.sum("_tie").over(W.partitionBy("_cs", "_cb").orderBy("_h").rowsBetween(W.unboundedPreceding, 0)) + before
    edge = edge.withColumn("_upto", upto).where(F.col("_upto") - F.col("_tie") / 2.0 <= rest).groupBy("_cs", "_cb").agg(F.max("_h").alias("_last")).withColumnsRenamed({"_cs": "_es", "_cb": "_eb"})
    j = j.join(edge, F.col("_cs").eqNullSafe(F.col("_es")) & (F.col("_cb") == F.col("_eb")), "left")
    inside = (rest > 0) & ((before + F.col("_n") <= rest) | ((before < rest) & (F.col("_h") <= F.coalesce("_last", F.lit(-1)))))
    return j.withColumn("epochs", F.col("_whole") + inside.cast("int")).drop("_s", "_h", "_b", "_cs", "_cb", "_es", "_eb", "_n", "_before", "_whole", "_rest", "_last")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where(F.col("epochs") > 0).select(*columns, F.explode(F.sequence(F.lit(1), "epochs")).alias("_epoch")).drop("_epoch")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT s, source_size, [3, 1, 2][((row_number() OVER (ORDER BY s IS NULL, s) - 1) % 3 + 1)::INT] AS w, (2 * source_size)::DOUBLE AS cap FROM src),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, s IS NULL, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT s, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT s, h % 4096 AS b, h, sum(size)::BIGINT AS tie FROM d GROUP BY ALL),
c AS (SELECT g.s, b, h, tie, sum(tie) OVER (PARTITION BY g.s ORDER BY b, h) AS upto, sum(tie) OVER (PARTITION BY g.s ORDER BY b) AS bucket_upto,
             sum(tie) OVER (PARTITION BY g.s, b) AS n, target - whole * source_size AS rest
      FROM g JOIN r ON g.s IS NOT DISTINCT FROM r.s),
k AS (SELECT s, b, h, bucket_upto <= rest OR (bucket_upto - n < rest AND h <= coalesce(max(CASE WHEN upto - tie / 2.0 <= rest THEN h END) OVER (PARTITION BY s, b), -1)) AS inside FROM c)
SELECT d.doc_id, d.size, r.source_size, r.target, ((r.whole + CASE WHEN k.inside THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN r ON d.s IS NOT DISTINCT FROM r.s JOIN k ON d.s IS NOT DISTINCT FROM k.s AND d.h = k.h
"""
