"""Approximate duplicates of person names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.graph import components, forest, stored
from ..functions.similarity import near_texts


def name_groups(df: DataFrame, column: str) -> DataFrame:
    """(key, n_values, n_rows): names that are the same but for case, accents, order and punctuation."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    keyed = values.withColumn("key", text.person_key(F.col("v"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n_values"), F.sum("c").alias("n_rows")).where("n_values > 1")


def _cells(df: DataFrame, column: str, most_in_block: int) -> DataFrame:
    """(block, low, high, part, v): the keys of names of eight characters and two words or more, once for each part of its
    block that a name's part meets."""
    values = df.where(F.col(column).isNotNull()).select(text.person_key(F.col(column)).alias("v")).distinct().where((F.length("v") >= 8) & F.contains("v", F.lit(" ")))
    block = values.withColumn("block", F.concat(F.substring("v", 1, 1), F.lit(":"), F.floor(F.length("v") / 4).cast("string")))
    size = block.groupBy("block").agg(F.count("*").alias("n"))
    block = block.join(size, "block").withColumn("ways", F.ceil(F.col("n") / most_in_block).cast("int")).withColumn("part", F.pmod(F.xxhash64("v"), F.col("ways")).cast("int"))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    cells = size.agg(F.sum(F.ceil(F.col("n") / most_in_block) * (F.ceil(F.col("n") / most_in_block) + 1) / 2)).first()[0] or 1  # a row
    tasks = min(1 << 15, max(4 * df.sparkSession.sparkContext.defaultParallelism, int(cells)))  # by work, not by bytes
    block = block.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "v")
    return block.repartition(tasks, "block", "low", "high")


def _near(rows: pa.Table, least: float) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(names, place, place, similarity) of the near pairs of a cell, each once."""
    rows = rows.sort_by("v")
    names = rows.column("v").cast(pa.binary()).to_pylist()
    part, low, high = (np.asarray(rows.column(k).combine_chunks()) for k in ("part", "low", "high"))
    a, b = np.flatnonzero(part == low), np.flatnonzero(part == high)
    plain = np.unique([v.translate(None, b"0123456789") for v in names], return_inverse=True)[1]
    same = len(low) > 0 and low[0] == high[0]
    for x, y, r in near_texts([names[i] for i in a.tolist()], [names[i] for i in b.tolist()], least):
        x, y = a[x], b[y]
        pick = plain[x] != plain[y]
        if same:
            pick &= x < y
        yield names, x[pick], y[pick], r[pick]


def similar_names(df: DataFrame, column: str, least: float = 92.0, most_in_block: int = 1 << 13) -> DataFrame:
    """(name_a, name_b, similarity): different names of eight characters and two words or more, alike to 92 of 100.

    Names meet in blocks (first character, length by fours), whatever their size; a block of over most_in_block names is
    dealt over a grid of tasks. Names that differ in digits only are not duplicates. A task walks its names down a trie
    of the others, so its work follows what is alike, not all pairs. Where many names are alike, their pairs are many: see
    ``name_classes``.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for names, x, y, r in _near(rows, least):
            x, y = np.minimum(x, y), np.maximum(x, y)  # places are in order of the names
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in k.tolist()], pa.binary()).cast(pa.string()) for k in (x, y)] + [pa.array(r, pa.float64())], ["name_a", "name_b", "similarity"])

    kind = "name_a string, name_b string, similarity double"
    empty = pa.schema([("name_a", pa.string()), ("name_b", pa.string()), ("similarity", pa.float64())])
    return _cells(df, column, most_in_block).groupBy("block", "low", "high").applyInArrow(lambda t: pa.Table.from_batches(pairs(t), empty), kind)


def name_classes(df: DataFrame, column: str, least: float = 92.0, most_in_block: int = 1 << 13) -> DataFrame:
    """(name, key, class, n_links): each different name, its key, the least key that links of ``similar_names`` reach from
    it, its own included, and the number of keys it is linked to. Names of one key are copies. Null names have no row.
    """

    def links(rows: pa.Table) -> pa.Table:
        n, names, a, b = np.zeros(rows.num_rows, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for names, x, y, _ in _near(rows, least):
            n += np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
        root = np.arange(len(n))
        root[a] = b
        at = np.flatnonzero(n)
        v = [pa.array([names[i] for i in k.tolist()], pa.binary()).cast(pa.string()) for k in (at, root[at])]
        return pa.table([*v, pa.array(n[at])], ["v", "to", "n"])

    found = stored(_cells(df, column, most_in_block).groupBy("block", "low", "high").applyInArrow(links, "v string, to string, n long"))
    roots = components(found.select(F.xxhash64("v").alias("a"), F.xxhash64("to").alias("b")))
    each = found.groupBy("v").agg(F.sum("n").alias("n_links")).join(roots, F.xxhash64("v") == F.col("node"))
    classes = each.join(each.groupBy("root").agg(F.min("v").alias("class")), "root").select(F.col("v").alias("key"), "class", "n_links")
    names = df.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().withColumn("key", text.person_key(F.col("name")))
    return names.join(classes, "key", "left").select("name", "key", F.coalesce("class", "key").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
