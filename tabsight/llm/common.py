"""Shared plumbing: UTF-8 helpers, ranges, spanning forests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components, forest, scratch, stored  # noqa: F401

#: A word of the contracts, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters.
SPACES = " \t\n\x0b\x0c\r"


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def whole(batches) -> pa.Table | None:
    """All rows of a task; None if it has none."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def hash60(value: Column, salt: str) -> Column:
    """A seeded hash in [0, 2**60) that DuckDB can compute too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(value.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """concatenate([arange(s, s + c) for s, c in zip(starts, counts)])."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a minimum spanning forest by weight d (Boruvka's rounds)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(d, kind="stable")
    x, y = at[: len(a)][order], at[len(a) :][order]
    part, live, chosen = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        px, py = part[x[live]], part[y[live]]
        apart = px != py
        live, px, py = live[apart], px[apart], py[apart]
        if not len(live):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, px, live)
        np.minimum.at(best, py, live)
        pick = np.unique(best[best < len(order)])
        chosen.append(pick)
        child, root = forest(part[x[pick]], part[y[pick]])
        into = np.arange(len(nodes))
        into[child] = root
        part = into[part]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
