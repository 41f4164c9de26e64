"""Operator 9: benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_bytes, stored

WINDOW = 13
#: Bytes of normalised benchmark text in one automaton; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 4 << 20

#: UTF-8 bytes to word bytes: A-Z lowered, other ASCII but digits and a-z is a blank, bytes of non-ASCII characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> list[bytes]:
    """The words of a text; the normalised text has one blank before, between and after them."""
    return text.translate(_TABLE).split()


def windows(words: list[bytes], n: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class Scanner:
    """An automaton over the windows of some items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        owners: dict[bytes, tuple[int, set[str]]] = {}
        for item, text in items:
            for w in windows(normalised(text)):
                owners.setdefault(w, (w.count(b" ") + 1, set()))[1].add("" if item is None else str(item))
        self.auto = ahocorasick.Automaton()
        for w, (n, who) in owners.items():
            self.auto.add_word(f" {w.decode('latin-1')} ", (n, tuple(sorted(who))))
        self.empty = not owners
        if owners:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The words hit, as maximal (first, end) runs, and the items found."""
        if self.empty or not words:
            return [], set()
        found = list(self.auto.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return [], set()
        blanks = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        ends = np.searchsorted(blanks, np.array([e for e, _ in found])) + 1
        firsts = ends - np.array([n for _, (n, _) in found])
        items = set().union(*{who for _, (_, who) in found})
        return _runs(list(zip(firsts.tolist(), ends.tolist(), strict=True))), items


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets in the original text of runs of words."""
    if not runs:
        return []
    is_word = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark's rows in blocks of some BLOCK_BYTES, by a hash of the text."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted strings), spans (byte offsets in the original text) and contaminated.

    The automaton of a block of the benchmark is bounded (BLOCK_BYTES, measured before it is collected); a larger
    benchmark is scanned block by block, each pass carrying the hits so far. Null texts and items have no words;
    items without words match nothing; repeated items are one; a null item_id is "". Result columns replace columns
    of the same names. Repeated rows are judged each.
    """
    out = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    kept = out.columns
    out = out.withColumns({"_runs": F.lit(None).cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")})
    blocks = _blocks(benchmark, item_col, item_text)
    for i, rows in enumerate(blocks):
        items = [(r["item"], (r["text"] or "").encode()) for r in rows.collect()]
        last = i == len(blocks) - 1
        out = _scan(out, docs.sparkSession.sparkContext.broadcast(items), kept, text_col, last)
        if not last:
            out = stored(out)
    return out


def _scan(docs: DataFrame, items, kept: list[str], text_col: str, last: bool) -> DataFrame:
    """One block's pass: adds to the runs and items so far; the last pass judges."""
    schema = docs.select(*kept, "items").schema
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    if last:
        schema = StructType([*schema, *StructType.fromDDL("n_words long, n_hit long, spans array<struct<start:int,end:int>>, contaminated boolean")])
    else:
        schema = StructType([*schema, *StructType.fromDDL("_runs array<struct<start:int,end:int>>")])
    names = schema.names

    def run(batches):
        scanner = Scanner(items.value)
        for batch in batches:
            texts = as_bytes(batch.column(text_col))
            found, runs, counts, hits, bad = [], [], [], [], []
            for text, old, had in zip(texts, batch.column("_runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = normalised(text)
                new, who = scanner.scan(words)
                new = _runs(new + [(r["start"], r["end"]) for r in old]) if old else new
                hit = sum(b - a for a, b in new)
                found.append(sorted({*had, *who}))
                counts.append(len(words))
                hits.append(hit)
                bad.append(hit > 0 and 20 * hit >= len(words))
                runs.append(offsets(text, new) if last else [{"start": a, "end": b} for a, b in new])
            out = [*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.string()))]
            if last:
                out += [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(runs, run_type), pa.array(bad, pa.bool_())]
            else:
                out.append(pa.array(runs, run_type))
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.mapInArrow(run, schema)


