"""Operator 2: token ids in files, ranked by frequency and coded in one to four bytes.

A file holds documents in ascending id order, one row each: their ids' ranks as little-endian bytes without leading
zeros (``data``) and, apart from them, two bits an id for the number of its bytes less one (``control``, four ids a
byte, low bits first). Files and rows are in order: ``file`` counts the files, ``first`` the ids before the row in its
file. A table ``ranks`` beside them names the id of each rank, ``sizes`` the ids in each file. Files are Parquet, so
any store that Spark reaches holds them, and a lost executor's rows are written anew.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ranges, stored

#: Ids in a file, about. Pieces of text whose ids a worker remembers, their characters on average, and of one at most.
IDS_PER_FILE, CACHE, CHARS, LONGEST = 1 << 24, 1_000_000, 16, 256

#: Number of bytes of each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.int32)

#: White space other than single blanks and line ends between other characters.
_ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\0")
_RARE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?= \S)")
#: The characters that stand for the 256 bytes in byte-level vocabularies.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


def pieces(text: str) -> list[str]:
    """The text cut before each blank that a non-blank follows, and around single line ends.

    A byte-level pre-tokenizer never makes a token across such a place, so ids of the pieces are ids of the text.
    """
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD) or (not text.isascii() and _RARE.search(text)):
        return [x for x in _CUT.split(text) if x]
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class Encoder(dict):
    """{piece: its ids as bytes} by the tokenizers library; remembers some CACHE to 2 CACHE pieces, fewer where they are
    longer than CHARS characters, and none over LONGEST.

    A piece that is one word, or a word and a full stop or comma, goes to the library's model at once, as its
    pre-tokenizer would hand it over; any other piece goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every piece is asked for once
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}
        self.chars = 0
        #: Two or four bytes an id, as the vocabulary needs.
        self.code, self.width = ("H", "<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        plain = json.loads(self.tokenizer.to_str())
        self.marks = {x: array(self.code, [t.id for t in self.tokenize(x)]).tobytes() for x in ".,"}
        self.direct = plain["normalizer"] is None and (plain["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not plain["pre_tokenizer"].get("add_prefix_space") and plain["model"]["type"] == "BPE"

    def __missing__(self, x: str) -> bytes:
        found = self.older.get(x)
        if found is None:
            core = x[:-1] if x[-1] in ".," and len(x) > 1 else x
            if self.direct and (core[1:] if core[0] == " " else core).isalpha():
                found = self.get(core) if core is not x else None
                if found is None:
                    spelled = core.replace(" ", "\u0120") if core.isascii() else core.encode().decode("latin-1").translate(_BYTES)
                    found = array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()
                if core is not x:
                    found += self.marks[x[-1]]
            else:
                found = array(self.code, self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        if len(x) <= LONGEST:
            self[x] = found
            self.chars += len(x)
        return found

    def ids(self, text: str, end: bytes) -> bytes:
        """All ids of a text and the ids in ``end``, as bytes of the encoder's width."""
        if len(self) > CACHE or self.chars > CHARS * CACHE:  # the pieces met since the last turn stay at hand
            self.older = dict(self)
            self.clear()
            self.chars = 0
        return b"".join(map(self.__getitem__, pieces(text))) + end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(flat: np.ndarray, n: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control, data) of each of len(n) sequences of ranks that follow each other in ``flat``."""
    flat = flat.astype("<u4")
    size = 1 + (flat > 0xFF).astype(np.uint8)
    if wide := int(flat.max(initial=0)) > 0xFFFF:
        size += (flat > 0xFFFF).view(np.uint8) + (flat > 0xFFFFFF).view(np.uint8)
    raw = flat.view(np.uint8).reshape(-1, 4) if wide else flat.astype("<u2").view(np.uint8).reshape(-1, 2)
    data = raw[np.arange(raw.shape[1], dtype=np.uint8) < size[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])].tolist()
    padded = -(-n // 4) * 4
    codes = np.zeros(int(padded.sum()), np.uint8)
    codes[ranges(np.cumsum(padded) - padded, n)] = size - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    edge = np.concatenate([[0], np.cumsum(padded // 4)]).tolist()
    return [(control[edge[i] : edge[i + 1]], data[at[i] : at[i + 1]]) for i in range(len(n))]


def decode(control: list[bytes], data: list[bytes], n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of sequences of n coded ranks each, one after the other, by lookups in LENGTHS and in the table of ids."""
    size = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    padded = -(-n // 4) * 4
    if not np.array_equal(padded, n):
        size = size[ranges(np.cumsum(padded) - padded, n)]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8).astype(np.uint32)
    rank = raw[start]
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        rank[more] |= raw[start[more] + k] << np.uint32(8 * k)
    return table[rank]


def _groups(batch: pa.RecordBatch, bytes_at_once: int = 4 << 20):
    """Slices of a batch of some MB of its second column, so that no step holds a whole batch of long texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // bytes_at_once
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])), strict=True):
        if hi > lo:
            yield batch.slice(int(lo), int(hi - lo))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text, ends each document with ``end_id`` and writes the files at ``path``.

    A null text is empty; null ids come first; rows that repeat an id follow each other. The texts are tokenized once:
    their ids are kept in the shared folder while all ids of the corpus are counted for the ranks.
    """
    spark = docs.sparkSession

    def ids_of(batches):
        gc.disable()  # the millions of short-lived tokens hold no cycles
        known = encoder(tokenizer)
        end = np.array([end_id], known.width).tobytes()
        size = np.dtype(known.width).itemsize
        for batch in batches:
            for part in _groups(batch):
                found = [known.ids(x or "", end) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // size for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "ids"])

    kind = "doc_id long, n long, ids binary"
    ids = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(ids_of, kind))

    def unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)]

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for part in _groups(batch):
                n = np.bincount(np.concatenate(unpack(part)), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    # One row for each id of the vocabulary at most.
    counts = ids.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    table = np.array([r["id"] for r in counts], np.int64)
    rank_of = np.zeros(int(table.max(initial=0)) + 1, np.uint32)
    rank_of[table] = np.arange(len(table))
    files = int(sum(r["n"] for r in counts) // IDS_PER_FILE) + 1
    cuts = ids.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)] or [0.5], 10000)).first()[0] or []
    edges = np.array(sorted(set(cuts)) if files > 1 else [], np.int64)
    files = len(edges) + 1
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(table)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def code(batches):
        for batch in batches:
            for part in _groups(batch.select(["doc_id", "ids", "n"])):
                coded = encode(rank_of[np.concatenate(unpack(part))], part.column("n").to_numpy())
                file = np.searchsorted(edges, part.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(file), part.column("doc_id"), part.column("n"), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], ["file", "doc_id", "n", "control", "data"])

    def place(batches):
        first = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield batch.append_column("first", pa.array(first + np.cumsum(n) - n))
            first += int(n.sum())

    columns = "file int, doc_id long, n long, control binary, data binary"
    # Range by range: rows of a file reach one task, which sorts them (spilling where it must) and numbers them.
    placed = ids.mapInArrow(code, columns).repartitionById(files, F.col("file")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "data").mapInArrow(place, f"{columns}, first long")
    placed.write.option("compression", "none").parquet(f"{path}/files")
    spark.read.parquet(f"{path}/files").groupBy("file").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/sizes")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files; ids are little-endian unsigned 32-bit, as binary."""
    table = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")  # one row an id of the vocabulary
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = spark.read.parquet(f"{path}/sizes").select("file", before.alias("base"))

    def ids_of(batches):
        for batch in batches:
            for part in _groups(batch.select(["n", "data", "control", "doc_id", "start"]), 1 << 20):
                n = part.column("n").to_numpy()
                raw = decode(part.column("control").to_pylist(), part.column("data").to_pylist(), n, table).tobytes()
                edge = (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n"), pa.array([raw[a:b] for a, b in pairwise(edge)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    rows = spark.read.parquet(f"{path}/files").join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n", "control", "data")  # bases: a row a file
    return rows.mapInArrow(ids_of, "doc_id long, start long, n_tokens long, ids binary")
