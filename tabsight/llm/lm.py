"""Operator 10: language-model scoring by logistic context mixing, beside an add-one unigram base.

The model is in ``contextmix``. Documents stand in blocks of bounded size, written once: a block's distinct tokens, not its
text, go through the shuffles. Tokens are counted exactly: each block's are dealt into buckets by their hash, so a frequent
token counts once a block, and a bucket's task sees its tokens alone. Each training task learns online from its blocks, all
their training texts; the tasks' counts are added up, and their weights and refinements are averaged by what each learned
from. A block's task then scores that block alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, ranges, stored
from .contextmix import CLASSES, SLOTS, Code, Learner, Model, Tally, binaries, bounds, cells, learn, refinement

#: Text bytes of a block; blocks that a training task takes where there are more than the cluster has cores.
BLOCK, BLOCKS_A_TASK = 12 << 20, 32
#: Bytes of rows that Spark hands a worker at once, about; a block more at most.
_AT_ONCE = 1 << 20
#: Counts that are added up together; weights are added up as whole numbers of 2**-_SHIFT, so that their order is of no matter.
_CUT, _SHIFT = 1 << 18, 20
_LOG10_2 = float(np.log10(2))
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_BLOCK = {"block": "long", "sizes": "array<int>", "bytes": "array<long>", "classes": "binary", "training": "binary", "at": "binary", "length": "long", "coded": "binary", "kinds": "binary", "counts": "binary"}
_TALLY = ("sizes", "classes", "at", "length", "coded", "kinds")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows of some MB to workers a few at a time, not 64 MB of them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True)


def _unzip(x: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _rows(batch: pa.RecordBatch, *names: str):
    """Some columns of each row, one row at a time: a row may be a block."""
    columns = [batch.column(k) for k in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def blocks(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in blocks: a Tally's (sizes, classes, at, coded, kinds) with the ids, bytes and training mark of each text,
    and how often each token occurs in training texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))

    def batch(number: int, t: Tally, ids: list, id_type: pa.DataType, taught: list[bool]) -> pa.RecordBatch:
        t.close(pairs=False)
        counts = np.bincount(t.at[np.repeat(taught, t.sizes)], minlength=len(t.kinds)).astype(np.uint32)
        values = [number, t.sizes, t.bytes, t.classes.tobytes(), bytes(taught), _zip(t.at.astype(np.uint32)), len(t.coded), _zip(t.coded), t.kinds.tobytes(), _zip(counts)]
        columns = [pa.array([v], _KINDS[kind]) for v, kind in zip(values, _BLOCK.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), *columns], ["ids", *_BLOCK])

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        t, ids, taught, held, id_type = Tally(), [], [], 0, None
        for found in batches:
            id_type = found.column(0).type
            for doc, text, mark in zip(found.column(0).to_pylist(), as_bytes(found.column(1)), found.column(2).to_pylist(), strict=True):
                t.add_text(text)
                ids.append(doc)
                taught.append(mark)
                held += len(text)
                if held >= BLOCK or len(ids) >= 100_000:
                    yield batch(task << 32 | number, t, ids, id_type, taught)
                    t, ids, taught, held, number = Tally(), [], [], 0, number + 1
        if ids:
            yield batch(task << 32 | number, t, ids, id_type, taught)

    kind = ", ".join(f"{k} {v}" for k, v in _BLOCK.items())
    return rows.mapInArrow(run, f"ids array<{dict(rows.dtypes)['doc_id']}>, {kind}")


def _tally(sizes: list[int], classes: bytes, at: bytes, length: int, coded: bytes, kinds: bytes) -> Tally:
    t = Tally()
    t.sizes, t.classes, t.kinds, t.coded = np.array(sizes, np.int64), np.frombuffer(classes, np.uint8), np.frombuffer(kinds, np.uint8), _unzip(coded, "u1", length)
    t.at = _unzip(at, "<u4", int(t.sizes.sum())).astype(np.int32)
    t.pair_up()
    return t


def _hashes(coded: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of whole tokens."""
    base = 0x9E3779B97F4A7C15
    power, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(coded), x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((coded.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    h = (sums[first + size] - sums[first]) * inverse[first]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def vocabulary(block: DataFrame) -> DataFrame:
    """A row a bucket: (bucket, n, types, totals, places). n, types: its tokens and different tokens in training texts;
    totals: occurrences of each; for each block (block, n, i, v): its tokens i are the bucket's v."""
    n_blocks = block.count()
    buckets = max(8, int(4 * n_blocks**0.75))

    def deal(batches):
        for batch in batches:
            for number, length, coded, kinds, counts in _rows(batch, "block", "length", "coded", "kinds", "counts"):
                coded, counts = _unzip(coded, "u1", length), _unzip(counts, "<u4", len(kinds))
                first, size = bounds(coded)
                bucket = (_hashes(coded, first, size) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                size = size[order]
                coded = coded[ranges(first[order], size)]
                at = np.concatenate([[0], np.cumsum(size)])[edge]
                found = [(b, edge[b], edge[b + 1], at[b], at[b + 1]) for b in range(buckets) if edge[b] < edge[b + 1]]
                values = [[f[0] for f in found], [number] * len(found), [coded[c:d].tobytes() for *_, c, d in found], [counts[order[i:j]].tobytes() for _, i, j, *_ in found], [_zip(order[i:j].astype(np.uint32)) for _, i, j, *_ in found]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, dealt, strict=True)], ["bucket", "block", "coded", "counts", "i"])

    dealt = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    out = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int32()), ("i", pa.binary()), ("v", pa.binary())]))]

    def merge(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for b, *row in _rows(batch, "bucket", "block", "coded", "counts", "i"):
                held.setdefault(b, []).append(tuple(row))
        for b in list(held):
            numbers, coded, counts, i = zip(*held.pop(b), strict=True)
            coded, n = np.frombuffer(b"".join(coded), np.uint8), [len(x) // 4 for x in counts]
            found = binaries(coded, bounds(coded)[1]).dictionary_encode()
            v = found.indices.to_numpy()
            c = np.bincount(v, np.frombuffer(b"".join(counts), "<u4"), len(found.dictionary)).astype(np.int64)
            places = [{"block": k, "n": len(x), "i": y, "v": _zip(x.astype(np.uint32))} for k, y, x in zip(numbers, i, np.split(v, np.cumsum(n)[:-1]), strict=True)]
            values = [b, int(c.sum()), int((c > 0).sum()), c.tobytes(), places]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, out, strict=True)], ["bucket", "n", "types", "totals", "places"])

    rows = block.select("block", "length", "coded", "kinds", "counts").mapInArrow(deal, "bucket int, block long, coded binary, counts binary, i binary")
    return rows.repartition("bucket").mapInArrow(merge, "bucket int, n long, types long, totals binary, places array<struct<block:long,n:int,i:binary,v:binary>>")


def frequencies(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte is coded in the training texts, and how many of them are of each class."""

    def run(batches):
        n = np.zeros(256 + CLASSES, np.int64)
        for batch in batches:
            for length, coded, kinds, counts, classes, taught in _rows(batch, "length", "coded", "kinds", "counts", "classes", "training"):
                coded, counts = _unzip(coded, "u1", length), _unzip(counts, "<u4", len(kinds))
                n[:256] += np.bincount(coded, np.repeat(counts, bounds(coded)[1]), 256).astype(np.int64)
                n[256:] += np.bincount(np.frombuffer(classes, np.uint8)[np.frombuffer(taught, bool)], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["at", "n"])

    n = np.zeros(256 + CLASSES, np.int64)
    for r in block.select("length", "coded", "kinds", "counts", "classes", "training").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a byte and class
        n[r["at"]] = r["n"]
    return n[:256], n[256:]


def train(block: DataFrame, code: Code, slots: tuple[tuple[int, ...], ...] = SLOTS) -> Model:
    """The model of all training texts. Reruns on the same files and cores agree; with other tasks the weights differ a little."""
    tasks = max(block.sparkSession.sparkContext.defaultParallelism, -(-block.count() // BLOCKS_A_TASK))
    widths = [2 * sum(1 << k for k in s) for s in slots]

    def learned(x: Learner) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (x.used, x.sums, x.hits)])

    def run(batches):
        found = [Learner(code, s) for s in slots]
        for batch in batches:
            for *tally, taught in _rows(batch, *_TALLY, "training"):
                if any(taught):
                    learn(found, _tally(*tally), np.frombuffer(taught, bool))
        for part, (x, width) in enumerate(zip(found, widths, strict=True)):
            rest = np.round(learned(x) * (1 << _SHIFT)).astype(np.int64)
            pieces = [(i, x.counts[i : i + _CUT].astype(np.int64)) for i in range(0, width, _CUT) if x.counts[i : i + _CUT].any()]
            for at, v in [*pieces, *((width + i, rest[i : i + 1024]) for i in range(0, len(rest), 1024))]:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(v)], pa.int64()), pa.array([_zip(v)], pa.binary())], ["part", "at", "n", "piece"])

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, at, n, piece in _rows(batch, "part", "at", "n", "piece"):
                x = _unzip(piece, "<i8", n)
                sums[part, at] = sums[part, at] + x if (part, at) in sums else x
        for (part, at), x in sums.items():
            x = cells(x) if at < widths[part] else x
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([_zip(x)], pa.binary())], ["part", "at", "n", "piece"])

    kind = "part int, at long, n long, piece binary"
    model = Model(code, slots)
    empty = [Learner(code, (4,) * len(s)) for s in slots]
    rest = [np.zeros(len(learned(x))) for x in empty]
    taught = block.select(*_TALLY, "training").coalesce(tasks).mapInArrow(run, kind)
    for r in taught.repartition("part", "at").mapInArrow(add, kind).toLocalIterator():  # tables of fixed size
        part, at, n = r["part"], r["at"], r["n"]
        if at < widths[part]:
            model.mixers[part].cells[at // 2 : at // 2 + n] = _unzip(r["piece"], "<i2", n)
        else:
            rest[part][at - widths[part] : at - widths[part] + n] = _unzip(r["piece"], "<i8", n) / (1 << _SHIFT)
    for m, x, found in zip(model.mixers, empty, rest, strict=True):
        shape = [x.used, x.sums, x.hits]
        used, sums, hits = (v.reshape(y.shape) for v, y in zip(np.split(found, np.cumsum([y.size for y in shape])[:-1]), shape, strict=True))
        m.weights = np.where(used > 0, sums / np.maximum(used, 1e-9), m.weights).astype(np.float32)
        m.refined = refinement(hits)
    return model


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", slots: tuple[tuple[int, ...], ...] = SLOTS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    training: a Column that says which rows are learned from; null is false. score is the model's log10 probability of
    the text; n_bytes counts the lower-cased tokens' bytes and a blank or end after each; bits_per_byte is -score in
    bits over n_bytes. A null text is empty: its end is its only token. A token of any length is priced byte by byte.
    Repeated rows are scored, and learned from, each. Without training rows every count is 0 and all predictors are at a loss;
    an empty table has no rows. A text's score counts its own contexts too if it is learned from.
    """
    with _small_batches(docs.sparkSession):
        block = stored(blocks(docs, training, id_col, text_col))
        byte, kind = frequencies(block)
        vocab = stored(vocabulary(block))
        total = vocab.agg(F.sum("n").alias("n"), F.sum("types").alias("types")).first()
        n_all, n_types = total["n"] or 0, total["types"] or 0
        model = docs.sparkSession.sparkContext.broadcast(train(block, Code(byte), slots))  # tables of fixed size
    class_bits = -np.log2((kind + 1) / (kind.sum() + CLASSES))
    whole = float(n_all + n_types + 1)

    def tell(batches):
        for batch in batches:
            for totals, places in _rows(batch, "totals", "places"):
                totals = np.frombuffer(totals, np.int64)
                found = [_zip(totals[_unzip(p["v"], "<u4", p["n"])]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([p["block"] for p in places], pa.int64()), pa.array([p["n"] for p in places], pa.int32()), pa.array([p["i"] for p in places], pa.binary()), pa.array(found, pa.binary())], ["of", "n", "i", "c"])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        c = np.zeros(sum(right.column("n").to_pylist()), np.int64)
        for i, n, found in zip(*(right.column(k).to_pylist() for k in ("i", "n", "c")), strict=True):
            c[_unzip(i, "<u4", n)] = _unzip(found, "<i8", n)
        base = np.log10((c + 1) / whole)
        ids, out = [], []
        for r in left.to_pylist():
            t = _tally(*(r[k] for k in _TALLY))
            first = np.cumsum(t.sizes) - t.sizes
            bits = model.value.text_bits(t) + class_bits[t.classes]
            ids += r["ids"]
            out.append((t.sizes, np.add.reduceat((c > 0).astype(np.int64)[t.at], first), np.add.reduceat(base[t.at], first), -bits * _LOG10_2, np.array(r["bytes"], np.int64)))
        size, known, b, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": pa.array(ids, left.schema.field("ids").type.value_type), "n_bytes": n, "n_tokens": size, "n_known": known, "train_tokens": np.full(len(n), n_all, np.int64), "base_score": b, "score": s, "bits_per_byte": -s / _LOG10_2 / n})

    told = vocab.select("totals", "places").mapInArrow(tell, "of long, n int, i binary, c binary")
    id_type = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    out = f"doc_id {id_type}, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    payload = block.select("block", "ids", "bytes", *_TALLY)
    return payload.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(add, out)
