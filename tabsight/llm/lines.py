"""Operator 5: removal of near-repeated lines by an exact set-similarity join.

A line is the set of its words (A-Z lowered). A line goes if an earlier line - of a smaller doc_id, or before it in the
same document - has a Jaccard similarity of at least THRESHOLD. Lines are judged on the input, so a removed line still
removes others.

Equal sets are settled by a hash of the set; sets of one or two words can only match equal ones, so their rows meet by
that hash and nothing else. For the others: words are ordered by rarity, and a set's prefix, its
|x| - ceil(t |x|) + 1 rarest words, must share a word with the prefix of any set similar to it. Rows meet by prefix word;
pairs pass a length filter, a positional filter (the words after the shared one bound the overlap) and a bitmap filter
(the words' parities in 128 bits bound the difference), and the rest is verified on the sets themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, stored

#: Similarity; fewest different words of a line that can be removed where nothing else is asked for; partners of a line
#: that are verified at first.
THRESHOLD, MIN_WORDS, FIRST_PARTNERS = (4, 5), 3, 2
#: Bits (log2) of the filter of words that the second comparison asks for.
FILTER = 25
#: Counters of the rarity sketch (log2).
SKETCH = 20
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 2 << 20
#: Bytes of texts that are split at once: what is worked out for them stays in a core's cache.
_SPLIT = 1 << 19
_FIRST = np.iinfo(np.int64).min
#: The place of a row that is settled already.
NONE = 0xFFFFFFFF
PAIR = ["doc", "tie", "line", "doc2", "tie2", "line2", "more"]

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Splitter:
    """Words of texts as 64-bit hashes, many texts at once."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, line within its text) of each word."""
        found, lo, size = [], 0, 0
        for i, x in enumerate(texts):
            size += len(x) + 1
            if size >= _SPLIT or i == len(texts) - 1:
                h, text, line = self.some(texts[lo : i + 1])
                found.append((h, text + lo, line))
                lo, size = i + 1, 0
        return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found, strict=True)))

    def some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = _LOW[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        if len(self.power) <= len(raw):
            self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw) * 5 // 4 + 16, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        blank = _BLANK[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], dtype=np.uint64)])
        h = _mix((sums[end] - sums[start]) * self.inverse[start])
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(start, first), len(start))))
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        return h, text, breaks[start] - breaks[first][text]


def _chunks(batch: pa.RecordBatch, column: int):
    """Slices of some MB of text."""
    held, size, start = [], 0, 0
    for i, x in enumerate(batch.column(column).to_pylist()):
        held.append(x or b"")
        size += len(x or b"") + 1
        if size >= _CHUNK:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


#: What a prefix row carries beside its word.
ROW = np.dtype([("key", "<u8"), ("a", "<u8"), ("b", "<u4"), ("size", "<u4"), ("place", "<u4"), ("tie", "<u4"), ("line", "<u4"), ("doc", "<i8")])
#: The same with its word, as rows travel.
WITH_WORD = np.dtype([("word", "<i4"), *ROW.descr])
INDEX = "part int, asked boolean, rows binary"


def _sets(h: np.ndarray, text: np.ndarray, line: np.ndarray, rare: np.ndarray):
    """The different words of each line, rarest first: (hash, set, (text, line) of each set).

    Words are ordered by the logarithm of their frequency, then by hash; the order is the same in every line.
    """
    if not len(h):
        return h, text, text, line
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])])
    of = np.cumsum(new) - 1
    rank = rare[(h >> np.uint64(64 - SKETCH)).astype(np.int64)]
    packed = of.astype(np.uint64) << np.uint64(38) | rank.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
    order = np.argsort(packed)
    w, p = h[order], packed[order]
    if ((p[1:] == p[:-1]) & (w[1:] != w[:-1])).any():  # two words of a line that share 32 bits of their hashes
        order = np.lexsort((h, packed))
        w, p = h[order], packed[order]
    keep = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
    return w[keep], of[order][keep], text[new], line[new]


def _signatures(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: its hash, and the parities of its words in 96 bits."""
    if not n:
        return (np.zeros(0, np.uint64),) * 3
    first = np.searchsorted(of, np.arange(n))
    key = _mix(np.add.reduceat(_mix(h + np.uint64(77)), first))
    at = (h & np.uint64(0xFFFFFFFF)) * np.uint64(96) >> np.uint64(32)
    bit = np.uint64(1) << (at & np.uint64(63))
    low = at < 64
    zero = np.uint64(0)
    return key, np.bitwise_xor.reduceat(np.where(low, bit, zero), first), np.bitwise_xor.reduceat(np.where(low, zero, bit), first)


def _rarity(rows: DataFrame) -> np.ndarray:
    """A sketch of the words' frequencies over all lines: 2**SKETCH counters, partial ones added up in pieces."""
    cut = 1 << 16

    def partial(batches):
        total, split = np.zeros(1 << SKETCH, np.int64), Splitter()
        for batch in batches:
            for _, texts in _chunks(batch, 0):
                total += np.bincount((split(texts)[0] >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
        at = [i for i in range(0, 1 << SKETCH, cut) if total[i : i + cut].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(total[i : i + cut].tobytes(), 1) for i in at], pa.binary())], ["at", "piece"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(zlib.decompress(piece), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["at", "piece"])

    out = np.zeros(1 << SKETCH, np.int64)
    for r in rows.select("data").mapInArrow(partial, "at long, piece binary").repartition("at").mapInArrow(add, "at long, piece binary").collect():  # one table
        out[r["at"] : r["at"] + cut] = np.frombuffer(zlib.decompress(r["piece"]), np.int64)
    return np.minimum(np.log2(out + 1.0), 63).astype(np.uint8)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    repeated = docs.groupBy(key.alias("k")).count().where("count > 1").limit(1).count() > 0
    return docs.select(key.alias("doc"), (F.crc32(data) if repeated else F.lit(0)).cast("long").alias("tie"), data.alias("data"))


def _prefix_rows(doc: np.ndarray, tie: np.ndarray, line: np.ndarray, h: np.ndarray, of: np.ndarray, size: np.ndarray, taken) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word that each prefix row meets others by, the prefix rows, a row for each set) of sets (h, of); taken: which sets, by their rows."""
    num, den = THRESHOLD
    n = len(size)
    key, a, b = _signatures(h, of, n)
    row = np.empty(n, ROW)
    for name, values in (("key", key), ("a", a), ("b", b), ("size", size), ("place", NONE), ("tie", tie), ("line", line), ("doc", doc)):
        row[name] = values
    prefix = np.where(taken(row), size - -(-size * num // den) + 1, 0)
    out = np.repeat(row, prefix)
    meet = np.where(out["size"] <= 2, out["key"], h[ranges(np.cumsum(size) - size, prefix)])
    out["place"] = ranges(np.zeros(n, np.int64), prefix)
    return (meet >> np.uint64(20)).astype(np.uint32).view(np.int32), out, row


def _index(rows: DataFrame, counts, min_words: int, keep=None) -> DataFrame:
    """(INDEX): the prefix rows (ROW) of each set's first line in a chunk of a task, a chunk's rows for one of all parts
    together; lines that repeat an earlier one of the chunk are settled: one row each under any word, its place NONE.

    keep: a filter of words (``_filter``); then only prefix rows under those, and none of settled lines.
    """

    parts = _parts(rows)

    def run(batches):
        split, rare = Splitter(), counts.value
        for batch in batches:
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, texts in _chunks(batch, 2):
                h, of, text, line = _sets(*split(texts), rare)
                n = len(text)
                size = np.bincount(of, minlength=n)
                first = np.zeros(n, bool)

                def taken(row, first=first, size=size):
                    order = np.lexsort((row["line"], row["tie"], row["doc"], row["key"]))
                    key = row["key"][order]
                    first[order] = np.concatenate([[True], key[1:] != key[:-1]]) if len(row) else True
                    return first & (size >= min_words)

                word, out, row = _prefix_rows(doc[start + text] if n else 0, tie[start + text] if n else 0, line, h, of, size, taken)
                if keep is None:
                    settled = row[~first & (size >= min_words)]
                    # Dealt by place: rows of any number of copies spread over all tasks.
                    word = np.concatenate([word, ((settled["doc"].astype(np.uint32) * np.uint32(2654435761)) ^ settled["line"]).view(np.int32)])
                    out = np.concatenate([out, settled])
                else:
                    wanted = _in_filter(keep.value, word)
                    word, out = word[wanted], out[wanted]
                for lo in range(0, len(out), 400_000):
                    yield _index_batch(word[lo : lo + 400_000], out[lo : lo + 400_000], False, parts)

    return rows.mapInArrow(run, INDEX)


def _plain(full: np.ndarray) -> np.ndarray:
    out = np.empty(len(full), ROW)
    for name in ROW.names:
        out[name] = full[name]
    return out


def _parts(rows: DataFrame) -> int:
    """Tasks that index rows are dealt over by their words."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _index_batch(word: np.ndarray, rows: np.ndarray, asked: bool, parts: int) -> pa.RecordBatch:
    part = (word.view(np.uint32) * np.uint32(2654435761) >> np.uint32(4)) % np.uint32(parts)
    order = np.argsort(part, kind="stable")
    full = np.empty(len(rows), WITH_WORD)
    full["word"] = word[order]
    rows = rows[order]
    for name in ROW.names:
        full[name] = rows[name]
    known, edge = np.unique(part[order], return_index=True)
    edge = (np.append(edge, len(rows)) * WITH_WORD.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(edge), pa.py_buffer(full.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(np.full(len(known), asked)), packed], ["part", "asked", "rows"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows (WITH_WORD) of a column of packed rows, and how many each holds."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(WITH_WORD), np.diff(offsets) // WITH_WORD.itemsize


def _asked(sets: DataFrame, counts) -> DataFrame:
    """Index rows, marked as asked, of lines given by their sets (doc, tie, line, words)."""

    parts = _parts(sets)

    def run(batches):
        for batch in batches:
            doc, tie, line = (batch.column(i).to_numpy() for i in range(3))
            words = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            if not words:
                continue
            n = np.fromiter(map(len, words), np.int64, len(words))
            h, of, at, _ = _sets(np.concatenate(words), np.repeat(np.arange(len(words)), n), np.zeros(int(n.sum()), np.int64), counts.value)
            word, out, _ = _prefix_rows(doc[at], tie[at], line[at], h, of, np.bincount(of, minlength=len(at)), lambda row: np.ones(len(row), bool))
            yield _index_batch(word, out, True, parts)

    return sets.mapInArrow(run, INDEX)


def _at_bit(word: np.ndarray) -> np.ndarray:
    return (word.view(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - FILTER)


def _in_filter(bits: np.ndarray, word: np.ndarray) -> np.ndarray:
    at = _at_bit(word)
    return (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)


def _filter(index: DataFrame) -> np.ndarray:
    """A bit for each word of an index, by hash: a filter of fixed size, put together in pieces."""
    cut = 1 << 16

    def partial(batches):
        bits = np.zeros(1 << FILTER, bool)
        for batch in batches:
            if batch.num_rows:
                bits[_at_bit(_unpacked(batch.column(0))[0]["word"].copy())] = True
        bits = np.packbits(bits, bitorder="little")
        at = [i for i in range(0, len(bits), cut) if bits[i : i + cut].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(bits[i : i + cut].tobytes(), 1) for i in at], pa.binary())], ["at", "piece"])

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[at] = found.get(at, 0) | np.frombuffer(zlib.decompress(piece), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in found.values()], pa.binary())], ["at", "piece"])

    out = np.zeros((1 << FILTER) // 8, np.uint8)
    for r in index.select("rows").mapInArrow(partial, "at long, piece binary").repartition("at").mapInArrow(add, "at long, piece binary").collect():  # one filter
        out[r["at"] : r["at"] + cut] = np.frombuffer(zlib.decompress(r["piece"]), np.uint8)
    return out


def _pairs(index: DataFrame, most: int | None, first: bool = True) -> DataFrame:
    """(doc, tie, line, doc2, tie2, line2, more): a set's first line and an earlier line of another set that may be
    similar; or, with doc2 null, a line whose set an earlier line has.

    Of a line's partners under one word the ``most`` nearest by bitmap are returned; more says that there were others.
    Unless ``first``, partners are found for the rows marked as asked only, and no equal sets are returned.
    """
    num, den = THRESHOLD

    def run(batches):
        words, rows, marks = [], [], []
        for batch in batches:
            if batch.num_rows:
                full, n = _unpacked(batch.column(2))
                rows.append(_plain(full))
                words.append(full["word"].copy())
                marks.append(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), n))
        if not rows:
            return
        word, row, mark = np.concatenate(words), np.concatenate(rows), np.concatenate(marks)
        del words, rows, marks
        word_asked, row_asked = word[mark], row[mark]
        word, row = word[~mark], row[~mark]
        settled = row["place"] == NONE
        if first and settled.any():
            yield _gone(row[settled])
        word, row = word[~settled], row[~settled]
        order = np.argsort(word, kind="stable")
        w = word[order]
        alone = np.concatenate([[True], w[1:] != w[:-1]]) & np.concatenate([w[1:] != w[:-1], [True]]) if len(w) else np.zeros(0, bool)
        order = order[~alone]  # most words stand in one prefix only
        word, row = word[order], row[order]
        order = np.lexsort((row["line"], row["tie"], row["doc"], row["key"], word))
        word, row = word[order], row[order]
        if not len(row):
            return
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (row["key"][1:] == row["key"][:-1])])
        if first:
            # Equal sets have equal prefixes: those under the first word are all of them.
            lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
            other = (row["doc"] != row["doc"][lead]) | (row["tie"] != row["tie"][lead]) | (row["line"] != row["line"][lead])
            yield _gone(row[same & other & (row["place"] == 0)])
        word, row = word[~same], row[~same]
        order = np.lexsort((row["line"], row["tie"], row["doc"], word))
        word, row = word[order], row[order]
        start = np.searchsorted(word, word)
        if first:
            asked = np.arange(len(row))
        else:  # an asked row's twin stands right before it
            both, twice = np.concatenate([row, row_asked]), np.concatenate([word, word_asked])
            order = np.lexsort((np.arange(len(both)) >= len(row), both["line"], both["tie"], both["doc"], twice))
            before = order[np.flatnonzero(order >= len(row)) - 1]
            alike = (before < len(row)) & (before >= 0)
            mine = order[np.flatnonzero(order >= len(row))]
            alike &= (twice[before] == twice[mine]) & (both["doc"][before] == both["doc"][mine]) & (both["tie"][before] == both["tie"][mine]) & (both["line"][before] == both["line"][mine])
            asked = np.sort(before[alike])
        count = asked - start[asked]  # all earlier rows of the word
        total = np.concatenate([[0], np.cumsum(count)])
        size, place, a, b = (row[k].astype(t) for k, t in (("size", np.int32), ("place", np.int32), ("a", np.uint64), ("b", np.uint32)))
        lo = 0
        while lo < len(asked):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 500_000, "right")) - 1)
            x = np.repeat(asked[lo:hi], count[lo:hi])
            y = ranges(start[asked[lo:hi]], count[lo:hi])
            lo = hi
            ok = den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y])
            x, y = x[ok], y[ok]
            both = size[x] + size[y]
            least = -(-both * num // (num + den))  # words that two such sets must share
            # Under the first word that two sets share nothing before it is shared, so that is where a similar pair passes.
            ok = np.minimum(size[x] - place[x], size[y] - place[y]) >= least
            x, y, both, least = x[ok], y[ok], both[ok], least[ok]
            differ = np.bitwise_count(a[x] ^ a[y]).astype(np.int32) + np.bitwise_count(b[x] ^ b[y])
            ok = differ <= both - 2 * least
            x, y, differ = x[ok], y[ok], differ[ok]
            if not len(x):
                continue
            more = np.bincount(x, minlength=len(row))[x] > (most or len(x))
            if most:  # the likeliest partners
                order = np.lexsort((y, differ, x))
                x, y, more = x[order], y[order], more[order]
                rank = np.arange(len(x)) - np.searchsorted(x, x)
                x, y, more = x[rank < most], y[rank < most], more[rank < most]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (row["doc"][x], row["tie"][x].astype(np.int64), row["line"][x].astype(np.int32), row["doc"][y], row["tie"][y].astype(np.int64), row["line"][y].astype(np.int32), more)], PAIR)

    rows = index.repartitionById(_parts(index), F.col("part")).mapInArrow(run, "doc long, tie long, line int, doc2 long, tie2 long, line2 int, more boolean")
    return rows.groupBy(*PAIR[:-1]).agg(F.max("more").alias("more"))


def _gone(row: np.ndarray) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays([pa.array(row["doc"]), pa.array(row["tie"].astype(np.int64)), pa.array(row["line"].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool))], PAIR)


def _verified(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with similar: whether the Jaccard similarity of the two lines' sets reaches the threshold; and the sets
    (doc, tie, line, words) of all their lines."""
    num, den = THRESHOLD
    line = ["doc", "tie", "line"]
    wanted = pairs.select(*line).unionByName(pairs.select(*(F.col(f"{c}2").alias(c) for c in line))).distinct().groupBy("doc", "tie").agg(F.collect_list("line").alias("lines"))  # at most a document's own lines

    def fetch(batches):
        split = Splitter()
        for batch in batches:
            for doc, tie, data, lines in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                all_ = data.split(b"\n")
                sets = [np.unique(split([all_[i]])[0]).tobytes() for i in lines]
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(lines, pa.int32()), pa.array(sets, pa.binary())], ["doc", "tie", "line", "words"])

    sets = stored(rows.join(wanted, ["doc", "tie"]).select("doc", "tie", "data", "lines").mapInArrow(fetch, "doc long, tie long, line int, words binary").dropDuplicates(line))
    both = pairs.join(sets, line).join(sets.select(*(F.col(c).alias(f"{c}2") for c in [*line, "words"])), [f"{c}2" for c in line])

    def judge(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("words").to_pylist(), batch.column("words2").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "tie", "line", "more")), pa.array(similar, pa.bool_())], ["doc", "tie", "line", "more", "similar"])

    return both.select(*line, "more", "words", "words2").mapInArrow(judge, "doc long, tie long, line int, more boolean, similar boolean"), sets


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, tie, line) of each line that an earlier similar line removes; see ``line_dedup`` for the keys.

    The nearest FIRST_PARTNERS candidates of a line under each word are verified first, which settles nearly every line
    that has a similar one. Lines of which none was, while others remain, are then compared with all of them: their prefix
    words, as a filter, pick the rows of the index that they meet.
    """
    rows = _documents(docs, id_col, text_col)
    line = ["doc", "tie", "line"]
    counts = docs.sparkSession.sparkContext.broadcast(_rarity(rows))  # a sketch of fixed size
    index = _index(rows, counts, min_words)
    pairs = stored(_pairs(index, FIRST_PARTNERS))
    found, sets = _verified(rows, pairs.where("doc2 IS NOT NULL"))
    by_line = stored(found).groupBy(*line).agg(F.max("similar").alias("similar"), F.max("more").alias("more"))
    by_line = stored(by_line)
    gone = pairs.where("doc2 IS NULL").select(*line).unionByName(by_line.where("similar").select(*line))
    rest = by_line.where("more AND NOT similar").select(*line)
    if rest.limit(1).count():
        asked = stored(_asked(sets.join(rest, line, "left_semi").select(*line, "words"), counts))
        keep = docs.sparkSession.sparkContext.broadcast(_filter(asked))  # of fixed size
        others = _pairs(asked.unionByName(_index(rows, counts, min_words, keep)), None, first=False)
        gone = gone.unionByName(stored(_verified(rows, stored(others))[0]).where("similar").select(*line))
    return gone.distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, removed, text) of each row: the numbers of its removed lines from 0, and the text without them.

    A null text has no line, is returned as null, and an empty one has an empty line. Lines of under min_words
    different words stay; with 1 every line that has a word takes part. A null id counts as the least. Rows that repeat an id with other texts follow each other
    by checksum; rows that repeat both are one document, each returned. Without keep_text there is no text column,
    and texts are not joined. An empty table gives no rows; lines of any length are compared whole; other columns of
    ``docs`` are not read.
    """
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    gone = removed_lines(docs, id_col, text_col, min_words).groupBy("doc", "tie").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    text = F.col(text_col).cast("string")
    n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    repeated = docs.groupBy(key.alias("k")).count().where("count > 1").limit(1).count() > 0
    tie = (F.crc32(data) if repeated else F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("doc"), tie.alias("tie"), n.alias("n_lines"), *([text.alias("text")] if keep_text else []))
    out = rows.join(gone, ["doc", "tie"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    if not keep_text:
        return out.select("doc_id", "n_lines", "removed")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("removed", i))
    return out.select("doc_id", "n_lines", "removed", F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"))
