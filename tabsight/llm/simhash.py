"""Operator 1: near-duplicates by SimHash, found by anchor-point covering.

A fingerprint is cut into blocks of at most 23 bits. If two fingerprints differ in few bits, some block differs in at
most the block's threshold t (pigeonhole). Each block is covered by the perfect binary Golay code (23, 4096 words,
covering radius 3): its words are the anchors. A fingerprint's home is the anchor within distance 3 of its block, and
it is replicated to every anchor within 3 + t. If the blocks of x and y differ in at most t bits, y has a copy at x's
home, so comparing homes with copies anchor by anchor misses no pair. Within an anchor the copies are sorted by the
block and probed at the block values within t, so a task's work follows the true neighbours, not the square of its rows.
Anchors with many homes are dealt over a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, components, forest, ranges, spanning, stored, whole

#: Length, dimension and generator polynomial of the binary Golay code; its covering radius.
GOLAY_BITS, GOLAY_WORDS, GOLAY_POLY, RADIUS = 23, 4096, 0b101011100011, 3
SEED = 42
#: Bytes of one part of a family whose pairs are judged.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and compared.

    ngram: words in a shingle. words: 64-bit words in a fingerprint. blocks: (first bit, bits, threshold) each.
    compared: words that go with each copy and are compared; links differ there in most_diff bits at most, and in all
    words in most_in_all bits. similarity: the Jaccard similarity of the shingle sets that links must have, as a fraction;
    then the fingerprint is that of the set and nodes are sets. None: the fingerprint decides, of all shingles.
    """

    ngram: int
    words: int
    blocks: tuple[tuple[int, int, int], ...]
    compared: int
    most_diff: int
    most_in_all: int
    similarity: tuple[int, int] | None = None


#: 64 bits, at most 4 differ: then a block differs in at most 1, 1 or 0 bits, as (1+1) + (1+1) + (0+1) > 4. Exact.
CONTRACT = Plan(4, 1, ((0, 23, 1), (23, 23, 1), (46, 18, 0)), 1, 4, 4)
#: Five-word shingles and a similarity of 0.8: the angle of two such texts is 0.151 of a half turn, so that share of the
#: bits differs. Fingerprints only name candidates, with bounds four and six deviations above it (36 of 128 bits, 320 of
#: all 1,536); the exact similarity of the two sets decides. 24 blocks find a pair at 15 % with probability 0.95 and one
#: at 10 % with 0.999; pairs of a family are judged whether a block found them or not.
SIMILAR = Plan(5, 24, tuple((23 * i, 23, 1) for i in range(24)), 2, 36, 320, (4, 5))


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of the low 12 and the high 11 bits; the nearest error of each syndrome; errors by syndrome and radius."""

    def remainder(v: int) -> int:
        for k in range(GOLAY_BITS - 1, 10, -1):
            if v >> k & 1:
                v ^= GOLAY_POLY << (k - 11)
        return v

    one = np.array([remainder(1 << k) for k in range(GOLAY_BITS)], np.int64)
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for k in range(12):
        low[1 << k : 2 << k] = low[: 1 << k] ^ one[k]
    for k in range(11):
        high[1 << k : 2 << k] = high[: 1 << k] ^ one[12 + k]
    errors = [(sum(1 << k for k in c), len(c)) for n in range(RADIUS + 3) for c in combinations(range(GOLAY_BITS), n)]
    value, weight = (np.array(x, np.int64) for x in zip(*errors, strict=True))
    syndrome = low[value & 4095] ^ high[value >> 12]
    near = np.zeros(1 << 11, np.int64)
    near[syndrome[weight <= RADIUS]] = value[weight <= RADIUS]
    within = {}
    for t in range(3):
        pick = np.flatnonzero(weight <= RADIUS + t)
        pick = pick[np.argsort(syndrome[pick], kind="stable")]
        within[t] = (value[pick], np.searchsorted(syndrome[pick], np.arange((1 << 11) + 1)))
    return low, high, near, one, within


def anchors(block: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for each anchor within 3 + t of each block value."""
    low, high, near, _, within = golay()
    syndrome = low[block & 4095] ^ high[block >> 12]
    errors, first = within[t]
    counts = first[syndrome + 1] - first[syndrome]
    row = np.repeat(np.arange(len(block)), counts)
    error = errors[ranges(first[syndrome], counts)]
    # The code is cyclic and systematic in its 12 high bits, so these name the word.
    return row, (block[row] ^ error) >> 11, error == near[syndrome[row]]


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 of each shingle of a text (A-Z lowered); of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if len(words) < ngram:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[ngram - 1 :].tolist(), strict=False)), np.uint64, len(words) - ngram + 1)


def fingerprint(text: bytes, ngram: int = 4, words: int = 1) -> bytes:
    """Little-endian bytes of the fingerprint; a bit is set if it is in over half the hashes. No words: zero.

    The first 64 bits come from the hashes themselves, the others from remixed ones.
    """
    return majority(shingle_hashes(text, ngram), words)


def majority(h: np.ndarray, words: int) -> bytes:
    if not len(h):
        return bytes(8 * words)
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 255):
        part = h[i : i + 255]
        many = np.empty((len(part), words), np.uint64)
        many[:, 0] = part
        for k in range(1, words):
            part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)
            many[:, k] = part
        counts += np.unpackbits(many.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, node long, fp binary) of each row; the node is the fingerprint itself, or a hash of the shingle set;
    mark is a hash of the text."""

    def run(batches):
        for batch in batches:
            if plan.similarity:
                sets = [shingle_set(x, plan.ngram) for x in as_bytes(batch.column(2))]
                fps, nodes = [majority(x, plan.words) for x in sets], _set_nodes(sets)
            else:
                fps = [fingerprint(x, plan.ngram, plan.words) for x in as_bytes(batch.column(2))]
                nodes = np.array([int.from_bytes(x, "little") for x in fps], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(fps, pa.binary())], ["doc_id", "mark", "node", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, "doc_id long, mark long, node long, fp binary")


def shingle_set(text: bytes, ngram: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, ngram))


def _set_nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, members: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """(node, words binary): the shingle sets of ``members`` (node, doc_id, mark), made again from the texts of those rows."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, plan.ngram) for x in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(_set_nodes(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "words"])

    ids = members.select(F.col("doc_id").alias("_least"), F.col("mark").alias("_its")).distinct()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    found = texts.join(ids, F.col("_id").eqNullSafe(F.col("_least")) & (F.col("_mark") == F.col("_its")), "left_semi").select("_text").mapInArrow(run, "node long, words binary")
    return found.join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _blocks(words: np.ndarray, plan: Plan):
    """(number, values, threshold) of each block; words: (rows, plan.words)."""
    for number, (first, bits, t) in enumerate(plan.blocks):
        at, shift = divmod(first, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, at + 1] << np.uint64(64 - shift))
        yield number, (value & np.uint64((1 << bits) - 1)).astype(np.int64), t


def _matrix(column: pa.Array, plan: Plan) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, plan.words)


def _busy(fps: DataFrame, plan: Plan, most: int) -> dict[int, int]:
    """Anchors with over ``most`` homes, and how many ways they are split. At most blocks x 4096 rows are collected."""

    def run(batches):
        n = np.zeros(len(plan.blocks) * GOLAY_WORDS, np.int64)
        for batch in batches:
            for number, value, t in _blocks(_matrix(batch.column(0), plan), plan):
                _, anchor, home = anchors(value, 0)
                n += np.bincount(anchor[home] + number * GOLAY_WORDS, minlength=len(n))
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    return {r["cell"]: -(-r["n"] // most) for r in rows}


def candidates(fps: DataFrame, plan: Plan, most_homes: int = 1 << 15) -> DataFrame:
    """Links (a, b) of fingerprints that share an anchor and are near in the compared words: of those found in a task a
    spanning forest, so that no task returns more rows than it was given.

    If only some words are compared, these links name families only: then they are stars, and those of a node meet in one
    task, which joins them, so that a family has about as many links as nodes, in however many tasks it was found.
    """
    busy = _busy(fps, plan, most_homes)
    thin = _fewest if plan.compared == plan.words else _stars
    names = ["cell", "home", "block", "node", *(f"w{i}" for i in range(plan.compared))]
    kind = "cell long, home boolean, block int, node long, " + ", ".join(f"w{i} long" for i in range(plan.compared))

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                words, node = _matrix(part.column(1), plan), np.asarray(part.column(0))
                for number, value, t in _blocks(words, plan):
                    row, anchor, home = anchors(value, t)
                    cell = anchor + number * GOLAY_WORDS
                    if busy:
                        # In a split anchor a copy stands in its own column of every row, a home in its own row of every column.
                        ways = np.array([busy.get(c, 0) for c in cell.tolist()])
                        split = np.flatnonzero(ways)
                        at = np.repeat(split, ways[split])
                        other = ranges(np.ones(len(split), np.int64), ways[split])
                        mine = (node[row[at]].view(np.uint64) % ways[at].astype(np.uint64)).astype(np.int64) + 1
                        own = home[at]
                        cell = np.concatenate([cell[ways == 0], cell[at] + ((other << 15 | mine) << 32), cell[at][own] + ((mine[own] << 15 | other[own]) << 32)])
                        row = np.concatenate([row[ways == 0], row[at], row[at][own]])
                        home = np.concatenate([home[ways == 0], np.zeros(len(at), bool), np.ones(own.sum(), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), pa.array(value[row].astype(np.int32)), pa.array(node[row]), *(pa.array(words[row, i].view(np.int64)) for i in range(plan.compared))], names)

    def compare(batches):
        table = whole(batches)
        if table is None:
            return
        cell, home, block, node, *words = (np.asarray(x.combine_chunks()) for x in table.columns)
        words = [w.view(np.uint64) for w in words]
        # (cell, block) in one number; the cell's place among those of this task.
        where = (np.unique(cell, return_inverse=True)[1].astype(np.int64) << GOLAY_BITS) | block
        limit = np.array([t for *_, t in plan.blocks])[(cell & 0xFFFFFFFF) // GOLAY_WORDS]
        copies = np.flatnonzero(~home | (cell < 1 << 32))  # a home in an anchor that is not split is a copy as well
        copies = copies[np.argsort(where[copies], kind="stable")]
        keys = where[copies]
        found, held = [], 0
        for t in range(int(limit.max()) + 1):
            for flip in (sum(1 << k for k in c) for c in combinations(range(GOLAY_BITS), t)):
                asked = np.flatnonzero(home & (limit >= t))
                first = np.searchsorted(keys, where[asked] ^ flip)
                counts = np.searchsorted(keys, where[asked] ^ flip, "right") - first
                some = counts > 0
                asked, first, counts = asked[some], first[some], counts[some]
                total = np.concatenate([[0], np.cumsum(counts)])
                lo = 0
                while lo < len(asked):  # some million pairs at a time, however large the group
                    hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 2_000_000, "right")) - 1)
                    x = np.repeat(asked[lo:hi], counts[lo:hi])
                    y = copies[ranges(first[lo:hi], counts[lo:hi])]
                    differ = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int16) for w in words)
                    near = (differ <= plan.most_diff) & (node[x] < node[y])
                    found.append((node[x][near], node[y][near], differ[near]))
                    held += int(near.sum())
                    if held > 2_000_000:
                        found = [thin(found)]
                        held = len(found[0][0])
                    lo = hi
        if held:
            a, b, _ = thin(found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def merge(batches):
        table = whole(batches)
        if table is not None:
            a, b, _ = _stars([tuple(np.asarray(x.combine_chunks()) for x in table.columns)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = fps.mapInArrow(spread, kind).repartition("cell").mapInArrow(compare, "a long, b long")
    if plan.compared == plan.words:
        return edges
    return edges.repartition("b").mapInArrow(merge, "a long, b long")


def links(fps: DataFrame, plan: Plan, most_homes: int = 1 << 15, sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that join the near fingerprints of ``fps`` (node long, fp binary; distinct).

    If only some words are compared, the candidates are no answer, but any two near fingerprints that share an anchor are
    in one family (component) of them; all pairs of a family are then judged, see ``_judged``, by their sets as well if
    ``sets`` gives the shingle sets (node, words binary) of nodes.
    """
    edges = candidates(fps, plan, most_homes)
    if plan.compared == plan.words:
        return edges
    members = components(edges).withColumnRenamed("root", "family").join(fps, "node")
    members = stored(members)
    return _judged(stored(members.join(sets(members), "node")) if sets else members, plan)


def _judged(members: DataFrame, plan: Plan, most_bytes: int = PART_BYTES) -> DataFrame:
    """Links (a, b) of all near pairs of ``members`` (node, family, fp; words, the shingle set, if sets decide), each
    family's pairs judged in blocks.

    A family of over most_bytes is cut into parts, and every two parts meet in a task of their own. A block returns a
    spanning forest of the links it has confirmed: only a pair that confirmed links join already goes unjudged.
    """
    data = ["fp", "words"] if "words" in members.columns else ["fp"]
    size = members.groupBy("family").agg(F.ceil(F.sum(sum(F.octet_length(c) for c in data)) / most_bytes).cast("int").alias("ways"))
    dealt = members.join(size, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    block = ["family", "low", "high"]

    def run(batches):
        held, key, a, b = [], None, [], []
        for batch in batches:
            ids = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)] if len(ids) else []
            for lo, hi in zip(cuts, cuts[1:]):
                mine = tuple(ids[lo].tolist())
                if held and mine != key:
                    _confirm(held, key, plan, a, b)
                    held = []
                key = mine
                held.append(batch.slice(lo, hi - lo))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if held:
            _confirm(held, key, plan, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.select(*block, "part", "node", *data).repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "a long, b long")


def _confirm(held: list[pa.RecordBatch], key: tuple[int, int, int], plan: Plan, a: list[int], b: list[int]) -> None:
    """Adds to a and b a spanning forest of the confirmed links of one block's rows."""
    rows = pa.Table.from_batches(held).combine_chunks()
    part, node = (np.asarray(rows.column(i).combine_chunks()) for i in (3, 4))
    words = _matrix(rows.column(5), plan)
    sets = [np.frombuffer(v, np.uint64) for v in rows.column(6).to_pylist()] if rows.num_columns > 6 else None
    size = np.array([len(v) for v in sets]) if sets else None
    num, den = plan.similarity or (0, 1)
    same = key[1] == key[2]
    x, y = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
    root = np.arange(len(node))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    step = max(1, 50_000 // max(1, len(y)))
    for lo in range(0, len(x), step):
        i, j = x[lo : lo + step], y[lo:] if same else y
        differ = np.bitwise_count(words[i][:, None] ^ words[j][None]).sum(2, dtype=np.int32)
        near = differ <= plan.most_in_all
        if same:
            near &= i[:, None] < j[None]
        if sets:
            near &= den * np.minimum(size[i][:, None], size[j][None]) >= num * np.maximum(size[i][:, None], size[j][None])
        at, to = np.nonzero(near)
        differ = differ[at, to]
        at, to = i[at], j[to]
        up = np.array([top(k) for k in range(len(root))]) if len(at) > len(root) else None
        if up is not None:
            apart = up[at] != up[to]
            at, to, differ = at[apart], to[apart], differ[apart]
        order = np.argsort(differ, kind="stable")
        for m, n in zip(at[order].tolist(), to[order].tolist(), strict=True):
            p, q = top(m), top(n)
            if p != q:
                if sets:
                    shared = len(np.intersect1d(sets[m], sets[n], assume_unique=True))
                    if den * shared < num * (size[m] + size[n] - shared):
                        continue
                root[q] = p
                a.append(int(node[m]))
                b.append(int(node[n]))


def _stars(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Links of each node to the least that it is joined to: tasks that see the same group agree on most of them."""
    child, root = forest(*(np.concatenate(x) for x in list(zip(*found, strict=True))[:2]))
    return root, child, np.zeros(len(child), np.int16)


def _fewest(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
    pick = spanning(a, b, d)
    return a[pick], b[pick], d[pick]


def simhash_groups(docs: DataFrame, plan: Plan = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node long, fp binary, component_id) of each row of ``docs``.

    component_id is the least id that can be reached by links, the row's own included. A null or empty text has no
    words, the fingerprint zero, and is linked like any other; rows with a null id get the least id of their group,
    null if it has none. Repeated rows stay repeated; an empty table gives no rows; texts of any length count whole.
    Other columns of ``docs`` are not read, whatever their names. The plan's fingerprints decide.
    """
    rows = stored(fingerprints(docs, plan, id_col, text_col).drop("mark"))
    distinct = stored(rows.groupBy("node", "fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("node", "fp"), plan))
    named = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(groups, "root").select("node", "component_id"), "node").select("doc_id", "node", "fp", "component_id")


def near_dedup(docs: DataFrame, plan: Plan = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first by id (null last), then by a hash of the text.

    Texts decide, not ids: rows that share an id, or have none, but differ in their texts are judged each, and of rows
    that repeat both id and text one stays. Null and empty texts have no words and are alike. An empty table gives no
    rows. Columns are returned as they are, whatever their names.
    """
    mark = F.xxhash64(F.col(text_col).cast("string"))
    rows = stored(fingerprints(docs, plan, id_col, text_col))
    distinct = stored(rows.groupBy("node", "fp").agg(F.min(_first("doc_id", "mark")).alias("first")))
    sets = (lambda members: shingle_sets(docs, members.select("node").join(distinct, "node").select("node", "first.*"), plan, id_col, text_col)) if plan.similarity else None
    roots = components(links(distinct.select("node", "fp"), plan, sets=sets))
    named = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    keep = named.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.mark").alias("_kept_mark"))
    at = docs.withColumns({"_near_id": F.col(id_col).cast("long"), "_near_mark": mark})
    found = at.join(keep, F.col("_near_id").eqNullSafe(F.col("_kept_id")) & (F.col("_near_mark") == F.col("_kept_mark")), "left_semi")
    return found.dropDuplicates(["_near_id", "_near_mark"]).drop("_near_id", "_near_mark")


def _first(id_col: str, mark: str) -> Column:
    """Orders rows by id, null last, then by the text's hash."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.col(mark).alias("mark"))
