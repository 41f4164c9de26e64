"""Operator 4: removal of repeated byte strings with suffix arrays built by induced sorting.

Equal strings of LENGTH bytes must meet in one shard. A string's minimizer - the hash of its least K-byte substring by
hash, the last of equals - depends on its bytes only, so it names the shard. The windows of a document that share one
occurrence of a minimizer are neighbours; such a run is one row: (minimizer, hash of the run's bytes, place). Runs
whose minimizer is unique repeat nothing. Of runs with equal bytes all but the first are repeated as a whole. Only
where one minimizer has different runs are bytes fetched: they are joined to a text whose suffix array and permuted
longest common prefixes show the windows that occur earlier.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, stored, whole

#: Fixed values of the contract: bytes of a repeated string. Bytes of the substrings that minimizers are chosen from.
LENGTH, K = 100, 32
#: Bytes of a document hashed at once, and of a shard sorted at once.
PIECE, SHARD = 1 << 20, 2 << 20

_BASE = 0x9E3779B97F4A7C15
_FIRST = np.iinfo(np.int64).min


# --- suffix arrays -----------------------------------------------------------


def _slots(first: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[ranges(first, counts)] = True
    return out


def _place(j: np.ndarray, chars: np.ndarray, edge: np.ndarray, up: bool) -> np.ndarray:
    """Slots for suffixes j at the heads (up) or tails of their buckets, in order; moves the edges. Sorts j's by bucket."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, count)
    at = np.repeat(edge[c[first]], count)
    edge[c[first]] += count if up else -count
    slot = np.empty(len(j), np.int64)
    slot[order] = at + rank if up else at - 1 - rank
    return slot


def _known(ok: np.ndarray, at: int, up: bool) -> int:
    """The first slot from ``at`` (up: to the right, else the end of those to the left) that is not yet known."""
    step, n = 256, len(ok)
    if up:
        while at < n:
            part = ok[at : at + step]
            k = int(part.argmin())
            if not part[k]:
                return at + k
            at, step = at + len(part), step * 4
        return n
    while at > 0:
        part = ok[max(0, at - step) : at][::-1]
        k = int(part.argmin())
        if not part[k]:
            return at - k
        at, step = at - len(part), step * 4
    return 0


def _induce(s: np.ndarray, larger: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix order that the order ``lms`` of the leftmost-smaller suffixes induces.

    Both scans take whole stretches of known slots at a time: what a stretch induces lies beyond it.
    """
    n = len(s)
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    n_larger = np.bincount(s[larger], minlength=sigma)
    sa = np.full(n, -1, np.int64)
    tail = end.copy()
    sa[_place(lms[::-1], s[lms[::-1]], tail, False)] = lms[::-1]
    is_slot = _slots(start, n_larger, n)
    ok, head, at = ~is_slot, start.copy(), 0
    while at < n:
        to = _known(ok, at, True)
        j = sa[at:to] - 1
        j = j[j >= 0]
        j = j[larger[j]]
        if len(j):
            slot = _place(j, s[j], head, True)
            sa[slot] = j
            ok[slot] = True
        at = to
    sa[~is_slot] = -1
    sa[0] = n - 1
    ok, tail, at = is_slot, end.copy(), n
    ok[0] = True
    while at > 0:
        to = _known(ok, at, False)
        j = sa[to:at][::-1] - 1
        j = j[j >= 0]
        j = j[~larger[j]]
        if len(j):
            slot = _place(j, s[j], tail, False)
            sa[slot] = j
            ok[slot] = True
        at = to
    return sa


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of integers below ``sigma`` that end with their only 0: classify the suffixes, sort the
    leftmost-smaller substrings by inducing, name them, sort the names recursively, induce the rest."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    change = np.where(s[:-1] != s[1:], np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    larger = np.append(s[change] > s[np.minimum(change + 1, n - 1)], False)
    is_lms = np.append(False, ~larger[1:] & larger[:-1])
    lms = np.flatnonzero(is_lms)
    order = _induce(s, larger, lms, sigma)
    order = order[is_lms[order]]
    if len(lms) > 1:
        length = np.zeros(n, np.int64)
        length[lms] = np.append(np.diff(lms) + 1, 1)
        a, b = order[:-1], order[1:]
        live = np.flatnonzero(length[a] == length[b])
        new = np.ones(len(order), bool)
        d = 0
        while len(live):
            done = length[a[live]] == d
            new[live[done] + 1] = False
            live = live[~done]
            live = live[s[a[live] + d] == s[b[live] + d]]
            d += 1
        name = np.cumsum(new) - 1
        if name[-1] + 1 < len(lms):
            names = np.zeros(n, np.int64)
            names[order] = name
            order = lms[suffix_array(names[lms], int(name[-1]) + 1)]
    return _induce(s, larger, order, sigma)


def common_prefixes(s: np.ndarray, sa: np.ndarray, asked: np.ndarray, most: int) -> np.ndarray:
    """Permuted longest common prefixes: for each place of ``asked`` that with the suffix before it in the order, up
    to ``most``; 0 elsewhere. s: bytes, with ``most`` + 8 more at the end."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.zeros(len(s) - 7, np.uint64)
    for k in range(8):
        word |= s[k : k + len(word)].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(asked & (before >= 0))
    for k in range(0, most, 8):
        x = word[live + k] ^ word[before[live] + k]
        same = x == 0
        out[live] += np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        live = live[same]
        live = live[before[live] + k + 8 < n]
    return np.minimum(out, most)


def later_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts of its windows of ``length`` bytes that also occur in an earlier part or earlier in it."""
    sizes = np.array([len(x) for x in parts], np.int64)
    raw = np.frombuffer(b"".join(x + b"\0" for x in parts), np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    s = raw.astype(np.int64) + 2
    s[first + sizes] = 1
    sa = suffix_array(np.append(s, 0), 258)[1:]
    whole = _slots(first, np.maximum(sizes - length + 1, 0), len(raw))
    # In the text for comparing, ends differ from every byte in no way that matters: whole windows hold none.
    plcp = common_prefixes(np.append(raw, np.zeros(length + 8, np.uint8)), sa, whole, length)
    joined = (plcp[sa] >= length) & whole[sa]
    joined[1:] &= whole[sa[:-1]]
    joined[0] = False
    group = np.flatnonzero(~joined)
    least = np.minimum.reduceat(sa, group)
    later = np.zeros(len(raw), bool)
    later[sa[sa != np.repeat(least, np.diff(np.append(group, len(sa))))]] = True
    later &= whole
    at = np.flatnonzero(later)
    return np.split(at, np.searchsorted(at, first[1:])) if len(parts) > 1 else [at]


# --- minimizers --------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Polynomial hashes modulo 2**64 of all substrings of a piece."""

    def __init__(self) -> None:
        n = PIECE + LENGTH + 1
        self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(minimizer, hash of the bytes, first window, windows) of each run of windows of a piece of at least LENGTH bytes."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        each = least = _mix((sums[K:] - sums[: n - K + 1]) * self.inverse[: n - K + 1])
        wide, want = 1, LENGTH - K + 1
        while wide * 2 <= want:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < want:
            least = np.minimum(least[: len(least) - (want - wide)], least[want - wide :])
        # The minimizer's place changes when its value does, or when an equal one enters on the right.
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (each[want : want + len(least) - 1] == least[1:])]))
        end = np.append(first[1:], len(least))
        # A run's bytes reach to the end of its last window.
        whole = _mix((sums[end - 1 + LENGTH] - sums[first]) * self.inverse[first]) ^ (end - first).astype(np.uint64)
        return least[first].view(np.int64), whole.view(np.int64), first, end - first


def _settled(f, s, doc, tie, p, n):
    """The runs of a chunk, those that repeat another of it marked (n below 0) and dealt by their place.

    So a chunk sends one row of any run to its minimizer's task, however often the run occurs."""
    order = np.argsort(f, kind="stable")
    g = f[order]
    twice = np.zeros(len(g), bool)
    twice[1:] = g[1:] == g[:-1]
    twice[:-1] |= twice[1:]
    order = order[twice]
    order = order[np.lexsort((p[order], tie[order], doc[order], s[order], f[order]))]
    later = np.concatenate([[False], (f[order][1:] == f[order][:-1]) & (s[order][1:] == s[order][:-1])]) if len(order) else np.zeros(0, bool)
    # Rows of one place are a repeated document's, not repeats.
    lead = np.flatnonzero(~later)[np.cumsum(~later) - 1] if len(order) else order
    at, first = order[later], order[lead[later]]
    at = at[(doc[at] != doc[first]) | (tie[at] != tie[first]) | (p[at] != p[first])]
    n, f = n.copy(), f.copy()
    n[at] = -n[at]
    f[at] = _mix(doc[at].view(np.uint64) * np.uint64(_BASE) + p[at].astype(np.uint64)).view(np.int64)
    return f, s, doc, tie, p, n


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of ``docs``.

    spans: maximal runs of bytes (start, end) covered by a string of LENGTH bytes that starts earlier too - in a
    document of a smaller id, or earlier in the same one; kept: the other bytes. Strings are judged on the input.

    A null text is empty and has no spans. A null id counts as the least. Rows that repeat an id with other texts
    follow each other by checksum; rows that repeat both are one document, each returned. Two different texts of an
    id are told apart by CRC32. Run hashes have 64 bits and are compared only under an equal 64-bit minimizer.
    """
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    repeated = docs.groupBy(key.alias("k")).count().where("count > 1").limit(1).count() > 0
    docs = docs.select(F.col(id_col).alias("doc_id"), key.alias("doc"), (F.crc32(data) if repeated else F.lit(0)).cast("long").alias("tie"), data.alias("data"))

    def cut(batches):
        hasher = Hasher()
        names = ["f", "s", "doc", "tie", "p", "n"]
        for batch in batches:
            held, size = [], 0
            for doc, tie, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(raw, np.uint8)
                for lo in range(0, len(data) - LENGTH + 1, PIECE):
                    f, s, p, n = hasher.runs(data[lo : lo + PIECE + LENGTH - 1])
                    held.append((f, s, np.full(len(f), doc, np.int64), np.full(len(f), tie, np.int64), (p + lo).astype(np.int64), n.astype(np.int32)))
                    size += len(f)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _settled(*map(np.concatenate, zip(*held, strict=True)))], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _settled(*map(np.concatenate, zip(*held, strict=True)))], names)

    def meet(batches):
        table = whole(batches)
        if table is None:
            return
        f, s, doc, tie, p, n = (np.asarray(c.combine_chunks()) for c in table.columns)
        done = n < 0
        if done.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f[done], doc[done], tie[done], p[done], (p - n - 1 + LENGTH)[done], np.zeros(int(done.sum()), bool))], ["f", "doc", "tie", "start", "end", "ask"])
        # Most minimizers are unique: only the others are sorted as a whole.
        order = np.flatnonzero(~done)
        order = order[np.argsort(f[order])]
        g = f[order]
        twice = np.zeros(len(g), bool)
        twice[1:] = g[1:] == g[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
        f, s, doc, tie, p, n = (x[order] for x in (f, s, doc, tie, p, n))
        del table, done, order, g, twice
        order = np.lexsort((p, tie, doc, s, f))
        f, s, doc, tie, p, n = (x[order] for x in (f, s, doc, tie, p, n))
        if not len(f):
            return
        differs = lambda *xs: np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in xs])])
        new_f, new_s = differs(f), differs(f, s)
        again = ~differs(f, s, doc, tie, p)  # the same row of a repeated document
        of = np.cumsum(new_f) - 1
        kinds = np.bincount(of, new_s)[of]
        later = ~new_s & ~again
        # An equal row of the first document is that document.
        lead = np.flatnonzero(new_s)[np.cumsum(new_s) - 1]
        later &= ~((doc == doc[lead]) & (tie == tie[lead]) & (p == p[lead]))
        ask = new_s & (kinds > 1)
        pick = np.flatnonzero(later | ask)
        yield pa.RecordBatch.from_arrays([pa.array(f[pick]), pa.array(doc[pick]), pa.array(tie[pick]), pa.array(p[pick]), pa.array((p + n - 1 + LENGTH)[pick]), pa.array(ask[pick])], ["f", "doc", "tie", "start", "end", "ask"])

    kind = "f long, s long, doc long, tie long, p long, n int"
    met = stored(docs.select("doc", "tie", "data").mapInArrow(cut, kind).repartition("f").mapInArrow(meet, "f long, doc long, tie long, start long, end long, ask boolean"))
    asked = met.where("ask").groupBy("doc", "tie").agg(F.collect_list(F.struct("f", "start", "end")).alias("runs"))  # at most a document's own runs

    def fetch(batches):
        for batch in batches:
            f, doc, tie, start, part = [], [], [], [], []
            for d, t, raw, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for r in runs:
                    f.append(r["f"])
                    doc.append(d)
                    tie.append(t)
                    start.append(r["start"])
                    part.append(raw[r["start"] : r["end"]])
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(start, pa.int64()), pa.array(part, pa.binary())], ["f", "doc", "tie", "start", "part"])

    once = docs.select("doc", "tie", "data")
    fetched = (once.dropDuplicates(["doc", "tie"]) if repeated else once).join(asked, ["doc", "tie"]).mapInArrow(fetch, "f long, doc long, tie long, start long, part binary")

    def sort(batches):
        table = whole(batches)
        if table is None:
            return
        f, doc, tie, start = (np.asarray(table.column(i).combine_chunks()) for i in range(4))
        order = np.lexsort((start, tie, doc, f))
        f, doc, tie, start = (x[order] for x in (f, doc, tie, start))
        parts = table.column(4).combine_chunks().take(pa.array(order))
        sizes = np.diff(np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]).astype(np.int64)
        first_of = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        group_bytes = np.add.reduceat(sizes + 1, first_of)
        edges = np.append(first_of, len(f))
        shard = (np.cumsum(group_bytes) - group_bytes) // SHARD
        for k in np.unique(shard):
            in_it = np.flatnonzero(shard == k)
            lo, hi = int(edges[in_it[0]]), int(edges[in_it[-1] + 1])
            data = parts.slice(lo, hi - lo).to_pylist()
            found = later_windows(data) if group_bytes[in_it].sum() <= 16 * SHARD else _many(data)
            offset = np.cumsum(sizes[lo:hi] + 1) - sizes[lo:hi] - 1
            own = np.repeat(np.arange(lo, hi), [len(x) for x in found])
            at = np.concatenate(found) - offset[own - lo] + start[own] if len(own) else np.zeros(0, np.int64)
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])) if len(own) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(own)) - 1 if len(own) else new
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[new]]), pa.array(tie[own[new]]), pa.array(at[new]), pa.array(at[last] + LENGTH)], ["doc", "tie", "start", "end"])

    sorted_ = fetched.repartition("f").mapInArrow(sort, "doc long, tie long, start long, end long")
    spans = met.where("not ask").select("doc", "tie", "start", "end").unionByName(sorted_).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def drop(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, runs, kept = [], [], []
            for raw, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                sizes.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in merged])
                ends = [0, *(b for _, b in merged)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = docs.join(spans, ["doc", "tie"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(drop, f"doc_id {dict(joined.dtypes)['doc_id']}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _many(parts: list[bytes]) -> list[np.ndarray]:
    """later_windows of very many parts: their windows are dealt by checksum and sorted in several turns."""
    turns = sum(map(len, parts)) * 30 // (8 * SHARD) + 1
    offset = np.cumsum([len(x) + 1 for x in parts]) - np.array([len(x) + 1 for x in parts])
    out: list[list[int]] = [[] for _ in parts]
    for turn in range(turns):
        here = [(i, o) for i, x in enumerate(parts) for o in range(len(x) - LENGTH + 1) if zlib.crc32(x[o : o + LENGTH]) % turns == turn]
        if here:
            for (i, o), found in zip(here, later_windows([parts[i][o : o + LENGTH] for i, o in here]), strict=True):
                if len(found):
                    out[i].append(int(offset[i]) + o)
    return [np.array(sorted(x), np.int64) for x in out]
