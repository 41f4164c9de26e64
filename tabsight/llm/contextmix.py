"""Logistic context mixing over the bytes of tokens, worked out for whole arrays of bytes at once.

A text is coded as its class (that of its most frequent short word, which tells its language) and its tokens: a word as its
bytes and a blank, the end as a line feed. A byte is coded by binary decisions along a prefix code of the training texts'
bytes, frequent bytes by few of them. For each decision several predictors look up the counts of zeros and ones that
followed their hashed context in the training texts. Their stretched probabilities are mixed by the weights of a set that a
gate selects (which decision, and how often the longer contexts were seen), and an adaptive map refines the mix.

A token's first two bytes, its head, have contexts that reach across the blank: the word so far with the class, the last six
bytes, and the word so far with the whole word before and the class. The other bytes, its tail, have the last two bytes with
the class, the last three, the word so far, and that with the class. So a head's bits are worked out once for each
different (head, word before) of some texts, and a tail's once for each different word.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import ranges

#: The end of a text as it is coded (a word has no such byte); also what stands before a text's first token.
END_BYTE = 10
#: Bytes of a head, and classes of texts.
HEAD, CLASSES = 2, 256
#: Slots (log2) of the counts of each predictor of heads and of tails, which bound what a task holds; contexts share slots
#: when the corpus has more of them.
SLOTS = ((18, 21, 21), (20, 20, 21, 21))
_ODD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A slot's cell: its stretched probability in steps of 1 / _STEPS, times four, plus a class of how often it was seen.
_STEPS = 512
#: Gates: decision (the last stands for all later ones), and how often each of the last three contexts was seen.
_DEPTHS = 8
_SETS = _DEPTHS * 64
#: Cells of a decision's refinement, over stretched probabilities of -8 to 8; bytes that are worked on at once,
#: fewer of them as long as little is learned.
_CELLS, PIECE = 33, 1 << 16
#: The first texts of a task are learned from in parts that double so often; how fast weights are learned.
FIRST_PARTS, RATE = 5, 0.05
#: Bytes whose contexts are held at once.
UNITS = 1 << 19
#: A-Z lowered, and every white space a blank.
PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5))


def hashed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _ODD
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


class Code:
    """A prefix code of the bytes by their frequencies; every byte has a code word, however rare."""

    def __init__(self, frequency: np.ndarray):
        heap = [(int(n) * 256 + 1, i, (i,)) for i, n in enumerate(frequency)]
        heapq.heapify(heap)
        words = [""] * 256
        while len(heap) > 1:
            (n, i, left), (m, j, right) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, symbols in (("0", left), ("1", right)):
                for s in symbols:
                    words[s] = bit + words[s]
            heapq.heappush(heap, (n + m, min(i, j), left + right))
        self.words = words
        self.length = np.array([len(w) for w in words])
        self.depth = int(self.length.max())
        # Four decisions in a row share 16 neighbouring slots: a context's are fetched together.
        self.step = np.array([[2 * int("1" + w[d & ~3 : d], 2) + int(w[d]) if d < len(w) else 0 for w in words] for d in range(self.depth)], np.int64)
        self.node = np.array([[int("1" + w[:d], 2) & ((1 << 64) - 1) if d < len(w) else 0 for w in words] for d in range(0, self.depth, 4)], np.uint64)


def bounds(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, size) of each of some coded tokens: a blank or a line feed ends each and stands in none."""
    end = np.flatnonzero((coded == 32) | (coded == END_BYTE))
    first = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    return first, end + 1 - first


def binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of bytes that stand one after the other."""
    edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))])


class Tally:
    """The different tokens of some texts, and the different pairs of a token's head and the token before it, apart for
    each class of texts.

    coded, kinds: the tokens as they are coded, one after another, and their class. at: the tokens of all texts, one text
    after another; sizes: of each text; classes: of each text; bytes: those of each text's tokens, as coded.
    """

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.at = None

    def add(self, tokens: list[bytes]) -> None:
        """A text's words."""
        self.texts.append(b" ".join(tokens))

    def add_text(self, text: bytes) -> None:
        self.texts.append(text.translate(PLAIN))

    @property
    def words(self) -> list[bytes]:
        """The different tokens without what ends them."""
        if self.at is None:
            self.number()
        first, size = bounds(self.coded)
        return [self.coded[i : i + n - 1].tobytes() for i, n in zip(first.tolist(), size.tolist(), strict=True)]

    def number(self) -> None:
        """Numbers the tokens of the texts, which end with it."""
        n = len(self.texts)
        length = np.fromiter(map(len, self.texts), np.int64, n) + 1
        raw = np.frombuffer(b"\n".join([*self.texts, b""]), np.uint8)
        self.texts = []
        blank = (raw == 32) | (raw == END_BYTE)
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        start, size = edge[::2], (edge[1::2] - edge[::2]).astype(np.int32)
        count = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(length)])))
        del edge, start
        data = raw[~blank]
        del raw, blank
        found = binaries(data, size).dictionary_encode()
        code, distinct = found.indices.to_numpy(), found.dictionary
        del found, data
        text = np.repeat(np.arange(n, dtype=np.int32), count)
        self.classes = _classes(distinct, code, text, size <= 3, n)
        self.sizes = count + 1
        of_end = len(distinct)
        key = np.full(len(code) + n, of_end, np.int64)
        key[np.arange(len(code)) + text] = code
        key += np.repeat(self.classes.astype(np.int64), self.sizes) * (of_end + 1)
        del code, text
        at, known = pd.factorize(key)
        self.at = at.astype(np.int32)
        kinds, code = np.divmod(known, of_end + 1)
        self.kinds = kinds.astype(np.uint8)
        edge, data = _buffers(distinct)
        size = np.append(np.diff(edge), 0)[code]
        first = np.cumsum(size + 1) - size - 1
        self.coded = np.full(int((size + 1).sum()), 32, np.uint8)
        self.coded[ranges(first, size)] = data[ranges(np.append(edge[:-1], 0)[code], size)]
        self.coded[first[code == of_end]] = END_BYTE
        self.bytes = np.add.reduceat((size + 1)[self.at], np.cumsum(self.sizes) - self.sizes) if n else np.zeros(0, np.int64)

    def close(self, pairs: bool = True) -> None:
        if self.at is None:
            self.number()
        if pairs:
            self.pair_up()

    def pair_up(self) -> None:
        coded = self.coded
        self.first, self.size = bounds(coded)
        end = self.first + self.size - 1
        self.kind = (np.asarray(self.kinds, np.uint64) + np.uint64(1)) * _MUL
        one = self.size == 1
        second = coded[np.minimum(self.first + 1, end)].astype(np.int64)
        second[one] = 0
        head = ((np.asarray(self.kinds, np.int64) * 256 + coded[self.first]) * 256 + second) * 2 + one
        self.heads, self.head = np.unique(head, return_inverse=True)
        before = np.concatenate([self.at[:1], self.at[:-1]])
        first = np.cumsum(self.sizes) - self.sizes
        before[first] = self.at[first + self.sizes - 1]  # END stands before the first token
        key = self.head[self.at] * len(self.first)
        key += before
        del before
        which, self.pairs = pd.factorize(key)
        self.which = which.astype(np.int32)
        last = _last(coded, end, self.size - 1)
        self.whole = _word(last, self.size - 1)
        self.tail = np.where(one, np.uint64(END_BYTE), last << np.uint64(8) | np.uint64(32))


def _buffers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bytes) of an array of large binaries."""
    _, edge, data = x.buffers()
    edge = np.frombuffer(edge, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    return edge, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _classes(distinct: pa.Array, code: np.ndarray, text: np.ndarray, short: np.ndarray, n: int) -> np.ndarray:
    """The class of each text: that of its most frequent word of at most three bytes (the greatest of several)."""
    out = np.zeros(n, np.uint8)
    if not short.any():
        return out
    known, times = np.unique(text[short].astype(np.int64) * len(distinct) + code[short], return_counts=True)
    of, word = np.divmod(known, len(distinct))
    words, word = np.unique(word, return_inverse=True)
    words = distinct.take(pa.array(words)).to_pylist()
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[word], times, of))
    best = order[np.append(of[order][1:] != of[order][:-1], True)]
    kind = np.array([zlib.crc32(w) % CLASSES for w in words], np.uint8)
    out[of[best]] = kind[word[best]]
    return out


class Units:
    """Bytes to be coded, each different one under its contexts once: ``symbol``, and the hash of each predictor's context.

    last: the context that tells bytes apart; contexts: of the bytes at given places, all predictors'. owner, of: of each byte
    of the units, its unit and its place among the different ones.
    """

    def __init__(self, symbol: np.ndarray, last: np.ndarray, contexts: Callable[[np.ndarray], list[np.ndarray]], owner: np.ndarray, units: int):
        self.of, known = pd.factorize((last + symbol) * _ODD)
        at = np.empty(len(known), np.int64)
        at[self.of] = np.arange(len(symbol))
        self.symbol, self.contexts, self.owner, self.units = symbol[at], contexts(at), owner, units

    def times(self, n: np.ndarray) -> np.ndarray:
        """How often each different byte occurs; n: how often each unit does."""
        return np.bincount(self.of, n[self.owner], len(self.symbol)).astype(np.uint32)

    def add_up(self, bits: np.ndarray) -> np.ndarray:
        """Of each unit."""
        return np.bincount(self.owner, bits[self.of], self.units)


def _masked(last: np.ndarray, n) -> np.ndarray:
    """The last n bytes, at most eight."""
    return last & _MASKS[np.minimum(n, 8)]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _last(coded: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The eight bytes before each place of ``at`` in its token, the nearest lowest; place: how many there are."""
    last = np.zeros(len(at), np.uint64)
    for k in range(1, 9):
        last |= coded[np.maximum(at - k, 0)].astype(np.uint64) << np.uint64(8 * k - 8)
    return _masked(last, place)


def _word(last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hash of a word so far: known by its last eight bytes and its length."""
    return hashed(last + place.astype(np.uint64) * _MUL, 4)


def tails(tally: Tally, of: np.ndarray, start: np.ndarray, size: np.ndarray) -> Units:
    """Of the tokens ``of`` a Tally, ``size`` bytes each from ``start``; heads are left out."""
    at, owner = ranges(start, size), np.repeat(of, size)
    place = at - tally.first[owner]
    symbol = tally.coded[at]
    last = _last(tally.coded, at, place)
    word, k = _word(last, place), tally.kind[owner]
    own = hashed(word ^ k, 12)
    return Units(symbol, own, lambda i: [hashed(_masked(last[i], 2) ^ k[i], 11), hashed(_masked(last[i], 3), 3), word[i], own[i]], owner, len(tally.first))


def heads(tally: Tally, of: np.ndarray) -> Units:
    """Of the pairs ``of`` a Tally."""
    head, before = np.divmod(tally.pairs[of], max(1, len(tally.first)))
    head = tally.heads[head]
    size = 2 - (head & 1)
    unit = np.repeat(np.arange(len(head), dtype=np.int32), size)
    place = np.arange(len(unit)) - (np.cumsum(size) - size)[unit]
    byte = np.stack([head >> 9 & 255, head >> 1 & 255], 1)
    prefix = np.where(place > 0, byte[unit, 0] + 1, 0).astype(np.uint64)
    after = hashed((tally.whole ^ tally.kind)[before][unit] ^ prefix * _MUL, 8)  # a pair's tokens are of one class

    def contexts(i: np.ndarray) -> list[np.ndarray]:
        p, b = prefix[i], before[unit[i]]
        across = np.where(p > 0, tally.tail[b] << np.uint64(8) | (p - np.uint64(1)), tally.tail[b])
        return [hashed(p ^ tally.kind[b], 5), hashed(_masked(across, 6) ^ p << np.uint64(56), 7), after[i]]

    return Units(byte[unit, place].astype(np.uint8), after, contexts, of[unit], len(tally.pairs))


def _mingled(group: np.ndarray) -> np.ndarray:
    """An order in which a group stands together, and groups as it happens."""
    return np.argsort(hashed(group.astype(np.uint64), 21), kind="stable")


def some_heads(tally: Tally, of: np.ndarray, most: int | None = None) -> Iterator[Units]:
    """Those of the pairs ``of``, about ``most`` bytes at once. What follows one token stands together, as equal bytes under equal contexts do."""
    of = of[_mingled(tally.pairs[of] % max(1, len(tally.first)))]
    most = most or UNITS
    for lo in range(0, len(of), most // HEAD):
        yield heads(tally, of[lo : lo + most // HEAD])


def some_tails(tally: Tally, of: np.ndarray, most: int | None = None) -> Iterator[Units]:
    """Those of the tokens ``of``, at most ``most`` bytes at once, a long token's apart. Tokens of one head stand together."""
    of = of[tally.size[of] > HEAD]
    of = of[_mingled(tally.head[of])]
    start, size = tally.first[of] + HEAD, tally.size[of] - HEAD
    edge = np.cumsum(size)
    most = most or UNITS
    for lo in range(0, int(size.sum()), most):
        hi = lo + most
        a, b = int(np.searchsorted(edge, lo, "right")), min(len(of), int(np.searchsorted(edge, hi, "left")) + 1)
        begin, n = start[a:b].copy(), size[a:b].copy()
        n[-1] -= max(0, int(edge[b - 1]) - hi)
        skip = lo - int(edge[a] - size[a])
        begin[0] += skip
        n[0] -= skip
        yield tails(tally, of[a:b], begin, n)


def units(tally: Tally) -> tuple[Units, Units]:
    """All heads of a Tally's pairs, and all tails of its tokens."""
    return heads(tally, np.arange(len(tally.pairs))), tails(tally, np.arange(len(tally.first)), tally.first + HEAD, np.maximum(tally.size - HEAD, 0))


class Mixer:
    """cells: of all slots. weights: (predictor or constant, gate). refined: (decision, cell) probabilities."""

    def __init__(self, code: Code, slots: tuple[int, ...]):
        self.code, self.slots = code, slots
        self.offset = np.cumsum([0, *(1 << k for k in slots)])
        self.cells = np.zeros(int(self.offset[-1]), np.int16)
        self.weights = np.full((len(slots) + 1, _SETS), 0.3, np.float32)
        self.weights[-1] = 0
        self.refined = plain_map(code.depth)

    @property
    def refined(self) -> np.ndarray:
        return self._refined

    @refined.setter
    def refined(self, x: np.ndarray) -> None:
        self._refined, self.slopes = x, np.diff(x, axis=1)

    def walk(self, all_symbols: np.ndarray, all_contexts: list[np.ndarray], piece: int = PIECE) -> Iterator[tuple]:
        """Piece by piece, decision by decision, what the predictors say.

        Yields the places of a piece's bytes at its start, and then (decision, bit, slots, stretched probabilities, gate,
        mix). A piece's bytes stand by the length of their code word, the longest first, so those that a decision is made
        for come first.
        """
        code = self.code
        for lo in range(0, len(all_symbols), piece):
            short = (255 - code.length[all_symbols[lo : lo + piece]]).astype(np.uint8)
            order = np.argsort(short, kind="stable")
            open_ = np.searchsorted(short[order], np.arange(255, 255 - code.depth, -1))
            order += lo
            symbol, contexts = all_symbols[order], [c[order] for c in all_contexts]
            yield (order,)
            for d in range(code.depth):
                n = int(open_[d])
                if not n:
                    break
                if d % 4 == 0:
                    node = code.node[d // 4].take(symbol[:n])
                    base = [((((c[:n] + node) * _ODD) >> np.uint64(68 - k)) << np.uint64(4)).view(np.int64) + o for c, k, o in zip(contexts, self.slots, self.offset, strict=False)]
                step = code.step[d].take(symbol[:n])
                inner = step >> 1
                slots = [b[:n] + inner for b in base]
                found = [self.cells.take(i) for i in slots]
                gate = np.int64(min(d, _DEPTHS - 1))
                for v in found[-3:]:
                    gate = gate * 4 + (v & 3)
                x = [(v >> 2) * np.float32(1 / _STEPS) for v in found]
                mix = self.weights[-1].take(gate)
                for w, v in zip(self.weights, x, strict=False):
                    mix += w.take(gate) * v
                yield d, step & 1, slots, x, gate, mix

    def refine(self, d: int, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mixed probability, cell, share of the next cell, refined probability) of a one."""
        at = (np.clip(mix, np.float32(-7.999), np.float32(7.999)) + np.float32(8)) * np.float32((_CELLS - 1) / 16)
        low = at.astype(np.int64)
        part = at - low.astype(np.float32)
        mixed = squash(mix)
        p = (mixed + self._refined[d].take(low) + self.slopes[d].take(low) * part) * np.float32(0.5)
        return mixed, low, part, np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))

    def bits(self, u: Units) -> np.ndarray:
        """Bits of each different byte."""
        out = np.ones(len(u.symbol))
        order = None
        for step in self.walk(u.symbol, u.contexts):
            if len(step) == 1:
                if order is not None:
                    out[order] = chance
                order, chance = step[0], np.ones(len(step[0]))  # a byte has at most some tens of decisions of 1e-6 or more
            else:
                d, bit, mix = step[0], step[1], step[-1]
                chance[: len(bit)] *= np.abs(self.refine(d, mix)[3] - (1 - bit))
        if order is not None:
            out[order] = chance
        return -np.log2(out)


class Model:
    """Of the heads and of the tails."""

    def __init__(self, code: Code, slots: tuple[tuple[int, ...], ...] = SLOTS):
        self.mixers = [Mixer(code, s) for s in slots]

    def text_bits(self, tally: Tally) -> np.ndarray:
        """Bits of each of the Tally's texts, its class not counted."""
        if not len(tally.sizes):
            return np.zeros(0)
        found = []
        for m, parts, n in zip(self.mixers, (some_heads, some_tails), (len(tally.pairs), len(tally.first)), strict=True):
            found.append(np.zeros(n))
            for u in parts(tally, np.arange(n)):
                found[-1] += u.add_up(m.bits(u))
        return np.add.reduceat(found[0][tally.which] + found[1][tally.at], np.cumsum(tally.sizes) - tally.sizes)


class Learner:
    """Learns a Mixer online: bytes are predicted from the counts of the batches before, and counted.

    The predictors follow the counts as often as these have about doubled. The weights are the means over all that was learned from.
    """

    def __init__(self, code: Code, slots: tuple[int, ...]):
        self.mixer = Mixer(code, slots)
        self.counts = np.zeros(2 * len(self.mixer.cells), np.uint32)
        self.used, self.sums = np.zeros(_SETS), np.zeros(self.mixer.weights.shape)
        self.hits = np.zeros((2, code.depth, _CELLS))
        self.power = np.ones(self.mixer.weights.shape, np.float32)
        self.batches, self.refresh, self.seen = 0, 0, 0

    def learn(self, u: Units, times: np.ndarray) -> None:
        """times: how often each different byte occurs."""
        m, counts = self.mixer, self.counts
        order = np.random.default_rng(1).permutation(np.flatnonzero(times))  # frequent words do not come before all rare ones
        times = times[order]
        for step in m.walk(u.symbol[order], [c[order] for c in u.contexts], max(PIECE >> 4, min(PIECE, self.seen >> 4))):
            if len(step) == 1:
                all_times = times[step[0]]
                continue
            d, bit, slots, x, gate, mix = step
            times_ = all_times[: len(bit)]
            n = times_.astype(np.float32)
            mixed, low, share, _ = m.refine(d, mix)
            if self.batches:  # before, no predictor had anything to say
                error = n * (bit - mixed)
                total = np.bincount(gate, n, _SETS)
                change = np.stack([*(np.bincount(gate, error * v, _SETS) for v in x), np.bincount(gate, error, _SETS)]) / np.maximum(total, 1)
                self.power = np.where(total > 0, 0.95 * self.power + 0.05 * change * change, self.power)
                m.weights += (RATE * change / np.sqrt(self.power + 1e-4)).astype(np.float32)
                self.used += total
                self.sums += total * m.weights
                cell, right = low * 2 + bit, n * share
                self.hits[:, d] += (np.bincount(cell, n - right, 2 * _CELLS) + np.bincount(cell + 2, right, 2 * _CELLS)).reshape(-1, 2).T
            for i in slots:
                np.add.at(counts, i * 2 + bit, times_)
        self.seen += len(order)

    def close(self) -> None:
        """Ends a batch."""
        m = self.mixer
        m.refined = refinement(self.hits)
        self.batches += 1
        if self.batches <= FIRST_PARTS + 1 or self.batches >= self.refresh:
            m.cells, self.refresh = cells(self.counts), 2 * self.batches - FIRST_PARTS


def learn(learners: list[Learner], tally: Tally, training: np.ndarray) -> None:
    """From the training texts of a Tally; from the first in growing parts."""
    texts = np.flatnonzero(training)
    cuts = [] if learners[0].batches else [len(texts) >> k for k in range(FIRST_PARTS, 0, -1)]
    for part in np.split(texts, cuts):
        mine = np.zeros(len(training), bool)
        mine[part] = True
        taught = np.repeat(mine, tally.sizes)
        for x, parts, at, n in zip(learners, (some_heads, some_tails), (tally.which, tally.at), (len(tally.pairs), len(tally.first)), strict=True):
            times = np.bincount(at[taught], minlength=n)
            for u in parts(tally, np.flatnonzero(times)):
                x.learn(u, u.times(times))
            x.close()


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, np.float32(-20), np.float32(20))))


def plain_map(depth: int) -> np.ndarray:
    return np.tile(squash(np.linspace(-8, 8, _CELLS)), (depth, 1)).astype(np.float32)


def refinement(hits: np.ndarray) -> np.ndarray:
    """Probabilities of ones from (zeros and ones, decision, cell), drawn to the plain map where little was seen."""
    return np.clip((hits[1] + 20 * plain_map(hits.shape[1])) / (hits.sum(0) + 20), 1e-5, 1 - 1e-5).astype(np.float32)


def cells(counts: np.ndarray) -> np.ndarray:
    """(slots * 2) counts of zeros and ones -> cells."""
    out = np.zeros(len(counts) // 2, np.int16)
    for lo in range(0, len(out), 1 << 20):
        pair = counts[2 * lo : 2 * lo + (2 << 20)].reshape(-1, 2)
        at = np.flatnonzero(pair[:, 0] | pair[:, 1])
        zeros, ones = pair[at, 0].astype(np.float32), pair[at, 1].astype(np.float32)
        total = zeros + ones
        stretched = np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))
        seen = 1 + (total > 1).astype(np.int16) + (total > 3)
        out[lo + at] = (np.round(stretched * _STEPS).clip(-8000, 8000).astype(np.int16) << 2) | seen
    return out
