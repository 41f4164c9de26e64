"""String similarities: in plain Python for column names, in arrays for many names at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + 0.1 * prefix * (1 - j) if j > 0.7 else j


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = s & where.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """0 to 100: indel similarity of the words in alphabetic order."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def most_indels(m: int, n: int, least: float) -> int:
    """The most letters that two texts of m and n letters may leave out to be alike to ``least`` of 100; -1 if they cannot be."""
    shared = max(0, int(least * (m + n) / 200) - 1)
    while 200.0 * shared / max(1, m + n) < least:
        shared += 1
    return m + n - 2 * shared if shared <= min(m, n) else -1


def _letters(texts: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(texts), np.uint8).reshape(-1, size)


class _Trie:
    """Different texts of one length, in the direction that has fewer nodes. A node of level k is the first of the sorted
    texts that share their first k letters."""

    def __init__(self, letters: np.ndarray):
        found = []
        for turned in (False, True):
            x = letters[:, ::-1] if turned else letters
            order = np.lexsort(x.T[::-1])
            x = x[order]
            differ = x[1:] != x[:-1]
            same = np.concatenate([[-1], differ.argmax(1)]) if len(x) > 1 else np.array([-1])
            found.append((int((letters.shape[1] - same).sum()), turned, order, x, same))
        _, self.turned, self.order, self.letters, same = min(found, key=lambda f: f[0])
        self.nodes = [np.flatnonzero(same < k) for k in range(letters.shape[1] + 1)]

    def near(self, asked: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of ``asked``, text, letters left out) of those that differ in ``most`` letters left out at most.

        Level by level, each text asked for goes with the nodes that it can still reach, and the band of its distances from
        them: of its first i letters from the node's k, for i - k from -most to most.
        """
        n, (rows, m) = self.letters.shape[1], asked.shape
        asked = asked[:, ::-1] if self.turned else asked
        padded = np.zeros((rows, max(m, n) + 2 * most + 1), np.uint8)
        padded[:, most : most + m] = asked
        width, end = 2 * most + 1, m - n + most
        kind, never = (np.int16, 1 << 13) if max(m, n) < 8000 else (np.int32, 1 << 20)
        far = np.abs(np.arange(width) - end).astype(kind)
        step = max(1, (24 << 20) // (width * len(self.letters)))
        for lo in range(0, rows, step):
            who = np.arange(lo, min(rows, lo + step))
            node = np.zeros(len(who), np.int64)
            band = [np.full(len(who), w - most if w >= most else never, kind) for w in range(width)]
            for k in range(1, n + 1):
                first = np.searchsorted(self.nodes[k], self.nodes[k - 1])
                counts = np.diff(np.append(first, len(self.nodes[k])))[node]
                child = np.repeat(first[node] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                up = np.repeat(np.arange(len(node)), counts)
                who, node = who[up], child
                letter = self.letters[self.nodes[k][node], k - 1]
                old, new = [x[up] for x in band], []
                for w in range(width):
                    x = np.where(padded[who, k - 1 + w] == letter, old[w], kind(never))
                    if w + 1 < width:
                        x = np.minimum(x, old[w + 1] + 1)
                    if w:
                        x = np.minimum(x, new[-1] + 1)
                    new.append(x)
                bound = new[0] + far[0]
                for w in range(1, width):
                    bound = np.minimum(bound, new[w] + far[w])
                alive = np.flatnonzero(bound <= most)
                who, node, band = who[alive], node[alive], [x[alive] for x in new]
                if not len(who):
                    break
            if len(who):
                yield who, self.order[node], band[end]


def near_texts(a: list[bytes], b: list[bytes], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, similarity) of all texts whose indel similarity is ``least`` of 100 or more, and whose lengths
    are 0.85 to 1.18 of each other; texts of b are different ones, none is empty."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    for n in np.unique(sizes[1]).tolist():
        mine = np.flatnonzero(sizes[1] == n)
        trie = None
        for m in np.unique(sizes[0]).tolist():
            most = most_indels(m, n, least)
            if most < 0 or not 85 * n <= 100 * m <= 118 * n:
                continue
            trie = trie or _Trie(_letters([b[i] for i in mine.tolist()], n))
            asking = np.flatnonzero(sizes[0] == m)
            for x, y, left in trie.near(_letters([a[i] for i in asking.tolist()], m), most):
                yield asking[x], mine[y], 200.0 * ((m + n - left) // 2) / (m + n)
