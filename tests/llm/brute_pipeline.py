"""A plain Python version of the whole pipeline, for small inputs."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import brute

RULES = [("symbols", 6, True), ("repeated_lines", 6, True), ("word_length", 8, True), ("word_length", 8, False)]
STEPS = {"symbols": 50, "repeated_lines": 50, "word_length": 400}


def cells(text):
    n, chars, symbols, dup, _, _ = brute.measures(text)
    lines = sum(1 for x in (text or "").split("\n") if brute.WORD.search(x))
    share = {"symbols": (symbols + 1) / (chars + 1), "repeated_lines": (dup + 1) / (lines - dup + 1), "word_length": max(chars, 1) / max(n, 1)}
    return {k: math.floor(math.log(v) * STEPS[k]) for k, v in share.items()}


def quartiles(counts):
    total, upto, out = sum(counts.values()), 0, {}
    for cell in sorted(counts):
        upto += counts[cell]
        for k in (1, 2, 3):
            if 4 * upto >= k * total:
                out.setdefault(k, cell)
    return out[1], out[2], out[3]


def good(docs):
    """The documents (dicts) that the quality rules keep."""
    passed = [d for d in docs if not brute.measures(d["text"])[-1]]
    by = defaultdict(Counter)
    for d in passed:
        for m, cell in cells(d["text"]).items():
            for key in ((d["lang"], d["source"], m), (d["lang"], m), (m,)):
                by[key][cell] += 1
    kept = []
    for d in passed:
        ok = True
        for m, spread, upper in RULES:
            own, lang, every = (d["lang"], d["source"], m), (d["lang"], m), (m,)
            mixed = Counter({c: 1000 * n for c, n in by[own].items()})
            for wide in (lang, every):
                size = by[wide].total()
                for c, n in by[wide].items():
                    mixed[c] += n * 1000 * min(100, size) // size
            q, l, a = quartiles(mixed), quartiles(by[lang]), quartiles(by[every])
            down = max(q[1] - q[0], l[1] - l[0]) or a[1] - a[0] or 1
            up = max(q[2] - q[1], l[2] - l[1]) or a[2] - a[1] or 1
            cell = cells(d["text"])[m]
            ok &= cell <= q[1] + spread * down if upper else cell >= q[1] - spread * up
        if ok:
            kept.append(d)
    return kept


def first_of_each(docs):
    """One of each group that pairs of a Jaccard similarity of 0.8 or more of their five-word shingles join."""

    def shingles(text):
        w = brute.WORD.findall(brute.low(text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}

    sets = [shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[find(i)].append(d)
    return [min(g, key=lambda d: (d["doc_id"] is None, d["doc_id"])) for g in groups.values()]


def hash60(salt, key):
    return int(hashlib.md5(f"{salt}:{'null' if key is None else key}".encode()).hexdigest()[:15], 16)


def mixed(docs):
    """Documents as often as the mix takes them."""
    size = lambda d: len(brute.WORD.findall(d["text"] or ""))
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(d) for d in docs if d["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, free, target = 1.5 * sum(total.values()), set(sources), {}
    while free:  # resharing the excess by weight until none is above its cap
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    out = []
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        hashes = sorted({hash60("mix", d["doc_id"]) for d in docs if d["source"] == s}, key=lambda h: (h % 4096, h))
        n = Counter()
        for d in docs:
            if d["source"] == s:
                n[hash60("mix", d["doc_id"])] += size(d)
        taken, run = set(), 0
        for h in hashes:  # the one on which the rest runs out is taken if that brings the sum nearer
            run += n[h]
            if rest > 0 and (run <= rest or run - n[h] / 2 <= rest):
                taken.add(h)
        for d in docs:
            if d["source"] == s:
                out += [d] * (whole + (hash60("mix", d["doc_id"]) in taken))
    return out


def sharded(docs, shards=40):
    """{(doc_id, text): (size, checksum, shard, shard among one more)}."""
    out = {}
    for d in docs:
        data = (d["text"] or "").encode()
        score = [1 / -math.log((hash60(i, d["doc_id"]) + 0.5) / 2**60) for i in range(shards + 1)]
        best = lambda n, s=score: max(range(n), key=lambda i: s[i])
        out[d["doc_id"], d["text"]] = len(data) + 16, zlib.crc32(data), best(shards), best(shards + 1)
    return out


def run(docs, items):
    docs = first_of_each(good(docs))
    docs = [d for d in docs if not brute.contamination(d["text"], items)[-1]]
    return mixed(docs)
