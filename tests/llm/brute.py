"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text, n=4):
    w = WORD.findall(low(text or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, k=4):
    """{doc_id: (fingerprint, component_id)} of {doc_id: fingerprint}."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= k:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(five)
    hit = {j for i, x in enumerate(five) if seen[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def contamination(text, items):
    """items: {item_id: text}."""
    w = TOKEN.findall(low(text or ""))
    hit, found = set(), set()
    for item, t in items.items():
        v = TOKEN.findall(low(t or ""))
        for win in {tuple(v[i : i + 13]) for i in range(max(1, len(v) - 12))} if v else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def removed(docs, n=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of {doc_id: text}: bytes covered by an n-byte string that also starts earlier."""
    first, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in first:
                gone[i : i + n] = b"\1" * n
            first.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def held_out(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod == 2
