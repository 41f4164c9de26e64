"""Operator 6: language identification by interpolated Kneser-Ney character models.

A language's model gives the probability of each character from the up to ORDER - 1 characters before it, within a
word padded with blanks (white space and non-letters end words). Its n-grams stand in one sorted array of hashes with
their log-probabilities for all languages beside it, so that a lookup is a binary search. A text gets the language of
the lowest cross-entropy per character.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash60

#: n-gram length; discount of the Kneser-Ney estimates.
ORDER, DISCOUNT = 5, 0.75
#: Documents of a language that its model is fitted on, about: those with the least hashes, taken whole.
TRAINING_DOCUMENTS = 400

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The lower-case words of a text: its runs of letters."""
    return _WORD.findall(text.lower())


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place of an array of code points; 0 pads the front."""
    h = np.full(len(codes), 1469598103934665603 + n, np.uint64)
    for k in range(n - 1, -1, -1):
        c = np.concatenate([np.zeros(k, np.uint64), codes[: len(codes) - k]]) if k else codes
        h = (h ^ (c + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _spelled(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``" word "`` after ORDER - 1 zeros each, and each place's word (-1 on the zeros and the first blank)."""
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer("".join(f"{pad} {w} " for w in vocabulary).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + ORDER + 1
    owner = np.repeat(np.arange(len(vocabulary)), length)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    return codes, np.where(offset < ORDER, -1, owner)


class Model:
    """Fitted on {language: Counter of words}. ``log2[i]``: bits of the n-gram ``keys[i]`` in each language."""

    def __init__(self, corpora: dict[str, Counter]):
        self.languages = sorted(corpora)
        each = [self._fit(corpora[x]) for x in self.languages]
        alphabet = max((len(a) for a, _ in each), default=1) + 1
        self.floor = np.log2(1 / alphabet) - 6
        self.keys, self.bits, self.back = [], [], []
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([levels[n - 1][0] for _, levels in each] or [np.zeros(0, np.uint64)]))
            p = np.zeros((len(keys), len(each)))
            seen = np.zeros((len(keys), len(each)), bool)
            for j, (_, levels) in enumerate(each):
                at = np.searchsorted(keys, levels[n - 1][0])
                p[at, j], seen[at, j] = levels[n - 1][1], True
            self.keys.append(keys)
            self.bits.append(np.where(seen, np.log2(np.maximum(p, 1e-12)), np.nan))
            contexts = np.unique(np.concatenate([levels[n - 1][2] for _, levels in each] or [np.zeros(0, np.uint64)]))
            g = np.zeros((len(contexts), len(each)))  # log2 of the weight of the shorter context; 0 if the context is unseen
            for j, (_, levels) in enumerate(each):
                g[np.searchsorted(contexts, levels[n - 1][2]), j] = np.log2(levels[n - 1][3])
            self.back.append((contexts, g))

    @staticmethod
    def _fit(counts: Counter):
        """The alphabet, and for each order (n-gram hashes, interpolated probabilities, context hashes, back-off weights)."""
        vocabulary = sorted(counts)
        codes, owner = _spelled(vocabulary)
        weight = np.array([counts[w] for w in vocabulary], np.float64)
        inside = owner >= 0
        alphabet = np.unique(codes[inside])
        grams = [_grams(codes, n) for n in range(1, ORDER + 1)]
        before = [np.concatenate([[np.uint64(0)], _grams(codes, n)[:-1]]) if n else np.zeros(len(codes), np.uint64) for n in range(ORDER)]
        levels, lower = [], None
        for n in range(1, ORDER + 1):
            keys, first, inverse = np.unique(grams[n - 1][inside], return_index=True, return_inverse=True)
            if n == ORDER:
                c = np.bincount(inverse, weight[owner[inside]], len(keys))
            else:  # continuation counts: the different characters before the n-gram
                longer = np.unique(grams[n][inside], return_index=True)[1]
                c = np.bincount(inverse[longer], minlength=len(keys)).astype(np.float64)
            contexts, of = np.unique(before[n - 1][inside][first], return_inverse=True)
            total = np.bincount(of, c, len(contexts))
            discount = np.minimum(DISCOUNT, c)
            back = np.maximum(np.bincount(of, discount, len(contexts)) / np.maximum(total, 1e-12), 1e-6)
            shorter = np.full(len(keys), 1 / (len(alphabet) + 1)) if lower is None else lower[1][np.searchsorted(lower[0], grams[n - 2][inside][first])]
            p = (c - discount) / total[of] + back[of] * shorter
            levels.append((keys, p, contexts, back))
            lower = keys, p
        return alphabet, levels

    def word_bits(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and its characters, the closing blank included."""
        codes, owner = _spelled(vocabulary)
        place = np.flatnonzero(owner >= 0)
        logp = np.full((len(place), len(self.languages)), np.nan)
        weight = np.zeros_like(logp)
        open_ = np.ones(len(place), bool)
        for n in range(ORDER, 0, -1):
            todo = np.flatnonzero(open_)
            if not len(todo):
                break
            key = _grams(codes, n)[place[todo]]
            at = np.minimum(np.searchsorted(self.keys[n - 1], key), max(len(self.keys[n - 1]) - 1, 0))
            hit = self.keys[n - 1][at] == key if len(self.keys[n - 1]) else np.zeros(len(todo), bool)
            found = np.where(hit[:, None], self.bits[n - 1][at] if len(self.keys[n - 1]) else np.nan, np.nan)
            use = np.isnan(logp[todo]) & ~np.isnan(found)
            logp[todo] = np.where(use, found + weight[todo], logp[todo])
            rest = np.isnan(logp[todo])
            contexts, g = self.back[n - 1]
            if n > 1 and len(contexts):
                ctx = _grams(codes, n - 1)[place[todo] - 1]
                c = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
                step = np.where((contexts[c] == ctx)[:, None], g[c], 0.0)
                weight[todo] += np.where(rest, step, 0.0)
            open_[todo] = rest.any(1)
        logp = np.where(np.isnan(logp), self.floor + weight, logp)
        sums = np.zeros((len(vocabulary), len(self.languages)))
        np.add.at(sums, owner[place], -logp) if len(vocabulary) < 64 else sums.__setitem__(slice(None), np.add.reduceat(-logp, np.searchsorted(owner[place], np.arange(len(vocabulary)))))
        return sums, np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 1


class Identifier:
    """A model with a calibrated score and rejection level."""

    def __init__(self, model: Model, scale: float, reject_above: float):
        self.model, self.scale, self.reject_above = model, scale, reject_above

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, bits per character and rejections."""
        split = [words(x) if x else [] for x in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        index: dict[str, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for x in split for w in x), np.int64, int(n.sum()))
        lang, score, entropy = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        full = np.flatnonzero(n)
        if len(full) and self.model.languages:
            bits, chars = self.model.word_bits(list(index))
            starts = (np.cumsum(n) - n)[full]
            per = np.add.reduceat(bits[at], starts) / np.add.reduceat(chars[at], starts)[:, None]
            best = per.argmin(1)
            least = per[np.arange(len(full)), best]
            entropy[full] = least
            # A softmax of the cross-entropies; the scale is fitted on training documents.
            score[full] = 1 / np.exp2(-(per - least[:, None]) * self.scale).sum(1)
            for i, b in zip(full.tolist(), best.tolist(), strict=True):
                lang[i] = self.model.languages[b]
        return lang, score, entropy, (entropy > self.reject_above) & (n > 0)


def calibrate(model: Model, texts: list[str], langs: list[str]) -> Identifier:
    """Scale of the scores by the likelihood of the labels, on training documents that the model has not seen; the
    rejection level is beyond all but a thousandth of their cross-entropies, plus a margin."""
    best, plain = (np.inf, 1.0), Identifier(model, 1.0, np.inf)
    split = [(t, x) for t, x in zip(texts, langs, strict=True) if words(t)]
    if not split:
        return plain
    _, _, entropy, _ = plain.predict([t for t, _ in split])
    for scale in (1.0, 2.0, 4.0, 8.0, 16.0):
        lang, score, _, _ = Identifier(model, scale, np.inf).predict([t for t, _ in split])
        p = np.where([a == b for a, (_, b) in zip(lang, split, strict=True)], score, 1 - score)
        best = min(best, (float(-np.log(np.clip(p, 1e-6, 1 - 1e-6)).sum()), scale))
    return Identifier(model, best[1], float(np.quantile(entropy, 0.999)) + 0.5)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAINING_DOCUMENTS) -> Identifier:
    """Fits on a bounded sample of the labelled rows: of each language the documents whose hash is among the least,
    some ``per_language``, each whole. A fifth of them calibrates. Rows with a null language, null text or no letter
    take no part."""
    lang = F.col(lang_col).cast("string")
    rows = docs.where(lang.isNotNull() & F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"), hash60(F.col(id_col), "lang:").alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    least = {r["lang"]: int(min(1.0, per_language / r["n"]) * (1 << 60)) for r in sizes}
    if not least:
        return Identifier(Model({}), 1.0, np.inf)
    limits = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    sample = sorted((r["lang"], r["h"], r["text"]) for r in rows.where(F.col("h") < limits[F.col("lang")]).collect())
    corpora: dict[str, Counter] = {}
    check: list[tuple[str, str]] = []
    for i, (x, _, text) in enumerate(sample):
        if i % 5 == 4:
            check.append((text, x))
        elif found := words(text):
            corpora.setdefault(x, Counter()).update(found)
    return calibrate(Model(corpora), [t for t, _ in check], [x for _, x in check])


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_char, rejected) of each row, from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. rejected marks texts that no
    learned language fits by the calibrated level; lang_pred still names the nearest. Ties go to the first language.
    """
    model = docs.sparkSession.sparkContext.broadcast(identifier)  # bounded by the training sample

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                lang, score, bits, out = model.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(bits), pa.array(out)], ["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, bits_per_char double, rejected boolean"
    return rows.mapInArrow(run, kind)
