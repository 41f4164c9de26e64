"""Operator 3: quality rules with adaptive thresholds. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

SYMBOLS = "#*$%&|<>"
#: A group's sketch is joined by this many documents' worth, at most, of its language's and of all documents'. Sketches
#: count in units of 1 / UNIT documents, so that shares of them stay whole numbers.
BORROWED, UNIT = 100, 1000


@dataclass(frozen=True)
class Rule:
    """A measure's fence, on the logarithmic cells of its sketch: ``median + spread * (distance from the median to the
    quartile on the other side)``, or below it for a lower fence.

    The quartile on the side away from the fence is used, so junk, which lies beyond the fence, does not widen it even
    where it is a quarter of a group. Nothing is added: on a logarithmic scale the fence is the median times a power of
    its ratio to the quartile.
    """

    measure: str
    spread: int
    upper: bool


#: Cells of a sketch for a factor of e in the measure.
STEPS = {"symbols": 50, "repeated_lines": 50, "word_length": 400}
RULES = (Rule("symbols", 6, True), Rule("repeated_lines", 6, True), Rule("word_length", 8, True), Rule("word_length", 8, False))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), lambda w: w != "")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words. The repeated words are found in the row: the 5-word windows are hashed (64 bits); if all
    differ, none repeats. Otherwise the windows are sorted with their places, equal neighbours give the places of the
    windows found twice or more, and the words covered by them are counted.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = docs.withColumns(
        {
            "_hash": F.transform(_words(text), lambda w: F.xxhash64(w)),
            "word_chars": F.length(blank).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_n_lines": F.size(lines),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    h = F.col("_hash")
    at = lambda i: F.get(h, i)
    out = out.withColumns({"n_words": F.size(h).cast("long"), "_window": F.when(F.size(h) > 5, F.transform(F.slice(h, 1, F.size(h) - 4), lambda x, i: F.xxhash64(x, at(i + 1), at(i + 2), at(i + 3), at(i + 4))))})
    window = F.col("_window")
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct(window)) < F.size(window), F.array_sort(F.transform(window, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
    out = out.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    a = F.col("_at")
    covered = F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(a, i + 1) - x, F.lit(5)))), F.lit(0), lambda acc, x: acc + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_hash", "_window", "_sorted", "_at")


def _cell(name: str) -> Column:
    """The sketch's cell of a document's measure: symbols by characters, repeated lines by other lines, characters by
    words; one is added to both counts of the first two, as a text without symbols has some share of them too."""
    n, d = {
        "symbols": (F.col("n_symbols") + 1, F.col("word_chars") + 1),
        "repeated_lines": (F.col("n_dup_lines") + 1, F.col("_n_lines") - F.col("n_dup_lines") + 1),
        "word_length": (F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))),
    }[name]
    return F.floor(F.ln(n.cast("double") / d.cast("double")) * STEPS[name]).cast("long")


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """A quantile sketch per group and measure: (*group, measure, cell, n), counts over a logarithmic grid of cells.

    Grid counts merge by adding, so partial sketches are built before the shuffle and a group of any size ends as a row
    for each cell that occurs, however large the values; quantiles are exact to one cell, and reruns agree.
    """
    cells = F.array(*(F.struct(F.lit(m).alias("measure"), _cell(m).alias("cell")) for m in STEPS))
    # Documents that the base rules reject do not shape the thresholds.
    return measured.where(~F.col("base_failed")).select(*group, F.explode(cells).alias("x")).groupBy(*group, "x.measure", "x.cell").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, q1, q2, q3) of the cells of (*by, cell, n)."""
    from pyspark.sql import Window as W

    upto = F.sum("n").over(W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    ranked = sketch.withColumns({"_upto": upto, "_all": F.sum("n").over(W.partitionBy(*by))})
    return ranked.groupBy(*by).agg(*(F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("cell"))).alias(f"q{k}") for k in (1, 2, 3)))


def thresholds(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, one fence column a rule, in cells) from the merged sketches (lang, source, measure, cell, n).

    A group borrows up to BORROWED documents' worth of its language's sketch and as much of all documents', which decide
    where the group has few documents of its own. A quartile's distance is at least that in the language, in case a
    group's values are all but one; if that is none, that in all documents, and one cell in the end.
    """
    sketch = stored(sketch)  # a row a group, measure and cell
    wider = {"l": [lang, "measure"], "a": ["measure"]}
    groups = sketch.select(lang, source, "measure").distinct()
    mixed = sketch.withColumn("n", F.col("n") * UNIT)
    found = {}
    for k, by in wider.items():
        whole = sketch.groupBy(*by, "cell").agg(F.sum("n").alias("n"))
        found[k] = _quartiles(whole, by).select(*by, (F.col("q2") - F.col("q1")).alias(f"{k}_down"), (F.col("q3") - F.col("q2")).alias(f"{k}_up"))
        size = sketch.groupBy(*by).agg(F.sum("n").alias("_size"))
        lent = whole.join(size, by).withColumn("n", F.expr(f"(n * {UNIT} * least({BORROWED}L, _size)) div _size"))
        mixed = mixed.unionByName(groups.join(lent, by).select(lang, source, "measure", "cell", "n"))
    by = [lang, source, "measure"]
    q = _quartiles(mixed.groupBy(*by, "cell").agg(F.sum("n").alias("n")), by).join(found["l"], wider["l"]).join(found["a"], wider["a"])
    none = lambda x: F.nullif(x, F.lit(0))
    down = F.coalesce(none(F.greatest(F.col("q2") - F.col("q1"), F.col("l_down"))), none(F.col("a_down")), F.lit(1))
    up = F.coalesce(none(F.greatest(F.col("q3") - F.col("q2"), F.col("l_up"))), none(F.col("a_up")), F.lit(1))
    fence = [F.max(F.when(F.col("measure") == r.measure, F.col("q2") + r.spread * down if r.upper else F.col("q2") - r.spread * up)).alias(f"_fence{i}") for i, r in enumerate(RULES)]
    return q.groupBy(lang, source).agg(*fence)


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, base_failed and kept.

    kept is false if base_failed, else if a measure lies beyond its language's and source's fence. Null languages and
    sources are groups of their own. Null and empty texts have no words and fail the base rules, which judge texts of any
    length whole. Repeated rows are counted and judged each; an empty table gives no rows. Columns of ``docs`` that are
    named like a result, or start with an underscore and are named like a working column, are replaced.

    The measures are worked out once and written to the shared folder with the documents (without their texts if
    keep_text is false), as both the sketches and the verdicts need them.
    """
    measured = measures(docs, text_col)
    measured = stored(measured if keep_text else measured.drop(text_col))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    measured = measured.withColumns({"_lang": key(lang_col), "_source": key(source_col)})
    fence = thresholds(sketches(measured, ["_lang", "_source"]), "_lang", "_source")
    joined = measured.join(fence, ["_lang", "_source"], "left")
    beyond = F.lit(False)
    for i, r in enumerate(RULES):
        v, f = _cell(r.measure), F.col(f"_fence{i}")
        beyond = beyond | F.coalesce((v > f) if r.upper else (v < f), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_lang", "_source", "_n_lines", *(f"_fence{i}" for i in range(len(RULES))))
