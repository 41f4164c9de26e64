"""Business rules found in the data, each with its conformity, its violations and examples."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import date_kinds, key_string, number
from ..settings import DEFAULT, Settings
from .columns import ratio
from .tables import _chunked


def date_order(df: DataFrame, columns: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(rule, n, n_violations, conformity): ``a <= b`` in 95 % of 20 rows or more; the first direction that holds."""

    def one(p):
        a, b = F.col(p[0]), F.col(p[1])
        return F.struct(F.lit(p[0]).alias("a"), F.lit(p[1]).alias("b"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), F.count_if(a > b).alias("up"), F.count_if(a < b).alias("down"))

    out = _chunked(df, list(combinations(columns, 2)), one).where(F.col("n") >= s.rule_rows)
    most = (1 - s.rule_conformity) * F.col("n") + 1e-9
    bad = F.when(F.col("up") <= most, F.col("up")).when(F.col("down") <= most, F.col("down"))
    rule = F.when(F.col("up") <= most, F.concat("a", F.lit(" <= "), "b")).otherwise(F.concat("b", F.lit(" <= "), "a"))
    return out.where(bad.isNotNull()).select(rule.alias("rule"), "n", bad.alias("n_violations"), ratio(F.col("n") - bad, F.col("n")).alias("conformity"))


def conditional_nullity(df: DataFrame, targets: list[str], conditions: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(target, condition, filled_in, empty_in): a column filled just where a category has some of its levels."""
    pairs = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(c).alias("condition"), key_string(df, c).alias("level"), F.col(t).isNotNull().alias("f")) for t in targets for c in conditions if t != c))
    by = df.select(F.inline(pairs)).groupBy("target", "condition", "level").agg(F.count("*").alias("n"), F.count_if("f").alias("k"))
    always, never = F.col("k") >= s.rule_conformity * F.col("n"), F.col("k") <= (1 - s.rule_conformity) * F.col("n") + 1e-9
    real = F.col("level").isNotNull()
    names = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag & real, F.col("level")))), ", ")
    out = by.groupBy("target", "condition").agg(names(always).alias("filled_in"), names(never).alias("empty_in"), F.count_if(real).alias("levels"), F.count_if(real & always).alias("a"), F.count_if(real & never).alias("z"), (1 - F.sum("k") / F.sum("n")).alias("nulls"))
    return out.where("levels >= 2 AND levels <= 25 AND a > 0 AND z > 0 AND a + z = levels AND nulls > 0.1 AND nulls < 0.95").select("target", "condition", "filled_in", "empty_in")


#: How a column may follow from two others: name, formula, whether the order of the two matters.
FORMULAS = (
    ("{a} + {b}", lambda a, b: a + b, False),
    ("{a} - {b}", lambda a, b: a - b, True),
    ("{a} * {b}", lambda a, b: a * b, False),
    ("{a} / {b}", lambda a, b: F.try_divide(a, b), True),
    ("{a} * {b} / 100", lambda a, b: a * b / 100, False),
    ("{a} * (1 - {b})", lambda a, b: a * (1 - b), True),
    ("{a} * (1 - {b} / 100)", lambda a, b: a * (1 - b / 100), True),
)


def arithmetic_derivation(df: DataFrame, columns: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(target, formula, n, n_violations, conformity): the best formula of two other columns for each column.

    All trios are tried in one pass. Sums and differences with a column that is zero throughout are left out. The
    tolerance is one part in a million. A target's formulas rank by conformity, then in the order tried.
    """
    tried = []
    for t in columns:
        others = [c for c in columns if c != t]
        for i, (name, f, ordered) in enumerate(FORMULAS):
            for a, b in permutations(others, 2) if ordered else combinations(others, 2):
                tried.append((t, name.format(a=a, b=b), f, a, b, i))
    cells = df.select(*(number(df, c).alias(c) for c in columns))
    zero = cells.agg(*(F.coalesce(F.bool_and(F.col(c) == 0), F.lit(True)).alias(c) for c in columns)).first()
    tried = [x for x in tried if not (x[5] < 2 and (zero[x[3]] or zero[x[4]]))]

    def one(x):
        t, name, f, a, b, _ = x
        y, p = F.col(t), f(F.col(a), F.col(b))
        return F.struct(F.lit(t).alias("target"), F.lit(name).alias("formula"), F.lit(tried.index(x)).alias("k"), F.count_if(y.isNotNull() & p.isNotNull()).alias("n"), F.count_if(F.abs(y - p) > 1e-9 + 1e-6 * F.abs(p)).alias("n_violations"))

    out = _chunked(cells, tried, one).where((F.col("n") >= s.rule_rows) & (F.col("n_violations") <= (1 - s.rule_conformity) * F.col("n")))
    best = out.groupBy("target").agg(F.min(F.struct((F.col("n_violations") / F.col("n")).alias("share"), "k", "formula", "n", "n_violations")).alias("b"))
    return best.select("target", "b.formula", "b.n", "b.n_violations", ratio(F.col("b.n") - F.col("b.n_violations"), F.col("b.n")).alias("conformity"))


def range_rules(df: DataFrame, limits: dict[str, tuple[float | None, float | None]], s: Settings = DEFAULT) -> DataFrame:
    """(column, lo, hi, n, n_violations, conformity, holds) of ``lo <= column <= hi``."""

    def one(c):
        lo, hi = limits[c]
        x = number(df, c)
        bad = F.lit(False) if lo is None else x < lo
        bad = bad | (F.lit(False) if hi is None else x > hi)
        return F.struct(F.lit(c).alias("column"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.count(x).alias("n"), F.count_if(bad).alias("n_violations"))

    out = _chunked(df, list(limits), one)
    return out.withColumn("conformity", ratio(F.col("n") - F.col("n_violations"), F.col("n"))).withColumn("holds", (F.col("n") >= s.rule_rows) & (F.col("n_violations") <= (1 - s.rule_conformity) * F.col("n")))


#: Words of a column's name, and the limits that such a column should keep.
DOMAIN_LIMITS = ((("estoque", "stock", "inventory"), (0.0, None)), (("idade", "age"), (0.0, 130.0)), (("desconto", "discount"), (0.0, None)))


def _words(name: str) -> set[str]:
    import re

    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", name)}


def domain_limits(columns: list[str], as_of_year: int) -> dict[str, tuple[float | None, float | None]]:
    """Limits of stock, ages, discounts and reference years, by the words of the columns' names."""
    out: dict[str, tuple[float | None, float | None]] = {}
    for c in columns:
        words = _words(c)
        out |= next(({c: limit} for names, limit in DOMAIN_LIMITS if words & set(names)), {})
        if words & {"ano", "year"}:
            out[c] = (1900.0, float(as_of_year + 1))
    return out


def domain_rules(df: DataFrame, as_of_year: int, s: Settings = DEFAULT) -> DataFrame:
    """Range rules by name, and discount not above gross value, resolution not after its deadline.

    (rule, n, n_violations, conformity)."""
    limits = domain_limits([c for c in df.columns if c not in date_kinds(df)], as_of_year)
    found = lambda *names: [c for c in df.columns if _words(c) & set(names)]
    pairs = [(a, b) for a in found("desconto", "discount") for b in found("bruto", "gross")] + [(a, b) for a in found("resolucao", "resolution") for b in found("sla", "deadline", "prazo") if a != b]
    parts = []
    if limits:
        r = range_rules(df, limits, s)
        rule = F.concat_ws(" ", F.col("lo").cast("decimal(18,1)").cast("string"), F.when(F.col("lo").isNotNull(), F.lit("<=")), "column", F.when(F.col("hi").isNotNull(), F.lit("<=")), F.col("hi").cast("decimal(18,1)").cast("string"))
        parts.append(r.select(rule.alias("rule"), "n", "n_violations", "conformity"))
    if pairs:

        def one(p):
            a, b = F.col(p[0]), F.col(p[1])
            return F.struct(F.concat(F.lit(p[0]), F.lit(" <= "), F.lit(p[1])).alias("rule"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), F.count_if(a > b).alias("n_violations"))

        parts.append(_chunked(df, pairs, one).withColumn("conformity", ratio(F.col("n") - F.col("n_violations"), F.col("n"))))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, n long, n_violations long, conformity double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def violations(df: DataFrame, condition: Column, n: int = 3) -> DataFrame:
    """Some rows for which a rule does not hold."""
    return df.where(~condition).limit(n)
