"""Operators across the columns of one table: duplicates, keys, dependencies, redundancy, association, time series.

Pairs of columns are worked out in one aggregation a pass, in chunks that keep the generated code small.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import key_string, number
from ..functions.ranges import range_id
from ..settings import DEFAULT, Settings
from .columns import numeric_columns, ratio, text_columns

#: Expressions in one aggregation.
CHUNK = 120


def _chunked(df: DataFrame, items: list, one) -> DataFrame:
    """inline(array(one(item) for each item)), a chunk of items an aggregation."""
    parts = [df.agg(F.array(*(one(x) for x in items[i : i + CHUNK])).alias("x")).select(F.inline("x")) for i in range(0, len(items), CHUNK)]
    return reduce(DataFrame.unionByName, parts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, n_extra, n_groups, pct_extra): copies beyond the first, and rows that have copies."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("c"))
    out = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_extra"), F.count_if(F.col("c") > 1).alias("n_groups"))
    return out.withColumn("pct_extra", ratio(F.col("n_extra"), F.col("n_rows")))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*keys, *(F.col("r").getField(c).alias(c) for c in rest))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Distinct values of each column, null not counted: a row a column is collected."""
    columns = columns or df.columns
    return dict(zip(columns, _distinct(df, [(c,) for c in columns], nulls=False), strict=True))


def _distinct(df: DataFrame, sets: list[tuple[str, ...]], nulls: bool = True) -> list[int]:
    """Distinct tuples of each set of columns, counted by one aggregation with map-side combining."""
    if not sets:
        return []
    keys = lambda c: F.array(*(key_string(df, x) for x in c))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), keys(c).alias("k")) for i, c in enumerate(sets)))
    cells = df.select(F.inline(pairs))
    if not nulls:
        cells = cells.where(F.col("k")[0].isNotNull())
    found = {r["i"]: r["n"] for r in cells.groupBy("i", "k").agg(F.lit(1).alias("_")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    return [found.get(i, 0) for i in range(len(sets))]


def _sketched(df: DataFrame, sets: list[tuple[str, ...]]) -> list[int]:
    """About the distinct tuples of each set of columns (deviation 1 %), from sketches of fixed size."""
    out: list[int] = []
    for i in range(0, len(sets), CHUNK):
        out += list(df.agg(*(F.approx_count_distinct(F.struct(*(key_string(df, x).alias(x) for x in c)), 0.01).alias(f"k{k}") for k, c in enumerate(sets[i : i + CHUNK]))).first())
    return out


#: Six deviations of a sketch: no set that could pass is left out on its account.
_SLACK = 0.06


def composite_keys(df: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """(key, size, n_rows, n_distinct): minimal sets of two, else three columns that name each row.

    Only where no single column does. Pairs of the eight columns with most values, then triples of the first six; sets
    whose cardinalities cannot reach the row count, or that hold a key already, are left out.
    """
    columns = columns or df.columns
    spark, n = df.sparkSession, df.count()
    kind = "key string, size int, n_rows long, n_distinct long"
    card = distinct_counts(df, columns)
    if not n or max(card.values()) >= n:
        return spark.createDataFrame([], kind)
    ranked = sorted((c for c in columns if card[c] > 1), key=lambda c: (-card[c], columns.index(c)))[:8]
    for size, pool in ((2, ranked), (3, ranked[:6])):
        tried = [c for c in combinations(pool, size) if reduce(lambda a, b: a * b, (card[x] for x in c)) >= n]
        if not tried:
            continue
        tried = [c for c, k in zip(tried, _sketched(df, tried), strict=True) if k >= (1 - _SLACK) * n]
        if found := [(", ".join(c), size, n, k) for c, k in zip(tried, _distinct(df, tried), strict=True) if k == n][:most]:
            return spark.createDataFrame(found, kind)
    return spark.createDataFrame([], kind)


def functional_dependencies(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(determinant, dependent, kind): exact dependencies, null being a value; both ways at once is an equivalence.

    Sketches rule out nearly all pairs; the rest are counted exactly.
    """
    columns = columns or df.columns
    n = df.count()
    card = dict(zip(columns, _distinct(df, [(c,) for c in columns]), strict=True))
    usable = [c for c in columns if 1 < card[c] < s.fd_max_distinct and card[c] < s.fd_max_uniqueness * n]
    pairs = list(combinations(usable, 2))
    few = [p for p, k in zip(pairs, _sketched(df, pairs), strict=True) if k <= (1 + _SLACK) * max(card[x] for x in p)]
    rows = []
    for (a, b), k in zip(few, _distinct(df, few), strict=True):
        if k in (card[a], card[b]):
            first, second = (a, b) if k == card[a] else (b, a)
            rows.append((first, second, "equivalence" if card[a] == card[b] else "direct"))
    return df.sparkSession.createDataFrame(rows, "determinant string, dependent string, kind string")


def hierarchies(dependencies: list[tuple[str, str, str]]) -> list[list[str]]:
    """Chains of three levels or more: the transitive reduction of the dependencies, equivalent columns as one level."""
    level: dict[str, str] = {}

    def name(x: str) -> str:
        while level.get(x, x) != x:
            x = level[x]
        return x

    for a, b, kind in dependencies:
        if kind == "equivalence":
            x, y = sorted((name(a), name(b)))
            level[y] = x
    up: dict[str, set[str]] = {}
    for a, b, kind in dependencies:
        if kind == "direct" and name(a) != name(b):
            up.setdefault(name(a), set()).add(name(b))
    near = {a: {b for b in bs if not any(b in up.get(m, ()) for m in bs if m != b)} for a, bs in up.items()}
    roots = sorted(set(near) - {b for bs in near.values() for b in bs})
    chains: list[list[str]] = []

    def walk(path: list[str]) -> None:
        nexts = sorted(near.get(path[-1], ()))
        if not nexts and len(path) >= 3:
            chains.append(path)
        for x in nexts:
            walk([*path, x])

    for r in roots:
        walk([r])
    return chains


def hierarchy_levels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(chain, level, column)."""
    found = [(r["determinant"], r["dependent"], r["kind"]) for r in functional_dependencies(df, columns).collect()]
    rows = [(i + 1, k + 1, c) for i, chain in enumerate(hierarchies(found)) for k, c in enumerate(chain)]
    return df.sparkSession.createDataFrame(rows, "chain int, level int, column string")


def identical_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b): equal in every row, null equal to null. Sums of hashes choose the pairs that are compared."""
    columns = columns or df.columns
    row = df.agg(*(F.sum(F.xxhash64(key_string(df, c)).cast("decimal(38,0)")).alias(f"h{i}") for i, c in enumerate(columns))).first()
    pairs = [(columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2) if row[i] == row[j]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string")
    out = _chunked(df, pairs, lambda p: F.struct(F.lit(p[0]).alias("col_a"), F.lit(p[1]).alias("col_b"), F.bool_and(key_string(df, p[0]).eqNullSafe(key_string(df, p[1]))).alias("same")))
    return out.where("same").drop("same")


def near_identical_columns(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(col_a, col_b, n_compared, n_divergent, agreement): columns of one type and like cardinality that agree in most
    rows where both are filled, but not in all."""
    columns, kinds = columns or df.columns, dict(df.dtypes)
    card = distinct_counts(df, columns)
    pairs = [(a, b) for a, b in combinations(columns, 2) if kinds[a] == kinds[b] and min(card[a], card[b]) > 1 and min(card[a], card[b]) >= 0.9 * max(card[a], card[b])]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n_compared long, n_divergent long, agreement double")

    def one(p):
        a, b = key_string(df, p[0]), key_string(df, p[1])
        return F.struct(F.lit(p[0]).alias("col_a"), F.lit(p[1]).alias("col_b"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n_compared"), F.count_if(a != b).alias("n_divergent"))

    out = _chunked(df, pairs, one).withColumn("agreement", ratio(F.col("n_compared") - F.col("n_divergent"), F.col("n_compared")))
    return out.where((F.col("n_divergent") > 0) & (F.col("n_compared") > 0) & (F.col("n_divergent") <= (1 - s.partial_redundancy) * F.col("n_compared")))


# --- association -------------------------------------------------------------


def pearson_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, n, r), pairwise complete."""
    columns = columns or numeric_columns(df)

    def one(p):
        a, b = number(df, p[0]), number(df, p[1])
        both = a.isNotNull() & b.isNotNull()
        return F.struct(F.lit(p[0]).alias("col_a"), F.lit(p[1]).alias("col_b"), F.count_if(both).alias("n"), F.corr(F.when(both, a), F.when(both, b)).alias("r"))

    return _chunked(df, list(combinations(columns, 2)), one)


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column replaced by the average rank of its values among the filled ones.

    Ranks come from counts a value, ranged by value and added up over ranges, not from a sort of all rows in a task.
    """
    out = df
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
        part = counts.withColumn("_p", range_id(df.select(F.col(c).alias("_v")), "_v"))
        run = part.withColumn("_run", F.sum("_n").over(W.partitionBy("_p").orderBy("_v")))
        base = run.groupBy("_p").agg(F.sum("_n").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
        ranks = run.join(F.broadcast(base), "_p").select("_v", (F.col("_b") + F.col("_run") - (F.col("_n") - 1) / 2.0).alias(f"_r_{c}"))
        out = out.join(ranks, F.col(c) == F.col("_v"), "left").drop("_v")
    return out.select(*(F.col(f"_r_{c}").alias(c) for c in columns))


def spearman_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, n, r) of the ranks; rows with a null in a pair are ranked in their columns but not compared."""
    columns = columns or numeric_columns(df)
    cells = df.select(*(number(df, c).alias(c) for c in columns))
    return pearson_pairs(average_ranks(cells, columns), columns)


def correlations(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(col_a, col_b, n, r, strength): pairs of 30 rows or more with |r| of 0.7 or more."""
    out = pearson_pairs(df, columns).where((F.col("n") >= s.correlation_rows) & (F.abs("r") >= s.correlation))
    return out.withColumn("strength", F.when(F.abs("r") >= s.strong_correlation, "strong").otherwise("moderate"))


def cramers_v(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, n, v) from the contingency table of each pair of columns."""
    columns = columns or text_columns(df)
    parts = []
    pairs = F.array(*(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), key_string(df, a).alias("a"), key_string(df, b).alias("b")) for a, b in combinations(columns, 2)))
    cells = df.select(F.inline(pairs)).where("a IS NOT NULL AND b IS NOT NULL").groupBy("col_a", "col_b", "a", "b").agg(F.count("*").alias("n"))
    pair = ["col_a", "col_b"]
    by_a = cells.groupBy(*pair, "a").agg(F.sum("n").alias("na"))
    by_b = cells.groupBy(*pair, "b").agg(F.sum("n").alias("nb"))
    levels = by_a.groupBy(*pair).agg(F.count("*").alias("ka"), F.sum("na").alias("total")).join(by_b.groupBy(*pair).agg(F.count("*").alias("kb")), pair)
    # Sum over the cells that occur; absent ones add their expected count, which is the total less the sum of the others.
    grid = cells.join(by_a, [*pair, "a"]).join(by_b, [*pair, "b"]).join(levels, pair)
    e = F.col("na") * F.col("nb") / F.col("total")
    chi = grid.groupBy(*pair, "ka", "kb", "total").agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("x"), F.sum(e).alias("e"))
    v = F.sqrt((F.col("x") + F.greatest(F.lit(0.0), F.col("total") - F.col("e"))) / (F.col("total") * (F.least("ka", "kb") - 1)))
    parts.append(chi.where("ka > 1 AND kb > 1").select(*pair, F.col("total").alias("n"), v.alias("v")))
    return parts[0]


def correlation_ratio(df: DataFrame, categories: list[str], measures: list[str]) -> DataFrame:
    """(category, measure, n_levels, eta2): the share of a measure's variance that lies between a category's levels."""
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(m).alias("measure"), key_string(df, c).alias("level"), number(df, m).alias("y")) for c in categories for m in measures))
    cells = df.select(F.inline(pairs)).where("y IS NOT NULL").groupBy("category", "measure", "level").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    w = W.partitionBy("category", "measure")
    mean = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    known = cells.withColumn("grand", mean).withColumn("inside", F.col("n") * F.col("v")).withColumn("between", F.col("n") * (F.col("m") - F.col("grand")) ** 2)
    hit = F.col("level").isNotNull()
    out = known.groupBy("category", "measure").agg(F.count_if(hit).alias("n_levels"), F.sum(F.when(hit, F.col("between"))).alias("b"), F.sum(F.col("inside") + F.col("between")).alias("t"))
    return out.select("category", "measure", "n_levels", F.coalesce(F.try_divide("b", "t"), F.lit(0.0)).alias("eta2"))


def measure_drivers(df: DataFrame, categories: list[str], measures: list[str], top: int = 3, least: float = 0.1, s: Settings = DEFAULT) -> DataFrame:
    """(measure, category, eta2, rnk): the three attributes that explain most of each measure, where the best explains a tenth."""
    out = correlation_ratio(df, categories, measures).where(F.col("n_levels").between(2, s.max_levels))
    w = W.partitionBy("measure").orderBy(F.desc("eta2"), "category")
    out = out.withColumn("rnk", F.row_number().over(w)).withColumn("best", F.max("eta2").over(W.partitionBy("measure")))
    return out.where((F.col("rnk") <= top) & (F.col("best") >= least)).select("measure", "category", "eta2", "rnk")


# --- time series -------------------------------------------------------------


def _period(column: str, grain: str) -> Column:
    c = F.col(column)
    if grain == "week":  # named by the Sunday that ends it
        return F.next_day(F.date_sub(c.cast("date"), 1), "SUN")
    return F.date_trunc(grain, c).cast("date")


def time_series(df: DataFrame, date: str, measures: dict[str, str], grain: str = "day") -> DataFrame:
    """(period, n, each measure): sums or means by day, week (ending on Sunday) or month. measures: {column: sum or avg}."""
    ops = {"sum": F.sum, "avg": F.avg}
    aggs = [ops[op](number(df, c).cast("decimal(28,6)")).cast("double").alias(c) for c, op in measures.items()]
    return df.where(F.col(date).isNotNull()).groupBy(_period(date, grain).alias("period")).agg(F.count("*").alias("n"), *aggs)


def best_grain(df: DataFrame, date: str, least: int = DEFAULT.adf_rows) -> str | None:
    """The first of day, week and month with enough periods."""
    row = df.agg(*(F.count_distinct(_period(date, g)).alias(g) for g in ("day", "week", "month"))).first()
    return next((g for g in ("day", "week", "month") if row[g] >= least), None)


#: Words of a column's name that make it a better or worse reference date.
DATE_ORDER = (("hire", "admissao", "contratacao"), ("admission", "start", "inicio", "matricula", "abertura"), ("event", "sale", "order", "venda", "pedido", "emissao", "ship"))
DATE_NEVER = ("birth", "nascimento", "born")


def reference_date(df: DataFrame, columns: list[str]) -> str | None:
    """The date column that a table's series follow: by the words of its name, then fewest nulls, then position."""
    nulls = df.agg(*(F.count("*") - F.count(F.col(c)) for c in columns)).first() if columns else ()

    def rank(i: int) -> tuple:
        name = columns[i].lower()
        return next((k for k, words in enumerate(DATE_ORDER) if any(w in name for w in words)), len(DATE_ORDER)), nulls[i], i

    allowed = [i for i, c in enumerate(columns) if not any(w in c.lower() for w in DATE_NEVER)]
    return columns[min(allowed, key=rank)] if allowed else None


