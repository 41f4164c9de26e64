"""Operators on sets of tables: keys, foreign keys, roles, grain, coverage, star queries."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_date, key_string
from ..functions.similarity import jaro_winkler
from .columns import ratio, value_counts
from .tables import composite_keys

Tables = dict[str, DataFrame]


def pk_candidates(tables: Tables) -> DataFrame:
    """(table, column, n): columns without nulls whose values all differ; three values at least; whole numbers or text."""
    parts = []
    for t, df in tables.items():
        columns = [c for c, k in df.dtypes if k in ("string", "int", "bigint", "smallint", "tinyint")]
        counted = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n"), F.max("cnt").alias("most"), F.sum("cnt").alias("filled"))
        rows = df.agg(F.count("*").alias("n_rows"))
        parts.append(counted.crossJoin(F.broadcast(rows)).where("most = 1 AND filled = n_rows AND n >= 3").select(F.lit(t).alias("table"), "column", "n"))  # one row
    return reduce(DataFrame.unionByName, parts)


def _values(tables: Tables, columns: dict[str, list[str]]) -> DataFrame:
    """(table, column, value, cnt) of the columns named."""
    return reduce(DataFrame.unionByName, (value_counts(tables[t], cs).withColumn("table", F.lit(t)) for t, cs in columns.items() if cs))


def _is_id(name: str) -> bool:
    words = name.lower().replace("-", "_").split("_")
    return any(w in ("id", "key", "cod", "code", "pk", "fk", "number", "identifier") or w.endswith("key") for w in words)


def fk_discovery(tables: Tables, least: float = 0.6, least_named: float = 0.35) -> DataFrame:
    """(src_table, src_col, dst_table, dst_col, cardinality, containment, orphan_rows, pct_orphans, name_similarity, confidence).

    Candidates are the key columns of one table and like-typed columns of another. One equi-join of the distinct values
    gives every containment at once; only matching values meet, never all pairs.
    """
    spark = next(iter(tables.values())).sparkSession
    usable = {t: [c for c, k in df.dtypes if k in ("string", "int", "bigint", "smallint", "tinyint")] for t, df in tables.items()}
    values = _values(tables, usable)
    facts = values.groupBy("table", "column").agg(F.count("*").alias("d"), F.sum("cnt").alias("n"), F.max("cnt").alias("most")).collect()  # a row a column
    sizes = {(r["table"], r["column"]): (r["d"], r["n"]) for r in facts}
    rows = {t: df.count() for t, df in tables.items()}
    keys = [(r["table"], r["column"], r["d"]) for r in facts if r["most"] == 1 and r["n"] == rows[r["table"]] and r["d"] >= 3]
    named = [(st, sc, dt, dc, n, float(jaro_winkler(sc.lower(), dc.lower())), _is_id(sc) and _is_id(dc)) for dt, dc, n in keys for st, cs in usable.items() if st != dt for sc in cs if dict(tables[st].dtypes)[sc] in _like(dict(tables[dt].dtypes)[dc]) and (st, sc) in sizes]
    # Without a like name the key must have ten values and the source cover a twentieth of it.
    named = [x for x in named if x[5] >= 0.75 or (x[4] >= 10 and sizes[x[0], x[1]][0] >= 0.05 * x[4])]
    kind = "src_table string, src_col string, dst_table string, dst_col string, cardinality string, containment double, orphan_rows long, pct_orphans double, name_similarity double, confidence double"
    if not named:
        return spark.createDataFrame([], kind)
    pairs = spark.createDataFrame([(st, sc, dt, dc, n, j, i, *sizes[st, sc]) for st, sc, dt, dc, n, j, i in named], "src_table string, src_col string, dst_table string, dst_col string, keys long, jw double, ids boolean, n_distinct long, n_filled long")
    key_values = values.join(F.broadcast(spark.createDataFrame([(t, c) for t, c, _ in keys], "table string, column string")), ["table", "column"]).select(F.col("table").alias("dst_table"), F.col("column").alias("dst_col"), "value")
    source = values.select(F.col("table").alias("src_table"), F.col("column").alias("src_col"), "value", "cnt")
    hits = source.join(key_values, "value").where("src_table <> dst_table").groupBy("src_table", "src_col", "dst_table", "dst_col").agg(F.count("*").alias("shared"), F.sum("cnt").alias("rows"))
    out = pairs.join(hits, ["src_table", "src_col", "dst_table", "dst_col"])
    containment = F.col("shared") / F.col("n_distinct")
    confidence = 0.6 * containment + 0.25 * F.col("jw") + 0.15 * F.col("ids").cast("double")
    enough = (containment >= least) | ((F.col("jw") >= 0.75) & (containment >= least_named))
    out = out.where(enough & (F.floor(confidence * 10000 + 0.5) >= 6000))
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000.0
    return out.select("src_table", "src_col", "dst_table", "dst_col", F.when(F.col("n_distinct") >= 0.999 * F.col("n_filled"), "1:1").otherwise("N:1").alias("cardinality"), ratio(F.col("shared"), F.col("n_distinct")).alias("containment"), (F.col("n_filled") - F.col("rows")).alias("orphan_rows"), ratio(F.col("n_filled") - F.col("rows"), F.col("n_filled")).alias("pct_orphans"), four(F.col("jw")).alias("name_similarity"), four(confidence).alias("confidence"))


def _like(kind: str) -> tuple[str, ...]:
    whole = ("int", "bigint", "smallint", "tinyint")
    return (*whole, "string") if kind in whole else ("string", *whole)


def fk_orphans(src: DataFrame, src_col: str, dst: DataFrame, dst_col: str) -> DataFrame:
    """(value, cnt): values of the source that the key does not have, and their rows."""
    have = dst.select(key_string(dst, dst_col).alias("value")).distinct()
    return src.select(key_string(src, src_col).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("cnt")).join(have, "value", "left_anti")


def composite_fk(src: DataFrame, src_cols: list[str], dst: DataFrame, dst_cols: list[str]) -> DataFrame:
    """(n_tuples, n_contained, containment) of the source's tuples in the key's."""
    tuples = lambda df, cs: df.select(*(key_string(df, c).alias(f"k{i}") for i, c in enumerate(cs))).dropna().distinct()
    a, b = tuples(src, src_cols), tuples(dst, dst_cols).withColumn("hit", F.lit(1))
    out = a.join(b, [f"k{i}" for i in range(len(src_cols))], "left").agg(F.count("*").alias("n_tuples"), F.count("hit").alias("n_contained"))
    return out.withColumn("containment", ratio(F.col("n_contained"), F.col("n_tuples")))


def composite_discovery(tables: Tables, links: DataFrame | None = None, least: float = 0.6, most_keys: int = 4) -> DataFrame:
    """(src_table, src_cols, dst_table, dst_cols, containment, pct_orphans): tuples of one table that are keys of another.

    Up to most_keys keys of several columns a table are tried against tables with equally or very similarly named columns
    that no single column links to it already.
    """
    links = fk_discovery(tables) if links is None else links
    linked = {(r["src_table"], r["dst_table"]) for r in links.select("src_table", "dst_table").distinct().collect()}  # at most the pairs of tables
    rows = []
    for dst, d in tables.items():
        keys = [r["key"].split(", ") for r in composite_keys(d, most=most_keys).collect()]
        for src, t in tables.items():
            for key in keys if src != dst and (src, dst) not in linked else []:
                if order := key_order([c for c in t.columns if any(jaro_winkler(c.lower(), k.lower()) >= 0.9 for k in key)], key):
                    cols = [a for a, _ in order]
                    found = composite_fk(t, cols, d, [b for _, b in order]).first()
                    if found["n_tuples"] and found["containment"] >= least:
                        rows.append((src, ", ".join(cols), dst, ", ".join(key), found["containment"], _orphan_rows(t, cols, d, [b for _, b in order])))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "src_table string, src_cols string, dst_table string, dst_cols string, containment double, pct_orphans double")


def _orphan_rows(src: DataFrame, src_cols: list[str], dst: DataFrame, dst_cols: list[str]) -> float:
    """The share of the rows with whole tuples whose tuple the key does not have."""
    names = [f"k{i}" for i in range(len(src_cols))]
    a = src.select(*(key_string(src, c).alias(n) for c, n in zip(src_cols, names, strict=True))).dropna().groupBy(*names).agg(F.count("*").alias("c"))
    b = dst.select(*(key_string(dst, c).alias(n) for c, n in zip(dst_cols, names, strict=True))).dropna().distinct().withColumn("hit", F.lit(1))
    return a.join(b, names, "left").agg(ratio(F.sum(F.when(F.col("hit").isNull(), F.col("c")).otherwise(0)), F.sum("c"))).first()[0] or 0.0


def key_order(columns_a: list[str], columns_b: list[str]) -> list[tuple[str, str]] | None:
    """Which column of a matches each of b, by equal or very like names; None if some has none."""
    best = max(permutations(columns_a, len(columns_b)), key=lambda p: sum(jaro_winkler(x.lower(), y.lower()) for x, y in zip(p, columns_b, strict=True)), default=None) if len(columns_a) >= len(columns_b) and len(columns_a) <= 8 else None
    if not best or any(jaro_winkler(x.lower(), y.lower()) < 0.9 for x, y in zip(best, columns_b, strict=True)):
        return None
    return list(zip(best, columns_b, strict=True))


def table_roles(tables: Tables, measures: dict[str, list[str]], links: DataFrame | None = None) -> DataFrame:
    """(table, role, n_fk_out, n_ref_by, n_measures): fact, bridge, factless fact, dimension, isolated dimension or undefined."""
    links = fk_discovery(tables) if links is None else links
    spark = next(iter(tables.values())).sparkSession
    keyed = {r["table"] for r in pk_candidates(tables).collect()}
    base = spark.createDataFrame([(t, len(df.columns), len(measures.get(t, [])), t in keyed) for t, df in tables.items()], "table string, n_columns int, n_measures int, keyed boolean")
    out = base.join(links.groupBy(F.col("src_table").alias("table")).agg(F.count_distinct("src_col").alias("n_fk_out")), "table", "left").join(links.groupBy(F.col("dst_table").alias("table")).agg(F.count_distinct("src_table", "src_col").alias("n_ref_by")), "table", "left").fillna(0)
    fk, ref, m = F.col("n_fk_out"), F.col("n_ref_by"), F.col("n_measures")
    role = F.when((fk >= 1) & (m > 0), "fact").when((fk >= 2) & (F.col("n_columns") <= fk + 1), "bridge").when(fk >= 2, "factless fact").when((ref > 0) & F.col("keyed"), "dimension").when(F.col("keyed"), "isolated dimension").otherwise("undefined")
    return out.select("table", role.alias("role"), "n_fk_out", "n_ref_by", "n_measures")


def grain_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, n_entities, n_repeat, pct_repeat, is_unique) of the rows by some columns."""
    by = df.groupBy(*columns).agg(F.count("*").alias("c"))
    out = by.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_entities"))
    repeat = F.col("n_rows") - F.col("n_entities")
    return out.select("n_rows", "n_entities", repeat.alias("n_repeat"), ratio(repeat, F.col("n_rows")).alias("pct_repeat"), (repeat == 0).alias("is_unique"))


def temporal_coverage(tables: Tables) -> DataFrame:
    """(table, column, min_date, max_date) of each date column, with a row ``*`` for the span that all share."""
    parts = []
    for t, df in tables.items():
        for c in df.columns:
            if is_date(df, c):
                parts.append(df.agg(F.date_format(F.min(c), "yyyy-MM-dd").alias("min_date"), F.date_format(F.max(c), "yyyy-MM-dd").alias("max_date")).select(F.lit(t).alias("table"), F.lit(c).alias("column"), "min_date", "max_date"))
    each = reduce(DataFrame.unionByName, parts)
    return each.unionByName(each.agg(F.max("min_date").alias("min_date"), F.min("max_date").alias("max_date")).select(F.lit("*").alias("table"), F.lit("*").alias("column"), "min_date", "max_date"))


#: Words of a measure's name that make its sum meaningless.
AVERAGED = ("nota", "grade", "score", "rate", "taxa", "pct", "percent", "discount", "tax", "price", "preco", "media", "avg", "idade", "age")


def aggregate_of(measure: str) -> str:
    return "avg" if any(w in measure.lower() for w in AVERAGED) else "sum"


def star_query(fact: DataFrame, dims: list[tuple[DataFrame, str, str]], attribute: str, measure: str | None = None, op: str | None = None) -> DataFrame:
    """(attribute, value): a measure of the fact, or its rows, by an attribute of a dimension. dims: (table, fact column, key)."""
    out = fact
    for dim, f, k in dims:
        out = out.join(dim, F.col(f) == F.col(k), "left")
    op = op or (aggregate_of(measure) if measure else "count")
    x = F.count("*") if op == "count" else (F.sum if op == "sum" else F.avg)(F.col(measure).cast("decimal(28,4)")).cast("double")
    return out.groupBy(F.col(attribute).alias("attribute")).agg(x.alias("value"))


def monthly_star(fact: DataFrame, date: str, measure: str) -> DataFrame:
    """(month, value)."""
    return fact.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(F.col(measure).cast("decimal(28,4)")).cast("double").alias("value"))


def star_sql(fact: str, dims: list[tuple[str, str, str]], attribute: str, measure: str | None) -> str:
    """The same as SQL text, names quoted."""
    q = lambda x: "`" + x.replace("`", "``") + "`"
    joins = " ".join(f"LEFT JOIN {q(d)} ON {q(fact)}.{q(f)} = {q(d)}.{q(k)}" for d, f, k in dims)
    value = f"{aggregate_of(measure).upper()}({q(measure)})" if measure else "COUNT(*)"
    return f"SELECT {q(attribute)} AS attribute, {value} AS value FROM {q(fact)} {joins} GROUP BY {q(attribute)} ORDER BY value DESC"


def suggested_analyses(fact: str, dims: list[tuple[str, str, str, list[str]]], measures: list[str], date: str | None = None, most: int = 12) -> list[tuple[str, str]]:
    """(title, SQL) of some star queries: up to five attributes by three measures, counts, and the monthly course."""
    out = [(f"{aggregate_of(m)} of {m} by {a}", star_sql(fact, [(d, f, k)], a, m)) for d, f, k, attributes in dims for a in attributes[:5] for m in measures[:3]]
    out += [(f"rows by {a}", star_sql(fact, [(d, f, k)], a, None)) for d, f, k, attributes in dims for a in attributes[:5]]
    if date:
        out += [(f"{m} by month", f"SELECT date_format(`{date}`, 'yyyy-MM') AS month, SUM(`{m}`) AS value FROM `{fact}` GROUP BY 1 ORDER BY 1") for m in measures[:1]]
    return out[:most]


def model_warnings(links: DataFrame, roles: DataFrame, tables: Tables | None = None, composites: DataFrame | None = None, grains: dict[str, list[str]] | None = None) -> DataFrame:
    """(severity, kind, subject): orphans, keys stored as text here and as numbers there, tables without a link; with ``composites`` the
    orphans of links by several columns; with ``grains`` (table: columns) rows that repeat their grain; with ``tables`` dates that do not overlap."""
    row = lambda severity, kind, subject: [severity.alias("severity"), F.lit(kind).alias("kind"), subject.alias("subject")]
    high, medium = F.lit("high"), F.lit("medium")
    end = F.concat_ws(".", "src_table", "src_col")
    found = [links.where("pct_orphans > 0").select(*row(F.when(F.col("pct_orphans") > 0.05, high).otherwise(medium), "orphans", end))]
    alone = roles.where("n_fk_out = 0 AND n_ref_by = 0").select(*row(medium, "isolated table", F.col("table")))
    if composites is not None:
        joined = composites.select(F.col("src_table").alias("table")).union(composites.select("dst_table")).distinct()
        alone = alone.join(joined, F.col("subject") == F.col("table"), "left_anti")
        found.append(composites.where("pct_orphans > 0.05").select(*row(medium, "orphans of a key of several columns", F.concat(F.col("src_table"), F.lit("("), F.col("src_cols"), F.lit(")")))))
    found.append(alone)
    if tables:
        text = {(t, c): k == "string" for t, df in tables.items() for c, k in df.dtypes}
        kinds = F.create_map(*(x for (t, c), v in text.items() for x in (F.lit(f"{t}.{c}"), F.lit(v))))
        unlike = kinds[end] != kinds[F.concat_ws(".", "dst_table", "dst_col")]
        found.append(links.where(unlike).select(*row(high, "types of a key differ", F.concat(end, F.lit(" = "), F.concat_ws(".", "dst_table", "dst_col")))))
        for t, columns in (grains or {}).items():
            found.append(grain_check(tables[t], columns).where("not is_unique").select(*row(high, "grain violated", F.lit(f"{t}({', '.join(columns)})"))))
        if sum(is_date(df, c) for df in tables.values() for c in df.columns) > 1:
            found.append(temporal_coverage(tables).where("table = '*' AND min_date > max_date").select(*row(high, "no overlap in time", F.concat_ws(" > ", "min_date", "max_date"))))
    return reduce(DataFrame.unionByName, found)
