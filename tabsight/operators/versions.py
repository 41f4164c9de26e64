"""Operators that compare two versions of a table, data contracts, and a table's history."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import is_number, is_text, key_string, number
from ..functions.quantiles import exact_quantiles
from .columns import logical_type, long_form, ratio, value_counts

# --- versions ----------------------------------------------------------------


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, status): common, removed (only in the first) or added (only in the second)."""
    rows = [(c, "common" if c in b.columns else "removed") for c in a.columns] + [(c, "added") for c in b.columns if c not in a.columns]
    return a.sparkSession.createDataFrame(rows, "column string, status string")


def column_behaviour(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, type_a, type_b, null_a, null_b, distinct_a, distinct_b, severity): common columns whose type, share of
    nulls (by 5 points) or distinct values (by a fifth) changed."""
    common = [c for c in a.columns if c in b.columns]

    def profile(df: DataFrame, s: str) -> DataFrame:
        out = long_form(df, common, lambda c: {f"type_{s}": logical_type(df, c), "n": F.count("*"), "nulls": F.count("*") - F.count(key_string(df, c)), f"distinct_{s}": F.count_distinct(key_string(df, c))})
        return out.withColumn(f"null_{s}", ratio(F.col("nulls"), F.col("n"))).drop("n", "nulls")

    out = profile(a, "a").join(profile(b, "b"), "column")
    moved = F.abs(F.col("null_a") - F.col("null_b"))
    spread = F.abs(F.col("distinct_b") - F.col("distinct_a")) >= 0.2 * F.greatest("distinct_a", F.lit(1))
    kind = F.col("type_a") != F.col("type_b")
    severity = F.when(kind | (moved >= 0.2), "high").otherwise("medium")
    return out.where(kind | (moved >= 0.05) | spread).select("column", "type_a", "type_b", "null_a", "null_b", "distinct_a", "distinct_b", severity.alias("severity"))


def numeric_drift(a: DataFrame, b: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """(column, median_a, median_b, shift, drifted): the medians' distance in interquartile ranges of the first."""
    qa, qb = (exact_quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.5, 0.75]) for df in (a, b))
    na, nb = (df.agg(*(F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns))).first() for df in (a, b))
    rows = []
    for i, c in enumerate(columns):
        if na[i] >= 10 and nb[i] >= 10:
            spread = qa[c][2] - qa[c][0]
            shift = math.floor(abs(qb[c][1] - qa[c][1]) / spread * 10000 + 0.5) / 10000.0 if spread > 0 else None
            rows.append((c, qa[c][1], qb[c][1], shift, shift is not None and shift >= least))
    return a.sparkSession.createDataFrame(rows, "column string, median_a double, median_b double, shift double, drifted boolean")


def categorical_drift(a: DataFrame, b: DataFrame, columns: list[str], least: float = 0.2, most_levels: int = 50) -> DataFrame:
    """(column, distance, drifted): total variation between the levels' shares."""
    one = lambda df, s: value_counts(df, columns).withColumn(f"p{s}", F.col("cnt") / F.sum("cnt").over(W.partitionBy("column"))).drop("cnt")
    both = one(a, "a").join(one(b, "b"), ["column", "value"], "full").fillna(0.0, ["pa", "pb"])
    out = both.groupBy("column").agg((F.floor(F.sum(F.abs(F.col("pa") - F.col("pb"))) / 2 * 10000 + 0.5) / 10000.0).alias("distance"), F.count("*").alias("levels"))
    return out.where(F.col("levels") <= most_levels).select("column", "distance", (F.col("distance") >= least).alias("drifted"))


def key_reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(status, n): keys only in the first, only in the second, in both."""
    one = lambda df, s: df.select(key_string(df, key).alias("k")).where("k IS NOT NULL").distinct().withColumn(s, F.lit(True))
    both = one(a, "a").join(one(b, "b"), "k", "full")
    status = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "only_a").otherwise("only_b")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def compare_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(severity, kind, subject): columns gone or new, and a volume that moved by a fifth (high: by half)."""
    changes = schema_diff(a, b).where("status <> 'common'").select(F.when(F.col("status") == "removed", "high").otherwise("medium").alias("severity"), F.concat(F.lit("column "), "status").alias("kind"), F.col("column").alias("subject"))
    n = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))  # one row each
    moved = F.abs(F.col("nb") - F.col("na")) / F.greatest("na", F.lit(1))
    volume = n.where(moved >= 0.2).select(F.when(moved >= 0.5, "high").otherwise("medium").alias("severity"), F.lit("volume").alias("kind"), F.concat_ws(" to ", "na", "nb").alias("subject"))
    return changes.unionByName(volume)


# --- contracts ---------------------------------------------------------------


@dataclass
class Contract:
    """What a table must keep to. ``columns``: {name: {type, required, max_null, unique, lo, hi, domain}}."""

    columns: dict[str, dict[str, Any]]
    min_rows: int = 0
    version: int = 1
    rules: list[str] = field(default_factory=list)
    sampled: bool = False

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump({"version": self.version, "min_rows": self.min_rows, "sampled": self.sampled, "columns": self.columns, "rules": self.rules}, sort_keys=False, allow_unicode=True)

    @staticmethod
    def from_yaml(text: str) -> Contract:
        import yaml

        data = yaml.safe_load(text)
        if not isinstance(data, dict) or not isinstance(data.get("columns"), dict):
            raise ValueError("a contract is a mapping with a mapping of columns")
        return Contract(data["columns"], int(data.get("min_rows", 0)), int(data.get("version", 1)), list(data.get("rules") or []), bool(data.get("sampled", False)))


def generate_contract(df: DataFrame, sampled: bool = False, rules: list[str] | None = None) -> Contract:
    """From a table: types, nulls (5 points of slack), uniqueness, ranges of numbers, domains of texts of 2 to 40
    values, half the rows. From a sample no uniqueness, range or domain."""
    columns = df.columns

    def fields(c):
        x = key_string(df, c)
        out = {"kind": logical_type(df, c), "n": F.count("*"), "filled": F.count(x), "d": F.count_distinct(x)}
        v = number(df, c) if is_number(df, c) else F.lit(None).cast("double")
        return out | {"lo": F.min(v), "hi": F.max(v)}

    facts = {r["column"]: r for r in long_form(df, columns, fields).collect()}  # a row a column
    few = [c for c in columns if is_text(df, c) and 2 <= facts[c]["d"] <= 40]
    domains: dict[str, list[str]] = {}
    if few and not sampled:
        for r in value_counts(df, few).orderBy("column", "value").collect():  # 40 values a column at most
            domains.setdefault(r["column"], []).append(r["value"])
    out = {}
    for c in columns:
        f = facts[c]
        share = 1 - f["filled"] / f["n"] if f["n"] else 1.0
        spec: dict[str, Any] = {"type": f["kind"], "required": True, "max_null": round(min(1.0, share + 0.05), 4)}
        if not sampled:
            spec["unique"] = bool(f["n"]) and f["filled"] == f["n"] and f["d"] >= 0.999 * f["n"]
            if f["lo"] is not None:
                spec |= {"lo": f["lo"], "hi": f["hi"]}
            if c in domains:
                spec["domain"] = domains[c]
        out[c] = spec
    n = next(iter(facts.values()))["n"] if facts else 0
    return Contract(out, n // 2, rules=rules or [], sampled=sampled)


def contract_table(df: DataFrame) -> DataFrame:
    """A generated contract as rows: (column, type, max_null, unique, lo, hi, n_domain)."""
    c = generate_contract(df)
    rows = [(k, v["type"], v["max_null"], v["unique"], v.get("lo"), v.get("hi"), len(v.get("domain", []))) for k, v in c.columns.items()]
    return df.sparkSession.createDataFrame(rows, "column string, type string, max_null double, unique boolean, lo double, hi double, n_domain int")


def validate_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """(severity, kind, column, n_violations): what a table breaks. All columns are checked in one aggregation."""
    spark = df.sparkSession
    spec, present = contract.columns, [c for c in contract.columns if c in df.columns]
    fixed = [(v.get("severity_missing", "high"), "missing column", c, 1) for c, v in spec.items() if c not in df.columns and v.get("required", True)]
    fixed += [("low", "new column", c, 1) for c in df.columns if c not in spec]
    out = spark.createDataFrame(fixed, "severity string, kind string, column string, n_violations long")
    if not present:
        return out

    def fields(c):
        v, x = spec[c], key_string(df, c)
        nulls = F.count("*") - F.count(x)
        zero = F.lit(0).cast("long")
        f = {"bad_type": (logical_type(df, c) != v["type"]).cast("long") if v.get("type") not in (None, "empty") else zero, "bad_null": F.when(nulls > v.get("max_null", 1.0) * F.count("*"), nulls).otherwise(zero)}
        f["bad_unique"] = F.count(x) - F.count_distinct(x) if v.get("unique") else zero
        y = number(df, c) if is_number(df, c) else F.lit(None).cast("double")
        f["bad_range"] = F.count_if((y < v["lo"]) | (y > v["hi"])) if v.get("lo") is not None and is_number(df, c) else zero
        f["bad_domain"] = F.count_if(~x.isin(*v["domain"])) if v.get("domain") else zero
        return f

    kinds = (("bad_type", "type", "high"), ("bad_null", "nulls", "high"), ("bad_unique", "uniqueness", "high"), ("bad_range", "range", "medium"), ("bad_domain", "domain", "medium"))
    checks = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), F.col(c).alias("n_violations")) for c, k, s in kinds))
    found = long_form(df, present, fields).select("column", F.inline(checks)).where("n_violations > 0").select("severity", "kind", "column", "n_violations")
    volume = df.agg(F.count("*").alias("n")).where(F.col("n") < contract.min_rows).select(F.lit("high").alias("severity"), F.lit("volume").alias("kind"), F.lit("*").alias("column"), (F.lit(contract.min_rows) - F.col("n")).alias("n_violations"))
    out = out.unionByName(found).unionByName(volume)
    for rule in contract.rules:
        out = out.unionByName(df.agg(F.count_if(~F.expr(rule)).alias("n_violations")).where("n_violations > 0").select(F.lit("medium").alias("severity"), F.lit("rule").alias("kind"), F.lit(rule).alias("column"), "n_violations"))
    return out


def approved(violations: DataFrame) -> bool:
    return violations.where("severity = 'high'").limit(1).count() == 0


# --- history -----------------------------------------------------------------


def history_summary(extractions: list[tuple[str, DataFrame]], scores: dict[str, float] | None = None) -> DataFrame:
    """(seq, name, n_rows, n_columns, n_null_columns, score): a row an extraction."""
    if len(extractions) < 2:
        raise ValueError("a history needs two extractions")
    out = None
    for i, (name, df) in enumerate(extractions):
        empty = sum(((F.count(key_string(df, c)) == 0).cast("int") for c in df.columns), F.lit(0))
        row = df.agg(F.count("*").alias("n_rows"), empty.cast("int").alias("n_null_columns")).select(F.lit(i + 1).alias("seq"), F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_null_columns", F.lit((scores or {}).get(name)).cast("double").alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


#: The limits a history is held to, and their names in a YAML file.
LIMITS = {"min_score": 60.0, "max_score_drop": 5.0, "max_volume_change_pct": 20.0}


def read_limits(text: str) -> dict[str, float]:
    import yaml

    given = yaml.safe_load(text) or {}
    for k, v in given.items():
        if k not in LIMITS:
            raise ValueError(f"unknown limit: {k}")
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 100:
            raise ValueError(f"{k} must be a number from 0 to 100")
    return LIMITS | {k: float(v) for k, v in given.items()}


def history_alerts(summary: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(seq, kind): a low score, a fallen score, another number of columns, a volume that moved by a fifth."""
    m = LIMITS | (limits or {})
    w = W.orderBy("seq")  # a row an extraction
    s = summary.select("seq", "n_rows", "n_columns", "score", F.lag("n_rows").over(w).alias("pr"), F.lag("n_columns").over(w).alias("pc"), F.lag("score").over(w).alias("ps"))
    kinds = {
        "low score": F.col("score") < m["min_score"],
        "score fell": F.col("ps") - F.col("score") >= m["max_score_drop"],
        "columns changed": F.col("n_columns") != F.col("pc"),
        "volume changed": F.abs(F.col("n_rows") - F.col("pr")) * 100 >= m["max_volume_change_pct"] * F.greatest("pr", F.lit(1)),
    }
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in kinds.items())), lambda x: x.isNotNull())
    return s.select("seq", F.explode(found).alias("kind"))
