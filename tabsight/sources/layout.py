"""Layout of a sheet or text table: header row, totals at the end, merged cells, several blocks, types."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import range_id

#: Words of a row of totals.
TOTAL_WORDS = ("total", "totais", "total geral", "grand total", "subtotal", "soma", "sum", "totals", "resultado", "geral")


@dataclass
class Layout:
    header_row: int = 0
    footer_rows: int = 0
    dropped: list[str] = field(default_factory=list)
    separator: str | None = None
    encoding: str | None = None
    warnings: list[str] = field(default_factory=list)


def _is_number(x: str) -> bool:
    try:
        float(x.replace(",", "."))
        return True
    except ValueError:
        return False


def header_row(matrix: list[list[str | None]], layout: Layout | None = None) -> int:
    """The first of 30 rows that is nearly as wide as most, mostly text, with different labels and a wide row after it.

    A row with one or two repeated labels serves if it comes before any better one.
    """
    widths = [sum(c is not None for c in r) for r in matrix]
    usual = Counter(w for w in widths if w).most_common(1)
    least = max(2, 0.8 * usual[0][0]) if usual else 2
    reserve = None
    for i, row in enumerate(matrix[:30]):
        cells = [c for c in row if c is not None]
        if len(cells) < least or sum(not _is_number(c) for c in cells) < 0.6 * len(cells):
            continue
        if not any(w >= least for w in widths[i + 1 : i + 6]):
            continue
        different = len({c.lower() for c in cells})
        if different == len(cells):
            if reserve is not None:
                break
            if i and layout:
                layout.warnings.append(f"{i} rows before the header")
            return i
        if reserve is None and len(cells) - different <= 2 and different >= 0.5 * len(cells):
            reserve = i
    if reserve is not None and layout:
        layout.warnings.append("repeated labels in the header")
    return reserve or 0


def unique_labels(labels: list[str | None]) -> list[str]:
    """Blank labels named by place, repeated ones numbered."""
    seen: Counter = Counter()
    out = []
    for i, x in enumerate(labels):
        x = x or f"Unnamed: {i}"
        out.append(x if not seen[x] else f"{x}.{seen[x]}")
        seen[x] += 1
    return out


def _filled(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_row"]


def multiple_blocks(df: DataFrame) -> int:
    """Empty rows between filled ones."""
    empty = F.lit(True)
    for c in _filled(df):
        empty = empty & (F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == ""))
    ends = df.select("_row", empty.alias("e")).agg(F.min(F.when(~F.col("e"), F.col("_row"))).alias("a"), F.max(F.when(~F.col("e"), F.col("_row"))).alias("b")).first()
    if ends["a"] is None:
        return 0
    return df.where(empty & (F.col("_row") > ends["a"]) & (F.col("_row") < ends["b"])).count()


def footer(df: DataFrame) -> int:
    """Rows at the end that are totals or leavings: a total's word, or a number within 1 % of the sum above it."""
    columns = _filled(df)
    last = df.orderBy(F.desc("_row")).limit(3).collect()[::-1]  # three rows
    if len(last) < 2:
        return 0
    body = df.where(F.col("_row") < last[0]["_row"])
    sums = body.agg(*(F.sum(F.col(f"`{c}`").cast("string").try_cast("double")).alias(f"s{i}") for i, c in enumerate(columns))).first()
    counts = body.agg(*(F.count(F.col(f"`{c}`").cast("string").try_cast("double")).alias(f"n{i}") for i, c in enumerate(columns))).first()
    above = list(sums)
    for k, row in enumerate(last):
        values = [row[c] for c in columns]
        texts = [str(v).strip().lower().rstrip(":") for v in values if v is not None]
        numbers = [float(v) if v is not None and _is_number(str(v)) else None for v in values]
        is_total = any(t in TOTAL_WORDS for t in texts) or (any(v is None for v in values) and any(x is not None and s and n and n > 1 and abs(x - s) <= 0.01 * abs(s) for x, s, n in zip(numbers, above, counts, strict=True)))
        if is_total and all(sum(r[c] is not None for c in columns) <= 1 for r in last[k + 1 :]):
            return len(last) - k
        above = [(s or 0.0) + (x or 0.0) for s, x in zip(above, numbers, strict=True)]
    return 0


def merged_columns(df: DataFrame) -> list[str]:
    """Columns that look like merged cells: a value, then blanks, few different values, the first cell filled."""
    columns, n = _filled(df), df.count()
    if not n:
        return []
    first = df.orderBy("_row").first()
    facts = df.agg(*(F.struct(F.count(F.col(f"`{c}`")).alias("k"), F.count_distinct(F.col(f"`{c}`")).alias("d")).alias(f"x{i}") for i, c in enumerate(columns))).first()
    out = []
    for i, c in enumerate(columns):
        k, d = facts[i]
        nulls = n - k
        if k and 0.3 * n <= nulls < n and first[c] is not None and d <= 50 and d >= 0.8 * k and nulls >= k:
            out.append(c)
    return out


def forward_fill(df: DataFrame, columns: list[str], order: str = "_row") -> DataFrame:
    """Blanks take the value above. Ranges of rows are filled apart, each from the last value of those before it."""
    ranged = df.withColumn("_p", range_id(df, order))
    inside = W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    ends = ranged.groupBy("_p").agg(*(F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(f"_l{i}") for i, c in enumerate(columns)))
    ends = ends.select(F.col("_p").alias("_q"), *(F.last(f"_l{i}", ignorenulls=True).over(before).alias(f"_f{i}") for i in range(len(columns))))
    out = ranged.join(F.broadcast(ends), F.col("_p") == F.col("_q"))
    filled = {c: F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(inside), F.col(f"_f{i}")) for i, c in enumerate(columns)}
    return out.withColumns(filled).select(*(F.col(f"`{c}`") for c in df.columns))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers, or ISO dates where every value says so; 00123 stays text."""
    texts = [c for c, k in df.dtypes if k == "string" and c != "_row"]
    if not texts:
        return df

    def facts(c):
        x = F.trim(F.col(f"`{c}`"))
        x = F.when(x != "", x)
        return F.struct(F.count(x).alias("n"), F.count_if(x.rlike(r"^-?(0|[1-9][0-9]{0,17})$")).alias("whole"), F.count_if(x.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$")).alias("number"), F.count_if(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$") & x.try_cast("timestamp").isNotNull()).alias("date"))

    row = df.agg(*(facts(c).alias(f"x{i}") for i, c in enumerate(texts))).first()
    casts = {}
    for i, c in enumerate(texts):
        n, whole, num, date = row[i]
        kind = "bigint" if n and whole == n else "double" if n and num == n else "timestamp_ntz" if n and date == n else None
        if kind:
            casts[c] = F.trim(F.col(f"`{c}`")).try_cast(kind)
    return df.withColumns(casts) if casts else df


def analyze_body(df: DataFrame, layout: Layout) -> DataFrame:
    """Blank cells to null, totals cut off, blank columns dropped, merged cells filled, types inferred. Drops ``_row``."""
    df = df.withColumns({c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c, k in df.dtypes if k == "string"})
    if blocks := multiple_blocks(df):
        layout.warnings.append(f"{blocks} empty rows between blocks")
    if n := footer(df):
        layout.footer_rows = n
        cut = df.orderBy(F.desc("_row")).limit(n).agg(F.min("_row")).first()[0]
        df = df.where(F.col("_row") < cut)
        layout.warnings.append(f"{n} rows of totals left out")
    unnamed = [c for c in df.columns if c.startswith("Unnamed:")]
    if unnamed:
        counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(unnamed))).first()
        layout.dropped = [c for i, c in enumerate(unnamed) if not counts[i]]
        df = df.drop(*layout.dropped)
    if merged := merged_columns(df):
        df = forward_fill(df, merged)
        layout.warnings.append(f"merged cells filled in {', '.join(merged)}")
    return infer_types(df).drop("_row")
