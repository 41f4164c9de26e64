"""Operators on single columns. Each returns one row a column, or a column's values, in long form.

All columns of a table are worked out in one aggregation: the result of ``agg`` is one row that holds a struct a
column, which is then inlined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import documents, text
from ..functions.keys import clean, is_date, is_number, is_text, key_string, number
from ..functions.quantiles import exact_quantiles
from ..functions.ranges import range_id
from ..settings import DATE_SENTINELS, DATE_TEXT, DEFAULT, MOJIBAKE, NUMBER_SENTINELS, PATTERNS, TEXT_SENTINELS, Settings


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places, half up; 0 if b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.floor(a / b * 10000 + 0.5) / 10000.0)


def long_form(df: DataFrame, columns: list[str], fields) -> DataFrame:
    """(column, **fields(c)) with a row for each column, from one aggregation."""
    if not columns:
        raise ValueError("no column of the needed type")
    packed = F.array(*(F.struct(F.lit(c).alias("column"), *(x.alias(n) for n, x in fields(c).items())) for c in columns))
    return df.agg(packed.alias("x")).select(F.inline("x"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_number(df, c)]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_text(df, c)]


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_date(df, c)]


# --- counts, types, profile --------------------------------------------------


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_null, pct_null)."""
    out = long_form(df, columns or df.columns, lambda c: {"n_rows": F.count("*"), "n_null": F.count("*") - F.count(clean(df, c))})
    return out.withColumn("pct_null", ratio(F.col("n_null"), F.col("n_rows")))


def logical_type(df: DataFrame, c: str) -> Column:
    """An aggregate: the type that a column's values have, whatever its physical type."""
    filled = F.count(clean(df, c))
    if is_date(df, c):
        kind = F.lit("date")
    elif is_number(df, c):
        x = number(df, c)
        kind = F.when(F.count(x) == 0, "number").when(F.bool_and(x == F.floor(x)), "integer").otherwise("decimal")
    elif is_text(df, c):
        dates = F.count_if(F.col(f"`{c}`").rlike(DATE_TEXT))
        kind = F.when(dates >= DEFAULT.date_as_text * filled, "text date").otherwise("text")
    else:
        kind = F.lit("boolean" if dict(df.dtypes)[c] == "boolean" else "text")
    return F.when(filled == 0, "empty").otherwise(kind)


def logical_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, logical_type, n_inf)."""

    def fields(c):
        inf = F.count_if(F.abs(F.col(f"`{c}`")) == float("inf")) if is_number(df, c) else F.lit(0)
        return {"logical_type": logical_type(df, c), "n_inf": inf.cast("long")}

    return long_form(df, columns or df.columns, fields)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, cnt): the value-count index. One shuffle, combined before it; nulls are left out."""
    columns = columns or df.columns
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), key_string(df, c).alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("cnt"))


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = DEFAULT.top_values) -> DataFrame:
    """(column, value, cnt, pct, rnk): the most frequent values, ties by value."""
    counts = value_counts(df, columns)
    filled = counts.groupBy("column").agg(F.sum("cnt").alias("filled"))
    # Spark keeps each task's best rows of a column before the shuffle (a window group limit).
    w = W.partitionBy("column").orderBy(F.desc("cnt"), "value")
    out = counts.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)
    return out.join(F.broadcast(filled), "column").select("column", "value", "cnt", ratio(F.col("cnt"), F.col("filled")).alias("pct"), "rnk")


def characteristic(kind: Column, filled: Column, distinct: Column, rows: Column, top: Column, s: Settings = DEFAULT) -> Column:
    """The first shape that fits a column."""
    keyed = kind.isin("integer", "text", "text date") & (rows > 1)
    return (
        F.when(filled == 0, "empty")
        .when(distinct == 1, "constant")
        .when(top >= s.quasi_constant, "quasi-constant")
        .when(keyed & (distinct == filled), "potential key")
        .when(keyed & (distinct >= s.near_key * rows), "near key")
        .when(kind.isin("date", "text date"), "time series")
        .when(distinct <= 25, "category")
        .when(distinct <= 100, "dimension")
        .when(kind == "text", "free text")
        .when(kind.isin("integer", "decimal", "number"), "metric")
        .otherwise("attribute")
    )


def column_profile(df: DataFrame, table: str, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(table, ordinal, column, physical_type, logical_type, n_rows, n_null, pct_null, n_distinct, uniqueness,
    uniqueness_filled, top_freq, characteristic).

    Distinct counts and the most frequent value's share come from one value-count pass; the rest from one aggregation.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    scan = long_form(df, columns, lambda c: {"ordinal": F.lit(columns.index(c) + 1), "physical_type": F.lit(kinds[c]), "logical_type": logical_type(df, c), "n_rows": F.count("*"), "n_null": F.count("*") - F.count(clean(df, c))})
    counts = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n_distinct"), F.max("cnt").alias("top"))
    filled = F.col("n_rows") - F.col("n_null")
    out = scan.join(counts, "column", "left").fillna(0, ["n_distinct", "top"])
    top = F.when(filled > 0, F.col("top") / filled).otherwise(0.0)
    out = out.withColumns(
        {
            "characteristic": characteristic(F.col("logical_type"), filled, F.col("n_distinct"), F.col("n_rows"), top, s),
            "pct_null": ratio(F.col("n_null"), F.col("n_rows")),
            "uniqueness": ratio(F.col("n_distinct"), F.col("n_rows")),
            "uniqueness_filled": ratio(F.col("n_distinct"), filled),
            "top_freq": ratio(F.col("top"), filled),
            "table": F.lit(table),
        }
    )
    return out.select("table", "ordinal", "column", "physical_type", "logical_type", "n_rows", "n_null", "pct_null", "n_distinct", "uniqueness", "uniqueness_filled", "top_freq", "characteristic")


# --- numbers -----------------------------------------------------------------


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, min, max, mean, median, std, cv, skew, kurtosis): sample standard deviation, adjusted skewness and
    excess kurtosis; null where there are too few values or no spread."""
    columns = columns or numeric_columns(df)
    middle = {c: F.lit(q[0] if q else None).cast("double") for c, q in exact_quantiles(df, {c: number(df, c) for c in columns}, [0.5]).items()}

    def fields(c):
        x = number(df, c)
        return {"n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "median": middle[c], "std": F.stddev_samp(x), "g1": F.skewness(x), "g2": F.kurtosis(x)}

    n = F.col("n")
    out = long_form(df, columns, fields)
    skew = F.when((n > 2) & (F.col("std") > 0), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.col("std") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select("column", "n", "min", "max", "mean", "median", "std", F.try_divide(F.col("std"), F.abs("mean")).alias("cv"), skew.alias("skew"), kurt.alias("kurtosis"))


def sign_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_negative, n_zero, n_positive, n_inf)."""

    def fields(c):
        x = number(df, c)
        return {"n_negative": F.count_if(x < 0), "n_zero": F.count_if(x == 0), "n_positive": F.count_if(x > 0), "n_inf": F.count_if(F.abs(F.col(f"`{c}`").cast("double")) == float("inf"))}

    return long_form(df, columns or numeric_columns(df), fields)


def _quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """First and third quartile of each column: a row of numbers, collected to stand as constants in the next pass."""
    found = exact_quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.75])
    return {c: tuple(q) for c, q in found.items() if q}


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(column, q1, q3, lower, upper, n_low, n_high, n_outliers): fences 1.5 interquartile ranges beyond the quartiles."""
    q = _quartiles(df, columns or numeric_columns(df))

    def fields(c):
        a, b = q[c]
        lo, hi = a - s.fence * (b - a), b + s.fence * (b - a)
        x = number(df, c)
        low, high = F.count_if(x < lo), F.count_if(x > hi)
        return {"q1": F.lit(a), "q3": F.lit(b), "lower": F.lit(lo), "upper": F.lit(hi), "n_low": low, "n_high": high, "n_outliers": low + high}

    return long_form(df, list(q), fields)


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = DEFAULT.histogram_bins) -> DataFrame:
    """(column, bin, lo, hi, cnt): equal widths, the last bin closed; columns of under 10 values or no spread are left out."""
    columns = columns or numeric_columns(df)
    row = df.agg(*(F.struct(F.min(number(df, c)), F.max(number(df, c)), F.count(number(df, c))).alias(f"x{i}") for i, c in enumerate(columns))).first()
    span = {c: (row[i][0], row[i][1]) for i, c in enumerate(columns) if row[i][2] >= 10 and row[i][0] < row[i][1]}
    if not span:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, cnt long")

    def at(c):
        lo, hi = span[c]
        return F.least(F.floor((number(df, c) - lo) / ((hi - lo) / bins)).cast("int") + 1, F.lit(bins))

    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), at(c).alias("bin")) for c in span)))).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("cnt"))
    edges = F.create_map(*(v for c, (lo, hi) in span.items() for v in (F.lit(c), F.array(F.lit(lo), F.lit((hi - lo) / bins)))))
    e = edges[F.col("column")]
    return cells.select("column", "bin", (e[0] + (F.col("bin") - 1) * e[1]).alias("lo"), (e[0] + F.col("bin") * e[1]).alias("hi"), "cnt")


def fixed_decimals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, decimals): the fewest places, 0 to 3, that hold all values; null if none does."""

    def fields(c):
        x = number(df, c)
        fits = lambda k: F.bool_and(F.abs(x * 10**k - F.floor(x * 10**k + 0.5)) < 1e-9 * 10**k)
        return {"decimals": F.when(F.count(x) == 0, None).when(fits(0), 0).when(fits(1), 1).when(fits(2), 2).when(fits(3), 3)}

    return long_form(df, columns or numeric_columns(df), fields)


def dtype_advice(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, current, suggested, saving_pct): the smallest type that holds a column's values."""
    kinds = dict(df.dtypes)
    columns = columns or [c for c in df.columns if is_number(df, c) or is_text(df, c)]
    width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}

    def fields(c):
        if is_text(df, c):
            few = F.count_distinct(F.col(f"`{c}`")) <= 0.5 * F.count(F.col(f"`{c}`"))
            suggested = F.when((F.count(F.col(f"`{c}`")) > 0) & few, "dictionary")
        else:
            x = number(df, c)
            whole = F.bool_and(x == F.floor(x))
            within = lambda k: (F.min(x) >= -(2 ** (k - 1))) & (F.max(x) <= 2 ** (k - 1) - 1)
            small = F.when(within(8), "tinyint").when(within(16), "smallint").when(within(32), "int")
            suggested = F.when(F.count(x) == 0, None).when(whole, small).otherwise(F.lit("float") if kinds[c] == "double" else None)
        return {"current": F.lit(kinds[c]), "suggested": suggested}

    out = long_form(df, columns, fields)
    bytes_ = F.create_map(*(F.lit(v) for kv in width.items() for v in kv))
    better = F.when(F.col("suggested") != F.col("current"), F.col("suggested"))
    saving = F.when(better.isNotNull() & (bytes_[F.col("suggested")] < bytes_[F.col("current")]), F.lit(1.0) - bytes_[F.col("suggested")] / bytes_[F.col("current")]).otherwise(0.0)
    return out.select("column", "current", better.alias("suggested"), saving.alias("saving_pct"))


def benford(df: DataFrame, column: str) -> DataFrame:
    """(digit, cnt, observed, expected, deviation) of the first digits of values from 100 up, against Benford's law."""
    x = number(df, column)
    digits = df.select(x.alias("x")).where("x >= 100").select(F.substring(F.floor("x").cast("decimal(38,0)").cast("string"), 1, 1).cast("int").alias("digit")).groupBy("digit").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(W.partitionBy())  # nine rows
    expected = F.floor(F.log10(1 + 1 / F.col("digit")) * 10000 + 0.5) / 10000.0
    out = digits.select("digit", "cnt", ratio(F.col("cnt"), total).alias("observed"), expected.alias("expected"))
    return out.withColumn("deviation", F.floor(F.abs(F.col("observed") - F.col("expected")) * 10000 + 0.5) / 10000.0)


# --- text --------------------------------------------------------------------


def text_lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min_len, max_len, mean_len, fixed)."""

    def fields(c):
        n = F.length(F.col(f"`{c}`"))
        return {"min_len": F.min(n), "max_len": F.max(n), "mean_len": F.floor(F.avg(n) * 10000 + 0.5) / 10000.0, "fixed": F.min(n) == F.max(n)}

    return long_form(df, columns or text_columns(df), fields)


def boolean_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    out = long_form(df, columns, lambda c: {"n_true": F.count_if(F.col(c)), "n_false": F.count_if(~F.col(c)), "n_null": F.count("*") - F.count(c)})
    return out.withColumn("pct_true", ratio(F.col("n_true"), F.col("n_true") + F.col("n_false")))


def type_mixture(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(column, n_number, n_date, n_blank, n_text, mixed): mixed if two classes hold 5 % of the values each."""

    def fields(c):
        x = F.col(f"`{c}`")
        return {"n": F.count(x), "n_number": F.count_if(text.is_number_text(x)), "n_date": F.count_if(x.rlike(DATE_TEXT)), "n_blank": F.count_if(F.trim(x) == "")}

    out = long_form(df, columns or text_columns(df), fields).withColumn("n_text", F.col("n") - F.col("n_number") - F.col("n_date") - F.col("n_blank"))
    big = sum(((F.col(k) > 0) & (F.col(k) >= s.mixed_type * F.col("n"))).cast("int") for k in ("n_number", "n_date", "n_blank", "n_text"))
    return out.select("column", "n_number", "n_date", "n_blank", "n_text", (big > 1).alias("mixed"))


def date_as_text(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(column, n, n_date, date_as_text)."""
    out = long_form(df, columns or text_columns(df), lambda c: {"n": F.count(F.col(f"`{c}`")), "n_date": F.count_if(F.col(f"`{c}`").rlike(DATE_TEXT))})
    return out.withColumn("date_as_text", (F.col("n") > 0) & (F.col("n_date") >= s.date_as_text * F.col("n")))


def dominant_shapes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, shape, cnt, pct, n_out): the most frequent shape where 20 values or more have it at 80 %."""
    columns = columns or text_columns(df)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), text.shape(F.col(f"`{c}`")).alias("shape")) for c in columns))
    counts = df.select(F.inline(pairs)).where("shape IS NOT NULL").groupBy("column", "shape").agg(F.count("*").alias("cnt"))
    best = counts.groupBy("column").agg(F.sum("cnt").alias("n"), F.max(F.struct("cnt", "shape")).alias("b"))
    return best.where((F.col("n") >= 20) & (F.col("b.cnt") >= 0.8 * F.col("n"))).select("column", "b.shape", "b.cnt", ratio(F.col("b.cnt"), F.col("n")).alias("pct"), (F.col("n") - F.col("b.cnt")).alias("n_out"))


def mojibake(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, n_mojibake, pct)."""
    out = long_form(df, columns or text_columns(df), lambda c: {"n": F.count(F.col(f"`{c}`")), "n_mojibake": F.count_if(F.col(f"`{c}`").rlike(MOJIBAKE))})
    return out.withColumn("pct", ratio(F.col("n_mojibake"), F.col("n")))


#: Personal data inside a text, with the characters around it instead of look-around.
IN_TEXT = {
    "CPF": r"(?:^|[^0-9A-Za-z_])([0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2})(?:$|[^0-9A-Za-z_])",
    "CNPJ": r"(?:^|[^0-9A-Za-z_])([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2})(?:$|[^0-9A-Za-z_])",
    "E-mail": r"(?:^|[^0-9A-Za-z_])([0-9A-Za-z_][0-9A-Za-z_.+\-]*@[0-9A-Za-z_\-]+(?:\.[0-9A-Za-z_\-]+)+)",
    "Telefone": r"(?:^|[^0-9A-Za-z_])(\(?[0-9]{2}\)?\s?9?[0-9]{4}[\s\-]?[0-9]{4})(?:$|[^0-9A-Za-z_])",
}


def _personal(x: Column, kind: str) -> Column:
    """A text with personal data of a kind and more than that."""
    m = F.regexp_extract(x, IN_TEXT[kind], 1)
    ok = (m != "") & (m != F.trim(x))
    return ok & documents.cpf_valid(m) if kind == "CPF" else ok & documents.cnpj_valid(m) if kind == "CNPJ" else ok


def has_personal_data(x: Column) -> Column:
    out = F.lit(False)
    for kind in IN_TEXT:
        out = out | _personal(x, kind)
    return out


def pii_in_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, n, n_found): personal data inside longer texts, in columns of which half the values have a space."""

    def fields(c):
        x = F.col(f"`{c}`")
        out = {"n": F.count(x), "spaced": F.count_if(F.contains(F.trim(x), F.lit(" ")))}
        for kind in IN_TEXT:
            out[kind] = F.count_if(_personal(x, kind))
        return out

    wide = long_form(df, columns or text_columns(df), fields).where(F.col("spaced") >= 0.5 * F.col("n"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n_found")) for k in IN_TEXT))
    return wide.select("column", "n", F.inline(kinds)).where("n_found > 0").select("column", "kind", "n", "n_found")


def structured_pattern(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(column, kind, n, n_match, invalid_document): the first pattern that 75 % of the values have, check digits
    included; invalid_document if they have a document's shape but not its digits."""

    def fields(c):
        x = F.col(f"`{c}`")
        out = {"n": F.count(x)}
        for k in PATTERNS:
            out[f"ok_{k}"] = F.count_if(documents.is_kind(x, k))
            out[f"shape_{k}"] = F.count_if(documents.has_shape(x, k))
        return out

    wide = long_form(df, columns or text_columns(df), fields)
    enough = lambda c: (F.col("n") > 0) & (F.col(f"`{c}`") >= s.structured * F.col("n"))
    kind = F.coalesce(*(F.when(enough(f"ok_{k}"), F.lit(k)) for k in PATTERNS))
    hits = F.coalesce(*(F.when(enough(f"ok_{k}"), F.col(f"`ok_{k}`")) for k in PATTERNS))
    bad = F.coalesce(*(F.when(enough(f"shape_{k}") & ~enough(f"ok_{k}"), F.lit(k)) for k in ("CPF", "CNPJ")))
    return wide.select("column", "n", kind.alias("kind"), hits.alias("n_match"), bad.alias("invalid_document"))


def document_numbers(df: DataFrame, columns: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(column, n, n_cpf, n_cnpj, kind): whole numbers that are documents, leading zeros lost or not."""

    def fields(c):
        x = F.col(f"`{c}`").cast("decimal(20,0)").cast("string")
        return {"n": F.count(x), "n_cpf": F.count_if(F.length(x).between(9, 11) & documents.cpf_valid(x)), "n_cnpj": F.count_if(F.length(x).between(12, 14) & documents.cnpj_valid(x))}

    out = long_form(df, columns, fields)
    most = lambda k: (F.col("n") > 0) & (F.col(k) >= s.structured * F.col("n"))
    return out.withColumn("kind", F.when(most("n_cnpj"), "CNPJ").when(most("n_cpf"), "CPF"))


# --- missing values in disguise, spellings -----------------------------------


def sentinels(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(column, kind, value, cnt, pct): values that stand for a missing one, each at half a percent or more.

    Numbers count only where they are the column's least or greatest value.
    """
    columns = columns or df.columns
    parts = []
    if texts := [c for c in columns if is_text(df, c)]:
        cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), text.fold(F.col(f"`{c}`")).alias("value")) for c in texts))))
        hits = cells.where(F.col("value").isin(*TEXT_SENTINELS)).groupBy("column", "value").agg(F.count("*").alias("cnt"))
        filled = long_form(df, texts, lambda c: {"n": F.count(F.col(f"`{c}`"))})
        parts.append(hits.join(filled, "column").select("column", F.lit("text").alias("kind"), "value", "cnt", "n"))
    if numbers := [c for c in columns if is_number(df, c)]:

        def fields(c):
            x = number(df, c)
            hits = F.array(*(F.struct(F.lit(str(int(v))).alias("value"), F.lit(v).alias("v"), F.count_if(x == v).alias("cnt")) for v in NUMBER_SENTINELS))
            return {"n": F.count(x), "lo": F.min(x), "hi": F.max(x), "hits": hits}

        wide = long_form(df, numbers, fields).select("column", "n", "lo", "hi", F.inline("hits"))
        parts.append(wide.where((F.col("v") == F.col("lo")) | (F.col("v") == F.col("hi"))).select("column", F.lit("number").alias("kind"), "value", "cnt", "n"))
    if dates := [c for c in columns if is_date(df, c)]:

        def days(c):
            x = F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd")
            return {"n": F.count(x), "hits": F.array(*(F.struct(F.lit(v).alias("value"), F.count_if(x == v).alias("cnt")) for v in DATE_SENTINELS))}

        parts.append(long_form(df, dates, days).select("column", "n", F.inline("hits")).select("column", F.lit("date").alias("kind"), "value", "cnt", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("cnt") > 0) & (F.col("cnt") >= s.sentinel_share * F.col("n"))).select("column", "kind", "value", "cnt", ratio(F.col("cnt"), F.col("n")).alias("pct"))


def effective_nulls(df: DataFrame, columns: list[str] | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(column, n_rows, n_null, n_sentinel, n_effective, pct_effective)."""
    hits = sentinels(df, columns, s).groupBy("column").agg(F.sum("cnt").alias("n_sentinel"))
    out = null_profile(df, columns).drop("pct_null").join(hits, "column", "left").fillna(0, ["n_sentinel"])
    out = out.withColumn("n_effective", F.col("n_null") + F.col("n_sentinel"))
    return out.withColumn("pct_effective", ratio(F.col("n_effective"), F.col("n_rows")))


def spelling_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, key, n_spellings, cnt, spellings): values written in more than one way."""
    counts = _raw_counts(df, columns or text_columns(df))
    keyed = counts.withColumn("key", text.spelling_key(F.col("value"))).where("key <> ''")
    out = keyed.groupBy("column", "key").agg(F.count("*").alias("n_spellings"), F.sum("cnt").alias("cnt"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("spellings"))
    return out.where("n_spellings > 1")


def _raw_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("cnt"))


# --- dates -------------------------------------------------------------------


def date_profile(df: DataFrame, columns: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """(column, min_date, max_date, range_days, n_future, pct_weekend, pct_first_day, months_present, months_span).

    Future dates, after ``as_of`` (today unless given), take no part in the months.
    """
    today = F.current_date() if as_of is None else F.lit(as_of)

    def fields(c):
        x = F.col(f"`{c}`")
        n = F.count(x)
        past = F.when(x <= today.cast("timestamp_ntz"), x)
        month = F.year(past) * 12 + F.month(past)
        return {
            "min_date": F.date_format(F.min(x), "yyyy-MM-dd"), "max_date": F.date_format(F.max(x), "yyyy-MM-dd"),
            "range_days": F.datediff(F.max(x), F.min(x)).cast("long"), "n_future": n - F.count(past),
            "pct_weekend": ratio(F.count_if(F.weekday(x) >= 5), n), "pct_first_day": ratio(F.count_if(F.dayofmonth(x) == 1), n),
            "months_present": F.count_distinct(month), "months_span": (F.max(month) - F.min(month) + 1).cast("long"),
        }

    return long_form(df, columns or date_columns(df), fields)


def monthly_series(df: DataFrame, column: str, last: int = 120) -> DataFrame:
    """(month, cnt): the last months."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("month")).limit(last)


def missing_months(df: DataFrame, column: str) -> DataFrame:
    """(month): months without a row between the first and the last."""
    present = df.where(F.col(column).isNotNull()).select(F.date_format(column, "yyyy-MM").alias("month")).distinct()
    span = present.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select(F.explode(F.expr("sequence(to_date(concat(a, '-01')), to_date(concat(b, '-01')), interval 1 month)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return every.join(present, "month", "left_anti")


def monotonic(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(column, increasing): whether the values never fall in the rows' order.

    Neighbours are compared within ranges of the order's first column (a number or time); the ranges' ends are compared
    after.
    """
    ranged = df.select(*columns, F.struct(*order).alias("_o"), range_id(df, order[0]).alias("_p"))
    w = W.partitionBy("_p").orderBy("_o")
    out = ranged.select("_p", "_o", *columns, *(F.lag(c).over(w).alias(f"_l{i}") for i, c in enumerate(columns)))
    by = out.groupBy("_p").agg(*(F.bool_and(F.coalesce(F.col(c) >= F.col(f"_l{i}"), F.lit(True))).alias(f"ok{i}") for i, c in enumerate(columns)), *(F.min_by(c, "_o").alias(f"a{i}") for i, c in enumerate(columns)), *(F.max_by(c, "_o").alias(f"b{i}") for i, c in enumerate(columns)))
    ends = W.orderBy("_p")  # a row a range
    by = by.select(*(F.col(f"ok{i}") & F.coalesce(F.col(f"a{i}") >= F.lag(f"b{i}").over(ends), F.lit(True)) for i in range(len(columns))))
    by = by.toDF(*(f"ok{i}" for i in range(len(columns))))
    return by.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.bool_and(f"ok{i}").alias("increasing")) for i, c in enumerate(columns))).alias("x")).select(F.inline("x"))


def sample_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value): a seeded sample of the distinct values."""
    return df.select(key_string(df, column).alias("value")).where("value IS NOT NULL").distinct().orderBy(F.xxhash64("value"), "value").limit(n)


def uniform_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A uniform sample of rows: those with the least seeded hash of all their values, so it is the same in any layout of
    the rows. Equal rows are counted, and drawn copy by copy."""
    every = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    copies = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("_copies"))
    each = copies.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_copy").cast("string"), every))
    return each.withColumn("_drawn", drawn).orderBy("_drawn").limit(n).select(*(F.col(f"`{c}`") for c in df.columns))
