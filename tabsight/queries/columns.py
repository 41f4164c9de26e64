"""Queries on single columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, text
from ..operators import columns as C
from ..settings import DATE_TEXT, NUMBER_SENTINELS, TEXT_SENTINELS
from .base import four, query, read

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_KIND = {"l_returnflag": "'text'", "l_linestatus": "'text'", "l_shipdate": "'date'"}
_PHYSICAL = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(LINEITEM):
        kind = _KIND.get(c) or f"(SELECT CASE WHEN bool_and({c} = floor({c})) THEN 'integer' ELSE 'decimal' END FROM lineitem)"
        parts.append(f"SELECT 'lineitem' AS \"table\", {i + 1} AS ordinal, '{c}' AS \"column\", '{_PHYSICAL.get(c, 'double')}' AS physical_type, {kind} AS logical_type, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) - count({c}) FROM lineitem) AS n_null, count(*) AS n_distinct, max(n) AS top FROM (SELECT {c}, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)")
    shape = "CASE WHEN n_rows = n_null THEN 'empty' WHEN n_distinct = 1 THEN 'constant' WHEN top >= 0.95 * (n_rows - n_null) THEN 'quasi-constant' WHEN logical_type IN ('integer', 'text') AND n_distinct = n_rows - n_null THEN 'potential key' WHEN logical_type IN ('integer', 'text') AND n_distinct >= 0.95 * n_rows THEN 'near key' WHEN logical_type = 'date' THEN 'time series' WHEN n_distinct <= 25 THEN 'category' WHEN n_distinct <= 100 THEN 'dimension' WHEN logical_type = 'text' THEN 'free text' ELSE 'metric' END"
    return f'SELECT "table", ordinal, "column", physical_type, logical_type, n_rows, n_null, {four("n_null / n_rows")} AS pct_null, n_distinct, {four("n_distinct / n_rows")} AS uniqueness, {four("n_distinct / (n_rows - n_null)")} AS uniqueness_filled, {four("top / (n_rows - n_null)")} AS top_freq, {shape} AS characteristic FROM ({" UNION ALL ".join(parts)})'


@query(_profile_sql())
def column_profile_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return C.column_profile(read(spark, d, "lineitem"), "lineitem", LINEITEM)


def dirty_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and sentinels put in by key."""
    k = F.col("l_orderkey")
    return read(spark, d, "lineitem").select(
        F.when(k % 20 == 0, None).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(k % 25 == 0, F.lit(-1.0)).when(k % 30 == 0, None).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(k % 50 == 0, "N/A").when(k % 40 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(k % 60 == 0, F.lit("1900-01-01").cast("timestamp_ntz")).otherwise(F.col("l_shipdate")).alias("shipped"),
    )


DIRTY_LINEITEM = "(SELECT CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_orderkey % 25 = 0 THEN -1.0 WHEN l_orderkey % 30 = 0 THEN NULL ELSE l_extendedprice END AS price, CASE WHEN l_orderkey % 50 = 0 THEN 'N/A' WHEN l_orderkey % 40 = 0 THEN NULL ELSE l_returnflag END AS flag, CASE WHEN l_orderkey % 60 = 0 THEN TIMESTAMP '1900-01-01' ELSE l_shipdate END AS shipped FROM lineitem)"


def _each(columns, one, table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {one(c)} FROM {table} t" for c in columns)


@query(_each(("qty", "price", "flag", "shipped"), lambda c: f"count(*) AS n_rows, count(*) - count({c}) AS n_null, {four(f'(count(*) - count({c})) / count(*)')} AS pct_null", DIRTY_LINEITEM))
def null_profile_dirty(spark: SparkSession, d: str) -> DataFrame:
    return C.null_profile(dirty_lineitem(spark, d))


_SENTINEL_SQL = f"""SELECT 'flag' AS "column", 'text' AS kind, v AS value, cnt, n FROM (SELECT lower(trim(flag)) AS v, count(*) AS cnt, (SELECT count(flag) FROM {DIRTY_LINEITEM}) AS n FROM {DIRTY_LINEITEM} WHERE lower(trim(flag)) IN ('n/a') GROUP BY 1)
UNION ALL SELECT 'price', 'number', '-1', count(*) FILTER (WHERE price = -1), count(price) FROM {DIRTY_LINEITEM}
UNION ALL SELECT 'shipped', 'date', '1900-01-01', count(*) FILTER (WHERE shipped = TIMESTAMP '1900-01-01'), count(shipped) FROM {DIRTY_LINEITEM}"""


@query(f'SELECT "column", kind, value, cnt, {four("cnt / n")} AS pct FROM ({_SENTINEL_SQL}) WHERE cnt >= 0.005 * n AND cnt > 0')
def sentinels_dirty(spark: SparkSession, d: str) -> DataFrame:
    return C.sentinels(dirty_lineitem(spark, d))


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(f"SELECT 'c_mktsegment' AS \"column\", 'text' AS kind, v AS value, cnt, {four('cnt / n')} AS pct FROM (SELECT lower(trim(x)) AS v, count(*) AS cnt FROM (SELECT CASE c_custkey % 40 WHEN 0 THEN ' N/A' WHEN 1 THEN '-' WHEN 2 THEN 'null' ELSE c_mktsegment END AS x FROM customer) GROUP BY 1), (SELECT count(*) AS n FROM customer) WHERE v IN ({_quoted(TEXT_SENTINELS)}) AND cnt >= 0.005 * n")
def sentinel_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 40
    x = F.when(k == 0, " N/A").when(k == 1, "-").when(k == 2, "null").otherwise(F.col("c_mktsegment"))
    return C.sentinels(read(spark, d, "customer").select(x.alias("c_mktsegment")))


@query(f"SELECT 'qty' AS \"column\", 'number' AS kind, CAST(CAST(x AS BIGINT) AS VARCHAR) AS value, count(*) AS cnt, {four('count(*) / max(n)')} AS pct FROM (SELECT CASE WHEN l_orderkey % 15 = 0 THEN 9999.0 WHEN l_orderkey % 14 = 0 THEN -999.0 ELSE l_quantity END AS x, count(*) OVER () AS n FROM lineitem) WHERE x IN ({', '.join(str(int(v)) for v in NUMBER_SENTINELS)}) GROUP BY x HAVING count(*) >= 0.005 * max(n)")
def sentinel_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    x = F.when(k % 15 == 0, F.lit(9999.0)).when(k % 14 == 0, F.lit(-999.0)).otherwise(F.col("l_quantity"))
    return C.sentinels(read(spark, d, "lineitem").select(x.alias("qty")))


@query(f"SELECT 'ordered' AS \"column\", 'date' AS kind, strftime(x, '%Y-%m-%d') AS value, count(*) AS cnt, {four('count(*) / max(n)')} AS pct FROM (SELECT CASE WHEN o_orderkey % 30 = 0 THEN TIMESTAMP '2099-12-31' ELSE o_orderdate END AS x, count(*) OVER () AS n FROM orders) WHERE strftime(x, '%Y-%m-%d') IN ('1753-01-01', '1899-12-30', '1900-01-01', '1901-01-01', '1970-01-01', '2099-12-31', '9999-12-31') GROUP BY x HAVING count(*) >= 0.005 * max(n)")
def sentinel_date(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 30 == 0, F.lit("2099-12-31").cast("timestamp_ntz")).otherwise(F.col("o_orderdate"))
    return C.sentinels(read(spark, d, "orders").select(x.alias("ordered")))


_NULLS = _each(("qty", "price", "flag", "shipped"), lambda c: f"count(*) AS n_rows, count(*) - count({c}) AS n_null", DIRTY_LINEITEM)


@query(f'SELECT a."column", n_rows, n_null, coalesce(s, 0)::BIGINT AS n_sentinel, (n_null + coalesce(s, 0))::BIGINT AS n_effective, {four("(n_null + coalesce(s, 0)) / n_rows")} AS pct_effective FROM ({_NULLS}) a LEFT JOIN (SELECT "column", sum(cnt)::BIGINT AS s FROM ({_SENTINEL_SQL}) WHERE cnt >= 0.005 * n GROUP BY 1) b ON a."column" = b."column"')
def effective_nulls(spark: SparkSession, d: str) -> DataFrame:
    return C.effective_nulls(dirty_lineitem(spark, d))


def dated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with dates as text in places."""
    k = F.col("o_orderkey")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, d, "orders").select(iso.alias("day"), F.when(k % 4 == 0, iso).when(k % 4 == 1, F.col("o_orderkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("mixed"), "o_orderpriority", F.when(k % 3 == 0, "1.234,50").when(k % 3 == 1, "").otherwise("7,25").alias("br"))


DATED_ORDERS = "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN o_orderkey::VARCHAR ELSE o_orderpriority END AS mixed, o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN '1.234,50' WHEN 1 THEN '' ELSE '7,25' END AS br FROM orders)"
_DATED = ("day", "mixed", "o_orderpriority", "br")
_IS_DATE = "regexp_matches({c}, '" + DATE_TEXT + "')"
_IS_NUMBER = r"(regexp_matches(trim({c}), '^-?[0-9]+(\.[0-9]+)?$') OR regexp_matches(trim({c}), '^-?[0-9]{{1,3}}(\.[0-9]{{3}})*,[0-9]+$') OR regexp_matches(trim({c}), '^-?[0-9]+,[0-9]+$'))"


@query(_each(_DATED, lambda c: f"CASE WHEN count(*) FILTER (WHERE {_IS_DATE.replace('{c}', c)}) >= 0.8 * count({c}) THEN 'text date' ELSE 'text' END AS logical_type, 0::BIGINT AS n_inf", DATED_ORDERS))
def logical_types(spark: SparkSession, d: str) -> DataFrame:
    return C.logical_types(dated_orders(spark, d))


@query(_each(_DATED, lambda c: f"count({c}) AS n, count(*) FILTER (WHERE {_IS_DATE.replace('{c}', c)}) AS n_date, count(*) FILTER (WHERE {_IS_DATE.replace('{c}', c)}) >= 0.8 * count({c}) AS date_as_text", DATED_ORDERS))
def date_as_text(spark: SparkSession, d: str) -> DataFrame:
    return C.date_as_text(dated_orders(spark, d))


_MIX = _each(_DATED, lambda c: f"count({c}) AS n, count(*) FILTER (WHERE {_IS_NUMBER.format(c=c)}) AS n_number, count(*) FILTER (WHERE {_IS_DATE.replace('{c}', c)}) AS n_date, count(*) FILTER (WHERE trim({c}) = '') AS n_blank", DATED_ORDERS)


@query(f'SELECT "column", n_number, n_date, n_blank, n - n_number - n_date - n_blank AS n_text, (n_number >= 0.05 * n)::INT + (n_date >= 0.05 * n)::INT + (n_blank >= 0.05 * n)::INT + (n - n_number - n_date - n_blank >= 0.05 * n)::INT > 1 AS mixed FROM ({_MIX})')
def type_mixture(spark: SparkSession, d: str) -> DataFrame:
    return C.type_mixture(dated_orders(spark, d))


_TOP = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt FROM customer_nation GROUP BY {c}" for c in ("c_mktsegment", "n_name", "r_name"))
_GEO = "customer_nation AS (SELECT c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f'WITH {_GEO} SELECT "column", value, cnt, {four("cnt / n")} AS pct, rnk FROM (SELECT *, sum(cnt) OVER (PARTITION BY "column") AS n, (row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value))::INT AS rnk FROM ({_TOP})) WHERE rnk <= 5')
def top5_values(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    geo = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return C.top_values(geo.select("c_mktsegment", "n_name", "r_name"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _round(x: str, k: int) -> str:
    return f"floor(({x}) * {10**k} + 0.5) / {float(10**k)}"


@query(_each(_NUMBERS, lambda c: f"count({c}) AS n, min({c}) AS min, max({c}) AS max, {_round(f'avg({c})', 4)} AS mean, median({c}) AS median, {_round(f'stddev_samp({c})', 4)} AS std, {_round(f'skewness({c})', 4)} AS skew, {_round(f'kurtosis({c})', 4)} AS kurtosis", "lineitem"))
def numeric_stats(spark: SparkSession, d: str) -> DataFrame:
    out = C.numeric_stats(read(spark, d, "lineitem"), list(_NUMBERS)).drop("cv")
    return out.withColumns({c: F.floor(F.col(c) * 10000 + 0.5) / 10000.0 for c in ("mean", "std", "skew", "kurtosis")})


@query(_each(("c_acctbal", "c_nationkey"), lambda c: f"count(*) FILTER (WHERE {c} < 0) AS n_negative, count(*) FILTER (WHERE {c} = 0) AS n_zero, count(*) FILTER (WHERE {c} > 0) AS n_positive, 0::BIGINT AS n_inf", "customer"))
def sign_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.sign_counts(read(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


def _iqr(table: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1)) AS n_low, count(*) FILTER (WHERE {c} > q3 + 1.5 * (q3 - q1)) AS n_high, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) GROUP BY q1, q3" for c in columns)


@query(f'SELECT "column", {_round("q1", 6)} AS q1, {_round("q3", 6)} AS q3, {_round("lower", 6)} AS lower, {_round("upper", 6)} AS upper, n_low, n_high, n_outliers FROM ({_iqr("events", ["value"])} UNION ALL {_iqr("lineitem", ["l_extendedprice", "l_quantity"])})')
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    out = C.iqr_outliers(read(spark, d, "events"), ["value"]).unionByName(C.iqr_outliers(read(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"]))
    return out.withColumns({c: F.floor(F.col(c) * 1000000 + 0.5) / 1000000.0 for c in ("q1", "q3", "lower", "upper")})


@query("SELECT 'value' AS \"column\", bin, " + _round("lo + (bin - 1) * ((hi - lo) / 18)", 6) + " AS lo, " + _round("lo + bin * ((hi - lo) / 18)", 6) + " AS hi, count(*) AS cnt FROM (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 18)) AS INT) + 1, 18) AS bin, lo, hi FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY bin, lo, hi")
def histogram18(spark: SparkSession, d: str) -> DataFrame:
    return C.histogram(read(spark, d, "events"), ["value"]).withColumns({c: F.floor(F.col(c) * 1000000 + 0.5) / 1000000.0 for c in ("lo", "hi")})


def _decimals(c: str) -> str:
    fits = lambda k: f"bool_and(abs({c} * {10**k} - floor({c} * {10**k} + 0.5)) < {1e-9 * 10**k})"
    return f"CASE WHEN {fits(0)} THEN 0 WHEN {fits(1)} THEN 1 WHEN {fits(2)} THEN 2 WHEN {fits(3)} THEN 3 END AS decimals"


@query(_each(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), _decimals, "lineitem"))
def fixed_decimals(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_decimals(read(spark, d, "lineitem"), list(_NUMBERS))


def _advice(c: str, kind: str) -> str:
    if kind == "string":
        return f"'string' AS current, CASE WHEN count(DISTINCT {c}) <= 0.5 * count({c}) THEN 'dictionary' END AS suggested, 0.0::DOUBLE AS saving_pct"
    small = f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' END"
    s = f"CASE WHEN bool_and({c} = floor({c})) THEN {small} ELSE {'NULL' if kind != 'double' else chr(39) + 'float' + chr(39)} END"
    size = {"int": 4, "bigint": 8, "double": 8}[kind]
    return f"'{kind}' AS current, CASE WHEN {s} <> '{kind}' THEN {s} END AS suggested, CASE WHEN {s} <> '{kind}' THEN greatest(0, 1.0 - CASE {s} WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 WHEN 'float' THEN 4 END / {size}.0) ELSE 0.0 END::DOUBLE AS saving_pct"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_advice(c, k)} FROM part" for c, k in (("p_partkey", "bigint"), ("p_brand", "string"), ("p_size", "int"), ("p_retailprice", "double"))))
def dtype_advice(spark: SparkSession, d: str) -> DataFrame:
    return C.dtype_advice(read(spark, d, "part"), ["p_partkey", "p_brand", "p_size", "p_retailprice"])


@query(f"SELECT digit, cnt, observed, expected, {four('abs(observed - expected)')} AS deviation FROM (SELECT digit, cnt, {four('cnt / sum(cnt) OVER ()')} AS observed, {four('log10(1 + 1.0 / digit)')} AS expected FROM (SELECT CAST(substr(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS digit, count(*) AS cnt FROM orders WHERE o_totalprice >= 100 GROUP BY 1))")
def benford(spark: SparkSession, d: str) -> DataFrame:
    return C.benford(read(spark, d, "orders"), "o_totalprice")


@query(_each(("c_name", "c_mktsegment"), lambda c: f"min(length({c}))::INT AS min_len, max(length({c}))::INT AS max_len, {four(f'avg(length({c}))')} AS mean_len, min(length({c})) = max(length({c})) AS fixed", "customer"))
def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    return C.text_lengths(read(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query(f"SELECT 'large' AS \"column\", count(*) FILTER (WHERE x) AS n_true, count(*) FILTER (WHERE NOT x) AS n_false, count(*) - count(x) AS n_null, {four('count(*) FILTER (WHERE x) / count(x)')} AS pct_true FROM (SELECT CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity > 30 END AS x FROM lineitem)")
def boolean_profile(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("l_orderkey") % 11 == 0, None).otherwise(F.col("l_quantity") > 30)
    return C.boolean_profile(read(spark, d, "lineitem").select(x.alias("large")), ["large"])


_SHAPE = "translate(substr({c}, 1, 40), '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '9999999999AAAAAAAAAAAAAAAAAAAAAAAAAAaaaaaaaaaaaaaaaaaaaaaaaaaa')"


@query(f"SELECT \"column\", shape, cnt, {four('cnt / n')} AS pct, (n - cnt)::BIGINT AS n_out FROM (SELECT *, sum(cnt) OVER (PARTITION BY \"column\") AS n, row_number() OVER (PARTITION BY \"column\" ORDER BY cnt DESC, shape DESC) AS r FROM (SELECT 'c_name' AS \"column\", {_SHAPE.format(c='c_name')} AS shape, count(*) AS cnt FROM customer GROUP BY 2 UNION ALL SELECT 'c_mktsegment', {_SHAPE.format(c='c_mktsegment')}, count(*) FROM customer GROUP BY 2)) WHERE r = 1 AND n >= 20 AND cnt >= 0.8 * n")
def dominant_shape(spark: SparkSession, d: str) -> DataFrame:
    return C.dominant_shapes(read(spark, d, "customer"), ["c_name", "c_mktsegment"])




@query(f"SELECT 'label' AS \"column\", count(label) AS n, count(*) FILTER (WHERE regexp_matches(label, 'Ã[\\x{{80}}-¿–—‚-…]|Â[\\x{{A0}} -¿]|â€|ï¿½|\\x{{FFFD}}')) AS n_mojibake, {four('count(*) FILTER (WHERE doc_id % 50 = 0 OR doc_id % 33 = 0) / count(*)')} AS pct FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'informaÃ§Ã£o' WHEN doc_id % 33 = 0 THEN 'donâ€™t' ELSE lang END AS label FROM documents)")
def mojibake_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return C.mojibake(read(spark, d, "documents").select(F.when(k % 50 == 0, "informaÃ§Ã£o").when(k % 33 == 0, "donâ€™t").otherwise(F.col("lang")).alias("label")))


def _digit_sum(digits: str, weights) -> str:
    return " + ".join(f"CAST(substr({digits}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


def _check_sql(s: str, weights) -> str:
    return f"CASE WHEN ({_digit_sum(s, weights)}) % 11 < 2 THEN 0 ELSE 11 - ({_digit_sum(s, weights)}) % 11 END"


_CPF1, _CPF2 = list(range(10, 1, -1)), list(range(11, 1, -1))
_CNPJ1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
_CNPJ2 = [6, *_CNPJ1]


def _valid_sql(c: str, n: int, first, second) -> str:
    return f"({_check_sql(c, first)} = CAST(substr({c}, {n - 1}, 1) AS INT) AND {_check_sql(c, second)} = CAST(substr({c}, {n}, 1) AS INT) AND replace({c}, substr({c}, 1, 1), '') <> '')"


_CPF_BASE = "lpad(CAST((c_custkey * 7919 + 12345) % 1000000000 AS VARCHAR), 9, '0')"
_CPF_SQL = f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN two ELSE one || CAST(({_check_sql('one', _CPF2)}) AS VARCHAR) END AS doc FROM (SELECT c_custkey, base || CAST({_check_sql('base', _CPF1)} AS VARCHAR) AS one, base || '00' AS two FROM (SELECT c_custkey, {_CPF_BASE} AS base FROM customer))"


def cpf_table(spark: SparkSession, d: str) -> DataFrame:
    """Document numbers made from keys; those of every fifth key end in zeros, valid or not."""
    base = F.lpad(((F.col("c_custkey") * 7919 + 12345) % 1000000000).cast("string"), 9, "0")
    one = F.concat(F.col("base"), documents._check(F.col("base"), _CPF1).cast("string"))
    t = read(spark, d, "customer").select("c_custkey", base.alias("base")).withColumn("one", one)
    full = F.concat("one", documents._check(F.col("one"), _CPF2).cast("string"))
    return t.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat("base", F.lit("00"))).otherwise(full).alias("doc"))


@query(f"SELECT c_custkey, doc, {_valid_sql('doc', 11, _CPF1, _CPF2)} AS valid FROM ({_CPF_SQL})")
def cpf_valid(spark: SparkSession, d: str) -> DataFrame:
    return cpf_table(spark, d).withColumn("valid", documents.cpf_valid(F.col("doc")))


_CNPJ_BASE = "lpad(CAST((s_suppkey * 104729 + 1234567) % 1000000000000 AS VARCHAR), 12, '0')"
_CNPJ_SQL = f"SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN base || '11' ELSE one || CAST(({_check_sql('one', _CNPJ2)}) AS VARCHAR) END AS doc FROM (SELECT s_suppkey, base, base || CAST({_check_sql('base', _CNPJ1)} AS VARCHAR) AS one FROM (SELECT s_suppkey, {_CNPJ_BASE} AS base FROM supplier))"


@query(f"SELECT s_suppkey, doc, {_valid_sql('doc', 14, _CNPJ1, _CNPJ2)} AS valid FROM ({_CNPJ_SQL})")
def cnpj_valid(spark: SparkSession, d: str) -> DataFrame:
    base = F.lpad(((F.col("s_suppkey") * 104729 + 1234567) % 1000000000000).cast("string"), 12, "0")
    t = read(spark, d, "supplier").select("s_suppkey", base.alias("base"))
    t = t.withColumn("one", F.concat("base", documents._check(F.col("base"), _CNPJ1).cast("string")))
    full = F.concat("one", documents._check(F.col("one"), _CNPJ2).cast("string"))
    t = t.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.concat("base", F.lit("11"))).otherwise(full).alias("doc"))
    return t.withColumn("valid", documents.cnpj_valid(F.col("doc")))


@query(f"SELECT 'doc' AS \"column\", count(*) AS n, CASE WHEN count(*) FILTER (WHERE v) >= 0.75 * count(*) THEN 'CPF' END AS kind, CASE WHEN count(*) FILTER (WHERE v) >= 0.75 * count(*) THEN count(*) FILTER (WHERE v) END AS n_match, CASE WHEN count(*) FILTER (WHERE v) < 0.75 * count(*) THEN 'CPF' END AS invalid_document FROM (SELECT {_valid_sql('doc', 11, _CPF1, _CPF2)} AS v FROM ({_CPF_SQL}))")
def structured_pattern(spark: SparkSession, d: str) -> DataFrame:
    return C.structured_pattern(cpf_table(spark, d).select("doc"))


@query(f"SELECT 'doc' AS \"column\", count(*) AS n, NULL::VARCHAR AS kind, NULL::BIGINT AS n_match, CASE WHEN count(*) FILTER (WHERE {_valid_sql('x', 11, _CPF1, _CPF2)}) < 0.75 * count(*) THEN 'CPF' END AS invalid_document FROM (SELECT substr(doc, 1, 10) || CAST((CAST(substr(doc, 11, 1) AS INT) + 1) % 10 AS VARCHAR) AS x FROM ({_CPF_SQL}))")
def invalid_document(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.concat(F.substring("doc", 1, 10), ((F.substring("doc", 11, 1).cast("int") + 1) % 10).cast("string"))
    return C.structured_pattern(cpf_table(spark, d).select(wrong.alias("doc")))


_MAIL = r"(?:^|[^0-9A-Za-z_])([0-9A-Za-z_][0-9A-Za-z_.+\-]*@[0-9A-Za-z_\-]+(?:\.[0-9A-Za-z_\-]+)+)"


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{_MAIL}')) AS n_email FROM documents")
def email_in_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(_MAIL)).alias("n_email"))


def _found(kind: str) -> str:
    p = C.IN_TEXT[kind]
    m = f"regexp_extract(text, '{p}', 1)"
    digits = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    if kind == "CPF":
        check = f" AND CASE WHEN length({digits}) = 11 THEN {_valid_sql(digits, 11, _CPF1, _CPF2)} ELSE false END"
    elif kind == "CNPJ":
        check = f" AND CASE WHEN length({digits}) = 14 THEN {_valid_sql(digits, 14, _CNPJ1, _CNPJ2)} ELSE false END"
    else:
        check = ""
    return f"SELECT 'text' AS \"column\", '{kind}' AS kind, count(*) AS n, count(*) FILTER (WHERE {m} <> '' AND {m} <> trim(text){check}) AS n_found, count(*) FILTER (WHERE contains(trim(text), ' ')) AS spaced FROM documents"


@query("SELECT \"column\", kind, n, n_found FROM (" + " UNION ALL ".join(map(_found, C.IN_TEXT)) + ") WHERE n_found > 0 AND spaced >= 0.5 * n")
def pii_free_text(spark: SparkSession, d: str) -> DataFrame:
    return C.pii_in_text(read(spark, d, "documents").select("text"))


_SPELL = "(SELECT CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS seg FROM customer)"


@query(f"SELECT 'seg' AS \"column\", key, count(*) AS n_spellings, sum(cnt)::BIGINT AS cnt, string_agg(seg, '|' ORDER BY seg) AS spellings FROM (SELECT seg, regexp_replace(lower(seg), '[^0-9a-z]', '', 'g') AS key, count(*) AS cnt FROM {_SPELL} GROUP BY 1) GROUP BY key HAVING count(*) > 1")
def spelling_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    seg = F.when(k == 0, F.lower("c_mktsegment")).when(k == 1, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return C.spelling_groups(read(spark, d, "customer").select(seg.alias("seg")), ["seg"])


_MONTH = "year({c}) * 12 + month({c})"


@query(f"SELECT 'l_shipdate' AS \"column\", strftime(min(l_shipdate), '%Y-%m-%d') AS min_date, strftime(max(l_shipdate), '%Y-%m-%d') AS max_date, date_diff('day', min(l_shipdate), max(l_shipdate)) AS range_days, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1997-06-30') AS n_future, {four('count(*) FILTER (WHERE isodow(l_shipdate) >= 6) / count(*)')} AS pct_weekend, {four('count(*) FILTER (WHERE day(l_shipdate) = 1) / count(*)')} AS pct_first_day, count(DISTINCT CASE WHEN l_shipdate <= TIMESTAMP '1997-06-30' THEN {_MONTH.format(c='l_shipdate')} END) AS months_present, max(CASE WHEN l_shipdate <= TIMESTAMP '1997-06-30' THEN {_MONTH.format(c='l_shipdate')} END) - min(CASE WHEN l_shipdate <= TIMESTAMP '1997-06-30' THEN {_MONTH.format(c='l_shipdate')} END) + 1 AS months_span FROM lineitem")
def date_profile(spark: SparkSession, d: str) -> DataFrame:
    return C.date_profile(read(spark, d, "lineitem"), ["l_shipdate"], as_of="1997-06-30")


@query("SELECT month, cnt FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS cnt FROM orders GROUP BY 1) ORDER BY month DESC LIMIT 120")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    return C.monthly_series(read(spark, d, "orders"), "o_orderdate")


@query("WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE month(o_orderdate) NOT IN (3, 7)) SELECT strftime(x, '%Y-%m') AS month FROM (SELECT unnest(generate_series((SELECT min(m) FROM m)::TIMESTAMP, (SELECT max(m) FROM m)::TIMESTAMP, INTERVAL 1 MONTH)) AS x) WHERE x::DATE NOT IN (SELECT m FROM m)")
def missing_months(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_months(read(spark, d, "orders").where(~F.month("o_orderdate").isin(3, 7)), "o_orderdate")


@query("SELECT 'o_orderkey' AS \"column\", bool_and(o_orderkey >= p) AS increasing FROM (SELECT o_orderkey, lag(o_orderkey, 1, o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders) UNION ALL SELECT 'o_totalprice', bool_and(o_totalprice >= p) FROM (SELECT o_totalprice, lag(o_totalprice, 1, o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders)")
def monotonic(spark: SparkSession, d: str) -> DataFrame:
    return C.monotonic(read(spark, d, "orders"), ["o_orderkey", "o_totalprice"], ["o_orderkey"])


@query("SELECT c_custkey, substr(c_name, 1, 1) || '***@' || 'mail.org' AS email, substr(regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g'), 1, 2) || '***' AS value, regexp_replace(c_name || ' Silva', '([A-Za-z])[A-Za-z]+', '\\1***', 'g') AS name FROM customer")
def mask_values(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", text.mask_email(F.concat("c_name", F.lit("@mail.org"))).alias("email"), text.mask_value(F.col("c_name")).alias("value"), text.mask_name(F.concat("c_name", F.lit(" Silva"))).alias("name"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9A-Za-z_.+\-]+@[0-9A-Za-z_\-]+(\.[0-9A-Za-z_\-]+)+', '[E-mail]', 'g'), '[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}', '[CNPJ]', 'g'), '[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}', '[CPF]', 'g')) AS redacted_md5 FROM documents")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query()
def pseudonymize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", text.pseudonym(F.col("c_name"), "a key from outside").alias("pseudonym"))


@query()
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.uniform_sample(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 1000)


