"""Queries on sets of tables, versions, contracts, histories and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import quality as Q
from ..operators import versions as V
from ..settings import KPI_RULES, PATTERNS, PERSONAL_WEIGHTS
from .base import four, query, read
from .columns import DIRTY_LINEITEM, dirty_lineitem

TABLES = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"]}


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: read(spark, d, t).select(*cs) for t, cs in TABLES.items()}


_PK = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM {t} HAVING count(*) = count(DISTINCT {c}) AND count(*) >= 3" for t, cs in TABLES.items() for c in cs)


@query(_PK)
def pk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return M.pk_candidates(tables(spark, d))


def _fk() -> str:
    values = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c} AS v, count(*) AS n FROM {t} GROUP BY {c}" for t, cs in TABLES.items() for c in cs)
    conf = "0.6 * shared / d + 0.25 * jw + 0.15"
    return f"""WITH v AS ({values}), pk AS ({_PK}), s AS (SELECT t, c, count(*) AS d, sum(n) AS f FROM v GROUP BY ALL),
    h AS (SELECT a.t AS st, a.c AS sc, b.t AS dt, b.c AS dc, count(*) AS shared, sum(a.n) AS rows FROM v a JOIN v b ON a.v = b.v AND a.t <> b.t JOIN pk ON pk."table" = b.t AND pk."column" = b.c GROUP BY ALL),
    x AS (SELECT h.*, s.d, s.f, pk.n AS keys, jaro_winkler_similarity(sc, dc) AS jw FROM h JOIN s ON s.t = st AND s.c = sc JOIN pk ON pk."table" = dt AND pk."column" = dc)
    SELECT st AS src_table, sc AS src_col, dt AS dst_table, dc AS dst_col, CASE WHEN d >= 0.999 * f THEN '1:1' ELSE 'N:1' END AS cardinality, {four('shared / d')} AS containment, (f - rows)::BIGINT AS orphan_rows, {four('(f - rows) / f')} AS pct_orphans, {four('jw')} AS name_similarity, {four(conf)} AS confidence
    FROM x WHERE (jw >= 0.75 OR (keys >= 10 AND d >= 0.05 * keys)) AND (shared >= 0.6 * d OR (jw >= 0.75 AND shared >= 0.35 * d)) AND floor(({conf}) * 10000 + 0.5) >= 6000"""


@query(_fk())
def fk_discovery(spark: SparkSession, d: str) -> DataFrame:
    return M.fk_discovery(tables(spark, d))


@query("SELECT o_custkey::VARCHAR AS value, count(*) AS cnt FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY 1")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    return M.fk_orphans(read(spark, d, "orders"), "o_custkey", read(spark, d, "customer").where("c_custkey % 10 <> 0"), "c_custkey")


@query(f"SELECT count(*) AS n_tuples, count(b.p) AS n_contained, {four('count(b.p) / count(*)')} AS containment FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) a LEFT JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_orderkey % 3 <> 0) b ON a.p = b.p AND a.s = b.s")
def fk_composite(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return M.composite_fk(li, ["l_partkey", "l_suppkey"], li.where("l_orderkey % 3 <> 0"), ["l_partkey", "l_suppkey"])


MEASURES = {"orders": ["o_totalprice"]}


@query(f"""WITH l AS ({_fk()}), k AS (SELECT DISTINCT "table" AS t FROM ({_PK})), b(t, cols, m) AS (VALUES {', '.join(f"('{t}', {len(cs)}, {len(MEASURES.get(t, []))})" for t, cs in TABLES.items())}),
x AS (SELECT b.t, cols, m, (SELECT count(DISTINCT src_col) FROM l WHERE src_table = b.t) AS fk, (SELECT count(DISTINCT (src_table, src_col)) FROM l WHERE dst_table = b.t) AS ref, b.t IN (SELECT t FROM k) AS keyed FROM b)
SELECT t AS "table", CASE WHEN fk >= 1 AND m > 0 THEN 'fact' WHEN fk >= 2 AND cols <= fk + 1 THEN 'bridge' WHEN fk >= 2 THEN 'factless fact' WHEN ref > 0 AND keyed THEN 'dimension' WHEN keyed THEN 'isolated dimension' ELSE 'undefined' END AS role, fk AS n_fk_out, ref AS n_ref_by, m AS n_measures FROM x""")
def table_roles(spark: SparkSession, d: str) -> DataFrame:
    return M.table_roles(tables(spark, d), MEASURES)


@query(f"SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_suppkey)) AS n_entities, count(*) - count(DISTINCT (l_orderkey, l_suppkey)) AS n_repeat, {four('(count(*) - count(DISTINCT (l_orderkey, l_suppkey))) / count(*)')} AS pct_repeat, count(*) = count(DISTINCT (l_orderkey, l_suppkey)) AS is_unique FROM lineitem")
def grain_check(spark: SparkSession, d: str) -> DataFrame:
    return M.grain_check(read(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


_COVER = "SELECT 'orders' AS \"table\", 'o_orderdate' AS \"column\", strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date FROM orders UNION ALL SELECT 'lineitem', 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem"


@query(f"WITH c AS ({_COVER}) SELECT * FROM c UNION ALL SELECT '*', '*', max(min_date), min(max_date) FROM c")
def temporal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.temporal_coverage({t: read(spark, d, t) for t in ("orders", "lineitem")})


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.floor(F.col("value") * 100 + 0.5) / 100.0)


@query("SELECT p_brand AS attribute, floor(sum(l_quantity::DECIMAL(28,4))::DOUBLE * 100 + 0.5) / 100.0 AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def star_sum_by_attribute(spark: SparkSession, d: str) -> DataFrame:
    return _money(M.star_query(read(spark, d, "lineitem"), [(read(spark, d, "part"), "l_partkey", "p_partkey")], "p_brand", "l_quantity"))


@query("SELECT floor(avg(l_discount::DECIMAL(28,4))::DOUBLE * 100 + 0.5) / 100.0 AS value, p_type AS attribute FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 2")
def star_average(spark: SparkSession, d: str) -> DataFrame:
    return _money(M.star_query(read(spark, d, "lineitem"), [(read(spark, d, "part"), "l_partkey", "p_partkey")], "p_type", "l_discount"))


@query("SELECT c_mktsegment AS attribute, count(*) AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def star_count(spark: SparkSession, d: str) -> DataFrame:
    return M.star_query(read(spark, d, "orders"), [(read(spark, d, "customer"), "o_custkey", "c_custkey")], "c_mktsegment")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, floor(sum(o_totalprice::DECIMAL(28,4))::DOUBLE * 100 + 0.5) / 100.0 AS value FROM orders GROUP BY 1")
def star_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _money(M.monthly_star(read(spark, d, "orders"), "o_orderdate", "o_totalprice"))


# --- versions ----------------------------------------------------------------


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders")
    a = o.where("o_orderkey % 4 <> 0").drop("o_orderpriority")
    k = F.col("o_orderkey")
    b = o.where("o_orderkey % 4 <> 1").select("o_orderkey", F.when(k % 3 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(k % 5 < 3, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), "o_orderpriority")
    return a, b


_A = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 4 <> 0)"
_B = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 < 3 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 1)"


@query(f"SELECT coalesce(a.column_name, b.column_name) AS \"column\", CASE WHEN b.column_name IS NULL THEN 'removed' WHEN a.column_name IS NULL THEN 'added' ELSE 'common' END AS status FROM (SELECT column_name FROM (DESCRIBE SELECT * FROM {_A})) a FULL JOIN (SELECT column_name FROM (DESCRIBE SELECT * FROM {_B})) b USING (column_name)")
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    return V.schema_diff(*versions(spark, d))


@query(f"SELECT 'both' AS status, count(*) AS n FROM {_A} a JOIN {_B} b USING (o_orderkey) UNION ALL SELECT 'only_a', count(*) FROM {_A} a ANTI JOIN {_B} b USING (o_orderkey) UNION ALL SELECT 'only_b', count(*) FROM {_B} b ANTI JOIN {_A} a USING (o_orderkey)")
def key_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return V.key_reconcile(*versions(spark, d), "o_orderkey")


def _side(t: str, c: str, kind: str) -> str:
    return f"SELECT '{c}' AS c, {kind} AS k, {four(f'(count(*) - count({c})) / count(*)')} AS nl, count(DISTINCT {c}) AS dc FROM {t}"


_NUMERIC_KIND = "CASE WHEN bool_and(o_totalprice = floor(o_totalprice)) THEN 'integer' ELSE 'decimal' END"
_SIDES = [(c, k) for c, k in (("o_orderkey", "'integer'"), ("o_custkey", "'integer'"), ("o_orderstatus", "'text'"), ("o_totalprice", _NUMERIC_KIND))]


@query(f"SELECT a.c AS \"column\", a.k AS type_a, b.k AS type_b, a.nl AS null_a, b.nl AS null_b, a.dc AS distinct_a, b.dc AS distinct_b, CASE WHEN a.k <> b.k OR abs(a.nl - b.nl) >= 0.2 THEN 'high' ELSE 'medium' END AS severity FROM ({' UNION ALL '.join(_side(_A, c, k) for c, k in _SIDES)}) a JOIN ({' UNION ALL '.join(_side(_B, c, k) for c, k in _SIDES)}) b ON a.c = b.c WHERE a.k <> b.k OR abs(a.nl - b.nl) >= 0.05 OR abs(b.dc - a.dc) >= 0.2 * greatest(a.dc, 1)")
def column_behaviour(spark: SparkSession, d: str) -> DataFrame:
    return V.column_behaviour(*versions(spark, d))


@query(f"SELECT 'o_totalprice' AS \"column\", {four('ma')} AS median_a, {four('mb')} AS median_b, {four('abs(mb - ma) / (q3 - q1)')} AS shift, abs(mb - ma) / (q3 - q1) >= 0.5 AS drifted FROM (SELECT median(o_totalprice) AS ma, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM {_A}), (SELECT median(o_totalprice) AS mb FROM {_B})")
def numeric_drift(spark: SparkSession, d: str) -> DataFrame:
    out = V.numeric_drift(*versions(spark, d), ["o_totalprice"])
    return out.withColumns({c: F.floor(F.col(c) * 10000 + 0.5) / 10000.0 for c in ("median_a", "median_b")})


@query(f"SELECT 'o_orderstatus' AS \"column\", {four('sum(abs(coalesce(pa, 0) - coalesce(pb, 0))) / 2')} AS distance, {four('sum(abs(coalesce(pa, 0) - coalesce(pb, 0))) / 2')} >= 0.2 AS drifted FROM (SELECT o_orderstatus AS v, count(*) / (SELECT count(*) FROM {_A}) AS pa FROM {_A} GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS v, count(*) / (SELECT count(*) FROM {_B}) AS pb FROM {_B} GROUP BY 1) b USING (v)")
def categorical_drift(spark: SparkSession, d: str) -> DataFrame:
    return V.categorical_drift(*versions(spark, d), ["o_orderstatus"])


@query(f"SELECT 'high' AS severity, 'column removed' AS kind, 'o_orderdate' AS subject UNION ALL SELECT 'medium', 'column added', 'o_orderpriority' UNION ALL SELECT CASE WHEN abs(b - a) >= 0.5 * a THEN 'high' ELSE 'medium' END, 'volume', a || ' to ' || b FROM (SELECT (SELECT count(*) FROM {_A}) AS a, (SELECT count(*) FROM {_B}) AS b) WHERE abs(b - a) >= 0.2 * a")
def version_warnings(spark: SparkSession, d: str) -> DataFrame:
    return V.compare_versions(*versions(spark, d))


_CONTRACT = (("o_orderkey", "integer", True, True, 0), ("o_custkey", "integer", False, True, 0), ("o_orderstatus", "text", False, False, 3), ("o_totalprice", "decimal", False, True, 0), ("o_orderdate", "date", False, False, 0))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, 0.05 AS max_null, {f'count(DISTINCT {c}) >= 0.999 * count(*)'} AS unique, {f'min({c})::DOUBLE' if num else 'NULL::DOUBLE'} AS lo, {f'max({c})::DOUBLE' if num else 'NULL::DOUBLE'} AS hi, {n} AS n_domain FROM {_A}" for c, k, _, num, n in _CONTRACT))
def contract_generate(spark: SparkSession, d: str) -> DataFrame:
    return V.contract_table(versions(spark, d)[0])


def _violations() -> str:
    lo, hi = f"(SELECT min({{c}}) FROM {_A})", f"(SELECT max({{c}}) FROM {_A})"
    out = ["SELECT 'high' AS severity, 'missing column' AS kind, 'o_orderdate' AS \"column\", 1::BIGINT AS n_violations", "SELECT 'low', 'new column', 'o_orderpriority', 1::BIGINT"]
    out.append(f"SELECT 'high', 'nulls', 'o_custkey', count(*) - count(o_custkey) FROM {_B} HAVING count(*) - count(o_custkey) > 0.05 * count(*)")
    for c in ("o_orderkey", "o_totalprice"):
        out.append(f"SELECT 'high', 'uniqueness', '{c}', count({c}) - count(DISTINCT {c}) AS n FROM {_B} HAVING n > 0 AND (SELECT count(DISTINCT {c}) >= 0.999 * count(*) FROM {_A})")
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        out.append(f"SELECT 'medium', 'range', '{c}', count(*) FILTER (WHERE {c} < {lo.format(c=c)} OR {c} > {hi.format(c=c)}) AS n FROM {_B} HAVING n > 0")
    return " UNION ALL ".join(out)


@query(_violations())
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    a, b = versions(spark, d)
    return V.validate_contract(b, V.generate_contract(a))


def extractions(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    o = read(spark, d, "orders")
    months = [("1995-01", 1), ("1995-02", 2), ("1995-03", 3)]
    out = [(n, o.where((F.year("o_orderdate") == 1995) & (F.month("o_orderdate") == m))) for n, m in months]
    return [out[0], (out[1][0], out[1][1].where("o_orderkey % 2 = 0")), (out[2][0], out[2][1].withColumn("extra", F.lit(None).cast("string")))]


SCORES = {"1995-01": 92.0, "1995-02": 85.5, "1995-03": 55.0}
_HISTORY = "SELECT 1 AS seq, '1995-01' AS name, count(*) AS n_rows, 6 AS n_columns, 0 AS n_null_columns, 92.0::DOUBLE AS score FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1995-01' UNION ALL SELECT 2, '1995-02', count(*), 6, 0, 85.5 FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1995-02' AND o_orderkey % 2 = 0 UNION ALL SELECT 3, '1995-03', count(*), 7, 1, 55.0 FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1995-03'"


@query(_HISTORY)
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.history_summary(extractions(spark, d), SCORES)


@query(f"WITH h AS (SELECT *, lag(n_rows) OVER w AS pr, lag(n_columns) OVER w AS pc, lag(score) OVER w AS ps FROM ({_HISTORY}) WINDOW w AS (ORDER BY seq)) SELECT seq, 'low score' AS kind FROM h WHERE score < 60 UNION ALL SELECT seq, 'score fell' FROM h WHERE ps - score >= 5 UNION ALL SELECT seq, 'columns changed' FROM h WHERE n_columns <> pc UNION ALL SELECT seq, 'volume changed' FROM h WHERE abs(n_rows - pr) * 100 >= 20 * greatest(pr, 1)")
def history_alerts(spark: SparkSession, d: str) -> DataFrame:
    return V.history_alerts(V.history_summary(extractions(spark, d), SCORES))


# --- quality -----------------------------------------------------------------

_DEFECT = {"qty": 0.0, "price": 0.6, "flag": 0.6, "shipped": 0.6}
_DAMAGE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {four(f'(count(*) - count({c})) / count(*) + {w}')} AS damage, CASE WHEN count(*) > count({c}) THEN 'nulls' || '{',sentinel' if w else ''}' ELSE '{'sentinel' if w else ''}' END AS reasons FROM {DIRTY_LINEITEM}" for c, w in _DEFECT.items())


@query(_DAMAGE)
def damage_by_column(spark: SparkSession, d: str) -> DataFrame:
    return Q.column_damage(Q.defects(dirty_lineitem(spark, d)))


_ONE = f"SELECT (SELECT avg(damage) FROM ({_DAMAGE})) AS m, (SELECT sum(c - 1) / sum(c) FROM (SELECT count(*) AS c FROM {DIRTY_LINEITEM} GROUP BY qty, price, flag, shipped)) AS dup"


@query(f"SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade, {four('m')} AS mean_damage, {four('dup')} AS table_damage FROM (SELECT m, {four('dup')} AS dup, floor(1000 * (1 - (0.85 * m + 0.15 * {four('dup')})) + 0.5) / 10.0 AS score FROM ({_ONE}))")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return Q.quality_score(dirty_lineitem(spark, d))


_PEOPLE = "(SELECT regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') || '@mail.org' AS email, lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') || '-000' AS zip, c_mktsegment FROM customer)"


def _exposed() -> str:
    each = [f"SELECT {PERSONAL_WEIGHTS[k]} AS w FROM {_PEOPLE} HAVING count(*) FILTER (WHERE regexp_matches({c}, '{PATTERNS[k]}')) >= 0.75 * count({c})" for c in ("email", "zip", "c_mktsegment") for k in ("E-mail", "CEP")]
    return f"SELECT exposure, CASE WHEN exposure >= 0.8 THEN 'high' WHEN exposure >= 0.5 THEN 'medium' WHEN exposure > 0 THEN 'low' ELSE 'none' END AS level, n_columns FROM (SELECT {four('least(1.0, coalesce(max(w), 0) + 0.05 * greatest(count(*) - 1, 0))::DOUBLE')} AS exposure, count(*) AS n_columns FROM ({' UNION ALL '.join(each)}))"


@query(_exposed())
def personal_data_exposure(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    t = c.select(F.concat(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), F.lit("@mail.org")).alias("email"), F.concat(F.lpad((F.col("c_custkey") % 90000 + 10000).cast("string"), 5, "0"), F.lit("-000")).alias("zip"), "c_mktsegment")
    return Q.personal_exposure(t)


_HAVE = ("organization", "quantity", "money")
_NEED = ", ".join(f"('{i}', '{n}', {list(x)})" for i, n, x in KPI_RULES)


@query(f"SELECT id, name, CASE WHEN k = len(needed) THEN 'enabled' WHEN k > 0 THEN 'partial' ELSE 'blocked' END AS status, k::INT AS n_present, len(needed)::INT AS n_needed FROM (SELECT *, len(list_intersect(needed, {list(_HAVE)})) AS k FROM (VALUES {_NEED}) v(id, name, needed))")
def kpi_gap(spark: SparkSession, d: str) -> DataFrame:
    return Q.kpi_gap(spark, list(_HAVE))


_DAY = "1999-01-01"
_SENTINELS = f"SELECT 'flag' AS \"column\", count(*) FILTER (WHERE flag = 'N/A') AS n FROM {DIRTY_LINEITEM} UNION ALL SELECT 'price', count(*) FILTER (WHERE price = -1) FROM {DIRTY_LINEITEM} UNION ALL SELECT 'shipped', count(*) FILTER (WHERE shipped = TIMESTAMP '1900-01-01') FROM {DIRTY_LINEITEM}"
_GAPS = f"SELECT 'shipped' AS \"column\", max(m) - min(m) + 1 - count(DISTINCT m) AS n FROM (SELECT year(shipped) * 12 + month(shipped) AS m FROM {DIRTY_LINEITEM} WHERE shipped <= TIMESTAMP '{_DAY}')"


def _outlying(columns: tuple[str, ...], table: str) -> str:
    one = "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n, count(*) AS rows FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"
    return "SELECT \"column\", n FROM (" + " UNION ALL ".join(one.format(c=c, t=table) for c in columns) + ") WHERE floor(n / rows * 1000 + 0.5) > 10"


@query(f"SELECT \"column\", 'high' AS priority, 'Bronze' AS layer, 'turn sentinels into nulls' AS action, n AS rows_affected FROM ({_SENTINELS}) UNION ALL SELECT *, FROM (SELECT \"column\", 'medium', 'Bronze', 'check months without rows', n FROM ({_GAPS}) WHERE n > 0) UNION ALL SELECT \"column\", 'medium', 'Bronze', 'check dates in the future', n FROM (SELECT 'shipped' AS \"column\", count(*) FILTER (WHERE shipped > TIMESTAMP '{_DAY}') AS n FROM {DIRTY_LINEITEM}) WHERE n > 0 UNION ALL SELECT \"column\", 'medium', 'Silver', 'look into the outliers', n FROM ({_outlying(('qty', 'price'), DIRTY_LINEITEM)}) UNION ALL SELECT 'flag', 'medium', 'Bronze', 'check values of another shape', n FROM (SELECT count(*) FILTER (WHERE length(flag) > 1) AS n, count(flag) AS filled FROM {DIRTY_LINEITEM}) WHERE n > 0 AND filled - n >= 0.8 * filled".replace("SELECT *, FROM", "SELECT * FROM"))
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return Q.recommendations(dirty_lineitem(spark, d), "lineitem", as_of=_DAY)


@query("SELECT 'high' AS priority, 'remove duplicate rows' AS action, (sum(c) - count(*))::BIGINT::VARCHAR AS subject FROM (SELECT count(*) AS c FROM (SELECT n_name, n_regionkey FROM nation UNION ALL SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 5) GROUP BY ALL, n_name) UNION ALL SELECT 'medium', 'drop one of two equal columns', 'n_regionkey = again' FROM nation HAVING count(*) > 0 UNION ALL SELECT 'low', 'use smaller types', 'again to tinyint, n_regionkey to tinyint' FROM nation HAVING min(n_regionkey) >= -128 AND max(n_regionkey) <= 127".replace("GROUP BY ALL, n_name", "GROUP BY n_name, n_regionkey"))
def table_recommendations(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_regionkey").alias("again"))
    return Q.table_recommendations(n.unionByName(n.where("n_nationkey < 5")).drop("n_nationkey"))




_BUYERS = "(SELECT regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') || c_custkey || '@mail.org' AS email, CASE WHEN c_custkey % 10 = 0 THEN 'odd ' || c_custkey ELSE 'C-' || lpad((c_custkey % 9000 + 1000)::VARCHAR, 4, '0') END AS code, CASE WHEN c_custkey % 25 = 0 THEN 1e7 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 8 = 0 THEN TIMESTAMP '2001-05-01' ELSE TIMESTAMP '1995-03-01' END AS since FROM customer)"
_DIGITS = f"SELECT substr(floor(balance)::BIGINT::VARCHAR, 1, 1)::INT AS digit, count(*) AS n FROM {_BUYERS} WHERE balance >= 100 GROUP BY 1"
_OFF = f"SELECT max({four('abs(' + four('n / total') + ' - ' + four('log10(1 + 1 / digit)') + ')')}) AS off, sum(n)::BIGINT AS n FROM (SELECT digit, n, sum(n) OVER () AS total FROM ({_DIGITS}))"


@query(
    f"""SELECT 'email' AS "column", 'high' AS priority, 'Silver' AS layer, 'mask the personal data' AS action, count(email) AS rows_affected FROM {_BUYERS} HAVING count(*) FILTER (WHERE regexp_matches(email, '{PATTERNS["E-mail"]}')) >= 0.75 * count(email)
    UNION ALL SELECT 'email', 'medium', 'Silver', 'make a surrogate key and keep the personal one hashed', count(email) FROM {_BUYERS} HAVING count(DISTINCT email) = count(*)
    UNION ALL SELECT 'code', 'medium', 'Bronze', 'check values of another shape', count(*) FILTER (WHERE NOT regexp_matches(code, '^C-[0-9]{{4}}$')) FROM {_BUYERS} HAVING count(*) FILTER (WHERE regexp_matches(code, '^C-[0-9]{{4}}$')) >= 0.8 * count(*)
    UNION ALL SELECT 'code', 'medium', 'Silver', 'use as a key', count(code) FROM {_BUYERS} HAVING count(DISTINCT code) = count(*)
    UNION ALL SELECT "column", 'medium', 'Silver', 'look into the outliers', n FROM ({_outlying(("balance",), _BUYERS)})
    UNION ALL SELECT 'since', 'medium', 'Bronze', 'check dates in the future', count(*) FILTER (WHERE since > TIMESTAMP '{_DAY}') FROM {_BUYERS} HAVING count(*) FILTER (WHERE since > TIMESTAMP '{_DAY}') > 0
    UNION ALL SELECT 'balance', 'low', 'Silver', 'compare first digits with the source', n FROM ({_OFF}) WHERE off >= 0.05"""
)
def recommendations_people(spark: SparkSession, d: str) -> DataFrame:
    """Personal data, codes of another shape, outliers, dates in the future, first digits."""
    k = F.col("c_custkey")
    t = read(spark, d, "customer").select(
        F.concat(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), k.cast("string"), F.lit("@mail.org")).alias("email"),
        F.when(k % 10 == 0, F.concat(F.lit("odd "), k.cast("string"))).otherwise(F.concat(F.lit("C-"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0"))).alias("code"),
        F.when(k % 25 == 0, F.lit(1e7)).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(k % 8 == 0, F.lit("2001-05-01").cast("timestamp_ntz")).otherwise(F.lit("1995-03-01").cast("timestamp_ntz")).alias("since"),
    )
    return Q.recommendations(t, "people", money=["balance"], as_of=_DAY)


def turns(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Turns of conversations, and marks given to some of them and to turns that do not exist."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    marks = c.where("conv_id % 3 = 0").select("conv_id", F.when(F.col("conv_id") % 4 == 0, F.col("turn") + 1000).otherwise(F.col("turn")).alias("turn"), (F.col("turn") * 2 + F.col("conv_id") % 2).alias("mark"))
    return {"turns": c, "marks": marks}


_MARKS = "(SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN turn + 1000 ELSE turn END AS turn FROM conversations WHERE conv_id % 3 = 0)"
_BOTH = f"SELECT count(DISTINCT (m.conv_id, m.turn)) AS tuples, count(DISTINCT CASE WHEN c.conv_id IS NOT NULL THEN (m.conv_id, m.turn) END) AS held, count(*) AS rows, count(*) FILTER (WHERE c.conv_id IS NULL) AS orphans FROM {_MARKS} m LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) c USING (conv_id, turn)"


@query(f"SELECT 'marks' AS src_table, 'conv_id, turn' AS src_cols, 'turns' AS dst_table, 'conv_id, turn' AS dst_cols, {four('held / tuples')} AS containment, {four('orphans / rows')} AS pct_orphans FROM ({_BOTH}) WHERE held >= 0.6 * tuples AND (SELECT count(*) = count(DISTINCT (conv_id, turn)) FROM conversations)")
def composite_fk_discovery(spark: SparkSession, d: str) -> DataFrame:
    return M.composite_discovery(turns(spark, d), _no_links(spark)).where("dst_table = 'turns'")


def _no_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src_table string, src_col string, dst_table string, dst_col string, pct_orphans double")


_SPAN = "SELECT (SELECT max(o_orderdate) FROM orders) AS a, (SELECT min(o_orderdate) + INTERVAL 40 YEAR FROM orders) AS b"


@query(
    f"""SELECT 'high' AS severity, 'types of a key differ' AS kind, 'orders.o_custkey = customer.c_custkey' AS subject FROM orders, customer WHERE o_custkey = c_custkey HAVING count(*) > 0
    UNION ALL SELECT 'high', 'grain violated', 'orders(o_custkey)' FROM orders HAVING count(*) > count(DISTINCT o_custkey)
    UNION ALL SELECT 'high', 'no overlap in time', strftime(b, '%Y-%m-%d') || ' > ' || strftime(a, '%Y-%m-%d') FROM ({_SPAN}) WHERE b > a
    UNION ALL SELECT 'medium', 'orphans of a key of several columns', 'marks(conv_id, turn)' FROM ({_BOTH}) WHERE {four('orphans / rows')} > 0.05 AND held >= 0.6 * tuples"""
)
def model_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Unlike types of a key, a repeated grain, dates that do not overlap, orphans of a key of two columns."""
    o = read(spark, d, "orders")
    t = {"orders": o.select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderdate"), "customer": read(spark, d, "customer").select("c_custkey"), "later": o.select(F.expr("o_orderdate + INTERVAL '40' YEAR").alias("day"))} | turns(spark, d)
    links = M.fk_discovery({k: t[k] for k in ("orders", "customer")}).where("src_col = 'o_custkey'")
    composites = M.composite_discovery({k: t[k] for k in ("turns", "marks")}, _no_links(spark)).where("dst_table = 'turns'")
    roles = spark.createDataFrame([("orders", 1, 0)], "table string, n_fk_out long, n_ref_by long")
    found = M.model_warnings(links, roles, t, composites, {"orders": ["o_custkey"]})
    return found.where("kind NOT IN ('orphans', 'isolated table')")
