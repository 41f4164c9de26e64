"""Queries on layout, shapes of columns, numeric documents, analyses and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import model as M
from ..sources import layout
from ..streaming import profiles
from .base import four, query, read


def shaped_customer(spark: SparkSession, d: str) -> DataFrame:
    """Columns of every shape."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        "c_custkey", F.lit("x").alias("constant"), F.when(k % 50 == 0, "b").otherwise("a").alias("quasi"), F.when(k % 40 == 0, F.lit(0)).otherwise(k).alias("nearly"),
        F.when(k % 10 == 0, None).otherwise(F.col("c_name")).alias("partly"), F.lit(None).cast("string").alias("nothing"), "c_mktsegment", (k % 60).alias("sixty"), "c_acctbal",
    )


_SHAPED = "(SELECT c_custkey, 'x' AS constant, CASE WHEN c_custkey % 50 = 0 THEN 'b' ELSE 'a' END AS quasi, CASE WHEN c_custkey % 40 = 0 THEN 0 ELSE c_custkey END AS nearly, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS partly, NULL::VARCHAR AS nothing, c_mktsegment, c_custkey % 60 AS sixty, c_acctbal FROM customer)"
_KINDS = {"c_custkey": "integer", "constant": "text", "quasi": "text", "nearly": "integer", "partly": "text", "nothing": "empty", "c_mktsegment": "text", "sixty": "integer", "c_acctbal": "decimal"}
_SHAPE = "CASE WHEN f = 0 THEN 'empty' WHEN nd = 1 THEN 'constant' WHEN top >= 0.95 * f THEN 'quasi-constant' WHEN kind IN ('integer', 'text') AND nd = f THEN 'potential key' WHEN kind IN ('integer', 'text') AND nd >= 0.95 * n THEN 'near key' WHEN nd <= 25 THEN 'category' WHEN nd <= 100 THEN 'dimension' WHEN kind = 'text' THEN 'free text' ELSE 'metric' END"


@query(f'SELECT c AS "column", kind AS logical_type, {_SHAPE} AS characteristic, {four("CASE WHEN f = 0 THEN 0 ELSE top / f END")} AS top_freq FROM (' + " UNION ALL ".join(f"SELECT '{c}' AS c, '{k}' AS kind, (SELECT count(*) FROM customer) AS n, coalesce(sum(m) FILTER (WHERE {c} IS NOT NULL), 0) AS f, count(*) FILTER (WHERE {c} IS NOT NULL) AS nd, coalesce(max(m) FILTER (WHERE {c} IS NOT NULL), 0) AS top FROM (SELECT {c}, count(*) AS m FROM {_SHAPED} GROUP BY {c})" for c, k in _KINDS.items()) + ")")
def column_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Constant, quasi-constant, near and potential keys, categories, dimensions, texts and metrics."""
    return C.column_profile(shaped_customer(spark, d), "customer").select("column", "logical_type", "characteristic", "top_freq")


@query(f"SELECT strftime(l_shipdate, '%Y') AS year, {four('count(*) FILTER (WHERE isodow(l_shipdate) >= 6) / count(*)')} AS weekend FROM lineitem GROUP BY 1")
def weekend_share(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem")
    return t.groupBy(F.date_format("l_shipdate", "yyyy").alias("year")).agg(C.ratio(F.count_if(F.weekday("l_shipdate") >= 5), F.count("*")).alias("weekend"))


def merged_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("_row"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("kind"), "user_id")


@query("SELECT event_id AS _row, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind, user_id FROM events")
def ffill_merged(spark: SparkSession, d: str) -> DataFrame:
    return layout.forward_fill(merged_events(spark, d), ["kind"])


@query("SELECT count(*) AS empty_rows FROM events WHERE event_id % 9 = 4 AND event_id > (SELECT min(event_id) FROM events WHERE event_id % 9 <> 4) AND event_id < (SELECT max(event_id) FROM events WHERE event_id % 9 <> 4)")
def multi_block(spark: SparkSession, d: str) -> DataFrame:
    blank = F.col("event_id") % 9 == 4
    t = read(spark, d, "events").select(F.col("event_id").alias("_row"), F.when(~blank, F.col("event_type")).alias("a"), F.when(~blank, F.col("value")).alias("b"))
    return spark.createDataFrame([(layout.multiple_blocks(t),)], "empty_rows long")


@query("SELECT 1 AS footer_rows, count(*) AS n_rows FROM part")
def footer_total(spark: SparkSession, d: str) -> DataFrame:
    """A row of sums after the data is found, and the data without it counted."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("_row"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("price"))
    total = p.agg((F.max("_row") + 1).alias("_row"), F.lit(None).cast("string").alias("name"), F.sum(F.col("price").cast("double")).cast("decimal(20,2)").cast("string").alias("price"))
    n = layout.footer(t := p.unionByName(total))
    return spark.createDataFrame([(n, t.count() - n)], "footer_rows int, n_rows long")


@query("SELECT 'doc' AS \"column\", count(*) AS n, 0::BIGINT AS n_cnpj FROM customer")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers as documents: none of a key's numbers is one of 12 to 14 digits."""
    return C.document_numbers(read(spark, d, "customer").select((F.col("c_custkey") + 10_000_000_000).alias("doc")), ["doc"]).select("column", "n", "n_cnpj")


@query("SELECT 'o_totalprice by c_mktsegment' AS analysis, c_mktsegment AS attribute, floor(sum(o_totalprice::DECIMAL(28,4))::DOUBLE * 100 + 0.5) / 100.0 AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'o_totalprice by n_name', n_name, floor(sum(o_totalprice::DECIMAL(28,4))::DOUBLE * 100 + 0.5) / 100.0 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 2")
def star_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Two analyses of one fact, the second over a chain of two dimensions."""
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    one = M.star_query(o, [(c, "o_custkey", "c_custkey")], "c_mktsegment", "o_totalprice", "sum").select(F.lit("o_totalprice by c_mktsegment").alias("analysis"), "*")
    two = M.star_query(o, [(c, "o_custkey", "c_custkey"), (n, "c_nationkey", "n_nationkey")], "n_name", "o_totalprice", "sum").select(F.lit("o_totalprice by n_name").alias("analysis"), "*")
    return one.unionByName(two).withColumn("value", F.floor(F.col("value") * 100 + 0.5) / 100.0)


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, {four('sum(value::DECIMAL(28,6))::DOUBLE')} AS total FROM events GROUP BY 1")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The streaming measure, run over a bounded table."""
    t = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(28,6)").alias("value"))
    return profiles.windowed_measure(t, "ts", "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", (F.floor(F.col("total").cast("double") * 10000 + 0.5) / 10000.0).alias("total"))


@query("SELECT 'warning' AS kind, 'orders.o_custkey' AS subject, 'high' AS severity FROM (SELECT count(*) FILTER (WHERE o_custkey % 10 = 0) / count(*) AS p FROM orders) WHERE p > 0.05")
def orphan_warnings(spark: SparkSession, d: str) -> DataFrame:
    """A key that lost a tenth of its rows leaves orphans."""
    t = {"orders": read(spark, d, "orders").select("o_orderkey", "o_custkey"), "customer": read(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey")}
    links = M.fk_discovery(t).where("src_col = 'o_custkey' AND dst_col = 'c_custkey'")
    return M.model_warnings(links, M.table_roles(t, {}, links)).where("kind = 'orphans'").select(F.lit("warning").alias("kind"), "subject", "severity")
