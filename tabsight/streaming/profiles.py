"""Structured Streaming forms of the profile: windowed measures with late data, and a summary a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key_string


def windowed_measure(stream: DataFrame, time: str, measure: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n, total, mean): a measure by tumbling windows; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum(measure).alias("total"), F.avg(measure).alias("mean")).select(F.col("w.start").alias("start"), "n", "total", "mean")


def batch_summary(df: DataFrame, batch: int) -> DataFrame:
    """(batch, column, n_rows, n_null, n_distinct) of one micro-batch; distinct values are estimated."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), (F.count("*") - F.count(key_string(df, c))).alias("n_null"), F.approx_count_distinct(key_string(df, c)).alias("n_distinct")) for c in df.columns))
    return df.agg(cells.alias("x")).select(F.lit(batch).alias("batch"), F.inline("x"))


def profile_batches(stream: DataFrame, path: str, checkpoint: str, **options):
    """Writes a summary of each micro-batch at ``path``; each batch's folder is overwritten, so a retried batch counts once."""

    def one(df: DataFrame, batch: int) -> None:
        batch_summary(df, batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).options(**options)
