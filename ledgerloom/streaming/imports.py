"""Structured Streaming forms: files that arrive more than once, and refunds that come long after their payment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, key: str = "id", at: str = "ts", late: str = "7 days") -> DataFrame:
    """A record read again does not count again, as long as it comes within `late` of the newest seen."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_totals(rows: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Cents and rows for each day and bucket, final once the watermark has passed the day."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, "1 day").alias("_w"), "bucket").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("rows")).select(F.col("_w.start").alias("day"), "bucket", "cents", "rows")


def refunds_of(payments: DataFrame, refunds: DataFrame, days: int = 180, late: str = "2 days") -> DataFrame:
    """Refunds beside the payment that they name, up to `days` later; state is dropped when no refund can come any more."""
    p = payments.select(F.col("id").alias("payment"), F.col("ts").cast("timestamp").alias("paid_at"), F.col("cents").alias("paid_cents")).withWatermark("paid_at", late)
    r = refunds.select(F.col("id").alias("refund"), F.col("refund_of"), F.col("ts").cast("timestamp").alias("back_at"), F.col("cents").alias("back_cents")).withWatermark("back_at", late)
    return r.join(p, F.expr(f"refund_of = payment and back_at >= paid_at and back_at <= paid_at + interval {days} days"))


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with no pause of `gap` or more; works on a stream and on a table."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(key, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("_w.start").alias("first"), "events")
