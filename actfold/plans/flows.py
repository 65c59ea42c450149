"""Registered queries that run as Structured Streaming to their end and give the table they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actfold.plans import adapters as ad
from actfold.plans.catalog import FOLD, with_
from actfold.scratch import folder
from actfold.streaming import live

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; a single file is read through a pattern that only it fits."""
    return spark.readStream.schema(EVENTS).parquet(f"{d}/events.parque[t]")


def _finish(df: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Runs all that is there; update mode keeps each batch with its number, and the last row of a key counts."""
    at = folder(spark)

    def sink(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/part={n}")

    live.run_available(df, f"{at}/state", sink, mode).awaitTermination()
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d).select(F.lit("2024").alias("session"), F.col("user_id").alias("num"), F.col("ts").cast("timestamp").alias("ts"))
    out = _finish(live.first_seen(rows), spark, "update")
    return out.groupBy("session", "num").agg(F.min("first").alias("first")).withColumn("first", F.col("first").cast("timestamp_ntz"))


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    num = F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 3)
    action = ad.pick(ad.ACTIONS, (F.col("event_id") * 31 + F.col("user_id") * 17) % len(ad.ACTIONS))
    seq = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    rows = _stream(spark, d).select(F.lit("2024").alias("session"), num.alias("num"), seq.alias("seq"), action.alias("action"), F.lit("bill").alias("kind"))
    out = _finish(live.live_progress(rows), spark, "update")
    last = out.groupBy("session", "num").agg(F.max_by(F.struct("rank", "outcome", "events"), "_batch").alias("x"))
    return last.select("session", "num", F.col("x.rank").cast("long").alias("rank"), "x.outcome", "x.events")


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d).select(F.col("user_id").alias("subscriber_id"), F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    return _finish(live.once(rows), spark, "append").select("subscriber_id", "payload")


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    out = _finish(live.periods(_stream(spark, d)), spark, "append")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_KINDLESS = FOLD.replace("FROM history h LEFT JOIN bill b ON h.session = b.session AND h.num = b.num", "FROM history h LEFT JOIN (SELECT * FROM bill WHERE false) b ON h.num = b.num")
QUERIES = {f.__name__: f for f in (stream_first_seen, stream_progress, stream_once, stream_daily)}
SQL = {
    "stream_first_seen": "SELECT '2024' AS session, user_id AS num, min(ts) AS first FROM events GROUP BY ALL",
    "stream_progress": with_("history", "bill", more=_KINDLESS) + "SELECT h.session, h.num, coalesce(max(top), 0)::BIGINT AS rank, coalesce(any_value(settled), any_value(ending), 'pending') AS outcome, count(*) AS events FROM history h LEFT JOIN folded f ON h.num = f.num GROUP BY ALL",
    "stream_once": "SELECT DISTINCT user_id AS subscriber_id, event_type AS payload FROM events",
    "stream_daily": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
}
