"""The event journal as a stream, and state that depends on time: caches, budgets, deadlines, new files.

The clock is always an argument or a column, so that batch and stream, and one run and the next, agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..catalog import Tables, query

JOURNAL_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_journal(spark: SparkSession, folder: str, schema: str = JOURNAL_SCHEMA, delay: str = "1 hour") -> DataFrame:
    """New Parquet files of a folder as a stream of events, each once within the delay that late copies are waited for."""
    events = spark.readStream.schema(schema).parquet(folder)
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def window_counts(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind of event in tumbling windows; the same expression over a batch or a stream."""
    return (
        events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "cents")
    )


def run_counts(events: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what there is, exactly once, into Parquet by way of the checkpoint."""
    counts = window_counts(events)
    q = counts.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@query("str01_journal_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def journal_windows(t: Tables) -> DataFrame:
    return window_counts(t.events)


def fresh(cached_at: Column, now: Column, negative: Column, ttl: int = 86_400, negative_ttl: int = 3_600) -> Column:
    """Whether a cached answer still holds; an answer that nothing was found is kept for less long."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(cached_at.cast("timestamp"))
    return age <= F.when(negative, negative_ttl).otherwise(ttl)


@query("str02_ttl_cache", "SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts))) AS BIGINT) <= CASE WHEN event_type = 'error' THEN 3600 ELSE 86400 END AS fresh FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'")
def ttl_cache(t: Tables) -> DataFrame:
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return t.events.where(F.col("ts") <= now).select("event_id", fresh(F.col("ts"), now, F.col("event_type") == "error").alias("fresh"))


@query("str03_daily_budget", "SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def daily_budget(t: Tables) -> DataFrame:
    """The first calls of a day are let through; the count begins again with the date."""
    day = F.to_date("ts")
    nth = F.row_number().over(W.partitionBy(day, "user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", day.cast("string").alias("day"), (nth <= 3).alias("allowed"))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt: what the server asks for, else 2 to the attempt, at least half a second."""
    return F.greatest(F.coalesce(retry_after, F.pow(F.lit(2.0), attempt)), F.lit(0.5))


@query("str04_retries", "SELECT event_id, event_type IN ('error', 'signup') AND event_id % 4 < 3 AS retried, greatest(CASE WHEN event_id % 5 = 0 THEN 0.25::DOUBLE ELSE pow(2.0, event_id % 4) END, 0.5::DOUBLE) AS delay FROM events")
def retries(t: Tables) -> DataFrame:
    attempt = F.col("event_id") % 4
    delay = retry_delay(attempt.cast("double"), F.when(F.col("event_id") % 5 == 0, F.lit(0.25)))
    return t.events.select("event_id", (F.col("event_type").isin("error", "signup") & (attempt < 3)).alias("retried"), delay.alias("delay"))


@query("str05_checkpoints", "WITH f AS (SELECT user_id, min(ts) AS began FROM events GROUP BY user_id) SELECT e.user_id, e.event_type, max_by(e.event_id, (e.ts, e.event_id)) AS last FROM events e JOIN f USING (user_id) WHERE e.ts <= f.began + INTERVAL 10 DAY GROUP BY ALL")
def checkpoints(t: Tables) -> DataFrame:
    """The last value of each key among the events before the deadline of its run."""
    began = t.events.groupBy("user_id").agg(F.min("ts").alias("began"))
    before = t.events.join(began, "user_id").where(F.col("ts") <= F.col("began") + F.expr("INTERVAL 10 DAYS"))
    return before.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))


@query("str06_new_files", "SELECT d.file_hash, min(d.doc_id) AS doc_id FROM document d WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 2 = 0 AND 'h' || CAST(o.o_custkey AS STRING) = d.file_hash) GROUP BY d.file_hash")
def new_files(t: Tables) -> DataFrame:
    """Files whose content no earlier run of this version has seen."""
    done = t.orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("file_hash"))
    return t.document.join(done, "file_hash", "left_anti").groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
