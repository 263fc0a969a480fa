"""The table of events replayed as a stream; results land as Parquet in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans import shared_dir
from quernstone.queries import query
from quernstone.sources import table
from quernstone.streaming import breaker as B
from quernstone.streaming import limits as L

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: User and id of the event that only moves the watermark.
_BEAT = -(1 << 62)


def replay(spark: SparkSession, d: str, **limit) -> DataFrame:
    """Events as a stream, four files at a time or what ``limit`` says; times as timestamps."""
    # a pattern, because a stream takes a plain path for a folder, and the table may be one file
    path = f"{d}/events.parque[t]"
    events = spark.readStream.schema(table(spark, d, "events").schema).options(**limit or {"maxFilesPerTrigger": 4}).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def landed(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result; a complete result replaces the one before."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes over its own files
        where = f"{home}/rows" if mode == "complete" else f"{home}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(where)

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{home}/rows").select(*df.columns)


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_minute_count(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each kind in windows of a minute."""
    out = landed(L.requests_per_window(replay(spark, d), "event_type", "ts", "60 seconds", "60 seconds", "40 days"), "minutes", "complete")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("minute"), "n")


@query("""SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS spent, sum(CAST(value AS DECIMAL(18, 2))) > 1000 AS exceeded FROM events GROUP BY 1""")
def stream_running_budget(spark: SparkSession, d: str) -> DataFrame:
    out = landed(L.running_budget(replay(spark, d), "event_type", "value", 1000), "budgets", "complete")
    return out.select("event_type", F.col("spent").cast("double").alias("spent"), "exceeded")


@query()
def stream_circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """State of each user's breaker after every event."""
    events = replay(spark, d).select("user_id", "event_id", F.unix_micros("ts").alias("us"), (F.col("event_type") == "error").alias("failed"))
    return landed(L.circuit_breaker(events, "user_id", "event_id", "us", "failed"), "breakers", "append").select("key", "id", "state", "streak")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, coalesce(event_type = 'error', false) AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
z(user_id, i, event_id, state, streak, last) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, 'closed', 0::BIGINT, 0::BIGINT FROM o UNION ALL
SELECT o.user_id, o.i, o.event_id, CASE WHEN z.state = 'open' AND us - last < 60000000 THEN 'open' WHEN NOT failed THEN 'closed' WHEN z.state = 'open' OR streak + 1 >= 3 THEN 'open' ELSE z.state END,
CASE WHEN z.state = 'open' AND us - last < 60000000 THEN streak WHEN NOT failed THEN 0 ELSE streak + 1 END, CASE WHEN (z.state = 'open' AND us - last < 60000000) OR NOT failed THEN last ELSE us END FROM z JOIN o ON o.user_id = z.user_id AND o.i = z.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, state, CAST(streak AS INT) AS streak FROM z WHERE i > 0""")
def stream_event_time_breaker(spark: SparkSession, d: str) -> DataFrame:
    """The breakers in event time, whatever the order of files; a last beat moves the watermark past every event."""
    home = f"{shared_dir(spark)}/event-breakers-{uuid.uuid4().hex}"
    beats = f"{home}/beats"
    schema = "user_id long, event_id long, ts timestamp, failed boolean"
    spark.createDataFrame([], schema).write.parquet(beats)

    def go() -> None:
        # batches by bytes: their number doesn't grow with that of small files, and results don't depend on it
        events = replay(spark, d, maxBytesPerTrigger=256_000_000).select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
        both = events.unionByName(spark.readStream.schema(schema).parquet(beats))
        ours = spark.conf.get(_PROVIDER, None)
        spark.conf.set(_PROVIDER, B.ROCKSDB)
        try:
            out = B.event_time_breaker(both, "user_id", "event_id", "ts", "failed", "40 days")
            q = out.writeStream.outputMode("append").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{home}/rows/batch={n}")).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            spark.conf.unset(_PROVIDER) if ours is None else spark.conf.set(_PROVIDER, ours)

    go()
    last = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    if last is not None:
        beat = F.lit(last) + F.expr("INTERVAL 100 DAYS")
        spark.range(1).select(F.lit(_BEAT).cast("long").alias("user_id"), F.lit(_BEAT).cast("long").alias("event_id"), beat.alias("ts"), F.lit(False).alias("failed")).write.mode("append").parquet(beats)
        go()  # goes on from the checkpoint
    rows = spark.read.schema("key string, id long, state string, streak int").parquet(f"{home}/rows")
    return rows.where(F.col("id") != _BEAT).select("key", "id", "state", "streak")


@query("SELECT event_id, k AS part, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def stream_fan_out(spark: SparkSession, d: str) -> DataFrame:
    out = landed(L.fan_out(replay(spark, d), "event_id", "props"), "parts", "append")
    return out.select("event_id", F.col("key").alias("part"), "value")
