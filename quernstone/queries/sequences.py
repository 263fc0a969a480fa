"""Order-dependent reports: ranks, trends, running totals, limits over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.scoring import banded
from quernstone.operators import relational as R
from quernstone.queries import query
from quernstone.sources import table


@query("""SELECT p_partkey, p_brand, CAST(floor(100.0 * (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1) / count(*) OVER (PARTITION BY p_brand) + 0.5) AS BIGINT) AS percentile FROM part""")
def percentile_rank_n(spark: SparkSession, d: str) -> DataFrame:
    return R.percentile_n(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", "percentile").select("p_partkey", "p_brand", "percentile")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 2")
def previous_row(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    top = R.newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 2)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return top.withColumn("rn", F.row_number().over(w)).where("rn = 2").select("user_id", "event_id")


@query("""WITH r AS (SELECT o_custkey, CAST(round(o_totalprice / 1000) AS BIGINT) AS score, lag(CAST(round(o_totalprice / 1000) AS BIGINT)) OVER w AS prev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, score, prev, score - prev AS delta, CASE WHEN prev IS NULL THEN 'stable' WHEN score - prev >= 5 THEN 'improving' WHEN score - prev <= -5 THEN 'declining' ELSE 'stable' END AS trend FROM r WHERE rn = 1""")
def score_trend(spark: SparkSession, d: str) -> DataFrame:
    two = R.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") / 1000).cast("long").alias("score")), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    last = two.withColumn("prev", F.lag("score").over(w)).withColumn("_last", F.lead("score").over(w).isNull()).where("_last")
    delta = F.col("score") - F.col("prev")
    return last.select("o_custkey", "score", "prev", delta.alias("delta"), F.when(delta >= 5, "improving").when(delta <= -5, "declining").otherwise("stable").alias("trend"))


@query("SELECT doc_id, source, round(n_chars / greatest(max(n_chars) OVER (PARTITION BY source), 1), 6) AS share, round(100.0 * n_chars / greatest(max(n_chars) OVER (PARTITION BY lang), 0.01), 4) AS of_lang FROM documents")
def max_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Scores by the best of a group; maxima are aggregated first, so a large group isn't gathered."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    best = lambda k, least: docs.groupBy(k).agg(F.greatest(F.max("n_chars").cast("double"), F.lit(least)).alias(f"m_{k}"))
    out = R.null_safe_join(R.null_safe_join(docs, best("source", 1.0), ["source"]), best("lang", 0.01), ["lang"])
    return out.select("doc_id", "source", F.round(F.col("n_chars") / F.col("m_source"), 6).alias("share"), F.round(100.0 * F.col("n_chars") / F.col("m_lang"), 4).alias("of_lang"))


@query("""WITH m AS (SELECT p_brand, l_shipmode, count(*) AS n, round(1.0 * count(*) FILTER (WHERE l_returnflag <> 'R') / count(*), 6) AS rate, round(avg(CAST(l_extendedprice AS DECIMAL(18, 2))), 4) AS cost
FROM (SELECT l_partkey, l_returnflag, l_extendedprice, l_linenumber AS l_shipmode FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, l_shipmode AS model, n, rate FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rate DESC, cost, l_shipmode) AS rn FROM m WHERE n >= 3) WHERE rn = 1""")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    """Of the models with three samples the one that succeeds most, then the cheapest."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", F.col("l_linenumber").alias("model"))
    m = li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("l_returnflag") != "R") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 4).alias("cost"))
    return R.newest(m.where("n >= 3"), ["p_brand"], [F.desc("rate"), F.col("cost"), F.col("model")]).select("p_brand", "model", "n", "rate")


@query("""WITH c AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS ca, CAST(sum(l_quantity) AS BIGINT) AS pr FROM lineitem GROUP BY 1),
p AS (SELECT s, ca, floor(100.0 * (rank() OVER (ORDER BY ca) - 1) / count(*) OVER () + 0.5) AS pc, floor(100.0 * (rank() OVER (ORDER BY pr) - 1) / count(*) OVER () + 0.5) AS pp FROM c)
SELECT s, CASE WHEN ca = 0 OR pc < 20 AND pp < 20 THEN 'leaf' WHEN pc >= 80 OR pp >= 80 THEN 'core' ELSE 'intermediate' END AS class FROM p""")
def core_leaf(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.countDistinct("l_partkey").alias("ca"), F.sum("l_quantity").cast("long").alias("pr"))
    p = R.percentile_n(R.percentile_n(c, [], "ca", "pc"), [], "pr", "pp")
    low, high = (F.col("ca") == 0) | (F.col("pc") < 20) & (F.col("pp") < 20), (F.col("pc") >= 80) | (F.col("pp") >= 80)
    return p.select("s", F.when(low, "leaf").when(high, "core").otherwise("intermediate").alias("class"))


@query("""SELECT event_id, user_id, CAST(sum(v) OVER w AS DOUBLE) AS spent, sum(v) OVER w > 300 AS exceeded FROM (SELECT event_id, user_id, ts, CAST(value AS DECIMAL(18, 2)) AS v FROM events WHERE event_type <> 'view')
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """Spending so far; views are partial responses and don't count. Only more than the cap exceeds it."""
    e = table(spark, d, "events").where("event_type != 'view'").select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("v"))
    spent = F.sum("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", "user_id", spent.cast("double").alias("spent"), (spent > 300).alias("exceeded"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_minute FROM events""")
def sliding_minute_count(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the last 60 seconds, the older end left out."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("event_type").orderBy(micros).rangeBetween(-59_999_999, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("in_minute"))


@query("""WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, coalesce(gap < CASE WHEN before = 'error' THEN 30000000 ELSE 1000000 END, FALSE) AS too_soon FROM g""")
def minimum_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Requests less than a second after the one before, or 30 seconds after an error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    wait = F.when(F.lag("event_type").over(w) == "error", 30_000_000).otherwise(1_000_000)
    return table(spark, d, "events").select("event_id", F.coalesce(gap < wait, F.lit(False)).alias("too_soon"))


@query("""WITH f AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, user_id, CAST(sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS opens FROM f""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    e = R.streaks(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")
    return e.select("event_id", "user_id", "streak", (F.col("streak") >= 3).alias("opens"))


@query("""SELECT event_id, k AS part, json_extract_string(props, '$.k') AS value FROM events, (SELECT unnest(['validation', 'cost', 'retry']) AS k)
WHERE (k = 'validation' AND event_type = 'error') OR (k = 'cost' AND value > 50) OR (k = 'retry' AND event_type IN ('error', 'click'))""")
def event_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """One row for each part of the state that an event changes."""
    kind = F.col("event_type")
    parts = F.array_compact(F.array(F.when(kind == "error", "validation"), F.when(F.col("value") > 50, "cost"), F.when(kind.isin("error", "click"), "retry")))
    return table(spark, d, "events").select("event_id", F.explode(parts).alias("part"), F.get_json_object("props", "$.k").alias("value"))


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'view') WHERE rn <= 5")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    """The first events of a session in order; partial ones aren't stored."""
    e = table(spark, d, "events").where("event_type != 'view'").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 5").select("user_id", "event_id", "rn")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 3 DAY")
def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).where(F.expr("last < TIMESTAMP_NTZ '2024-02-01 00:00:00' - INTERVAL 3 DAYS")).select("user_id", "n")


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ago' WHEN s < 2592000 THEN CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || 'd ago' ELSE CAST(CAST(floor(s / 2592000) AS BIGINT) AS VARCHAR) || 'mo ago' END AS age,
CASE WHEN s / 86400 <= 7 THEN 'fresh' WHEN s / 86400 <= 21 THEN 'recent' ELSE 'old' END AS band FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-01' - ts) AS s FROM events)""")
def relative_ages(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.functions.text import relative_age

    s = (F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").select("event_id", relative_age(s).alias("age"), banded(s / 86400, [(7, "fresh"), (21, "recent")], "old", upper=True).alias("band"))
