"""Aggregations: statistics, summaries and health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scoring import EFFORT_LEVELS, GRADES, banded
from quernstone.functions.text import js_round
from quernstone.operators import relational as R
from quernstone.plans import broadcast_few, dealt
from quernstone.queries import query
from quernstone.sources import table

EVENT_KINDS = ["view", "click", "purchase", "error", "signup", "refund"]


@query("""SELECT k AS event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'error', 'signup', 'refund']) AS k) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON k = event_type""")
def stats_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return R.zero_filled(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", "n", EVENT_KINDS)


@query("SELECT coalesce(nullif(source, 'src0'), 'manual') AS source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang <> 'en' OR lang IS NULL) AS n_other FROM documents GROUP BY 1")
def count_by_source_coalesce(spark: SparkSession, d: str) -> DataFrame:
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    return table(spark, d, "documents").groupBy(F.coalesce(F.nullif("source", F.lit("src0")), F.lit("manual")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(en).alias("n_en"), F.count_if(~en).alias("n_other"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed,
CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS cost, round(avg(n), 6) AS mean_per_user FROM events, (SELECT avg(c) AS n FROM (SELECT count(*) AS c FROM events GROUP BY user_id))""")
def attempt_stats(spark: SparkSession, d: str) -> DataFrame:
    """One pass by user, then one row: totals and the mean number of attempts of a user."""
    per_user = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("event_type") == "purchase").alias("s"), F.count_if(F.col("event_type") == "error").alias("f"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return per_user.agg(F.sum("c").alias("total"), F.sum("s").alias("succeeded"), F.sum("f").alias("failed"), F.sum("v").cast("double").alias("cost"), F.round(F.avg("c"), 6).alias("mean_per_user"))


@query("SELECT event_type, round(avg(c), 6) AS mean_attempts FROM (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def nested_avg_attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c")).groupBy("event_type").agg(F.round(F.avg("c"), 6).alias("mean_attempts"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS a, max(ts) AS b, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, count(*) FILTER (WHERE done > 0) AS completed, round(avg(n), 6) AS mean_events, round(avg(CASE WHEN n > 1 THEN epoch(b) - epoch(a) END), 3) AS mean_seconds FROM s GROUP BY 1""")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sessions are a user's days; durations count where a session has an end."""
    day = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return day.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("done") > 0).alias("completed"), F.round(F.avg("n"), 6).alias("mean_events"), F.round(F.avg(F.when(F.col("n") > 1, secs("b") - secs("a"))), 3).alias("mean_seconds"))


@query("""SELECT event_type, CAST(coalesce(arg_max(h, n * 100 - h), 10) AS BIGINT) AS modal_hour FROM (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def modal_hour(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent hour, the lowest one of a tie."""
    by = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("event_type").agg(F.coalesce(F.max_by("h", F.struct("n", -F.col("h"))), F.lit(10)).cast("long").alias("modal_hour"))


@query("""SELECT o_custkey, count(*) AS audits, CAST(floor(avg(CAST(round(o_totalprice) AS BIGINT)) + 0.5) AS BIGINT) AS mean_score, CAST(max(round(o_totalprice)) AS BIGINT) AS best, CAST(min(round(o_totalprice)) AS BIGINT) AS worst FROM orders GROUP BY 1""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    score = F.round("o_totalprice").cast("long")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("audits"), js_round(F.avg(score)).alias("mean_score"), F.max(score).alias("best"), F.min(score).alias("worst"))


@query("""SELECT 'total' AS kind, '' AS name, count(*) AS n FROM part UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2 UNION ALL (SELECT 'top', CAST(l_partkey AS VARCHAR), count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 5)""")
def guardrail_stats(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "part").groupingSets([[], ["p_brand"], ["p_type"]], "p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("p_brand").alias("gb"), F.grouping("p_type").alias("gt"))
    kinds = by.select(F.when(F.col("gb") == 0, "brand").when(F.col("gt") == 0, "type").otherwise("total").alias("kind"), F.when(F.col("gb") == 0, F.col("p_brand")).when(F.col("gt") == 0, F.col("p_type")).otherwise("").alias("name"), "n")
    top = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(5)
    return kinds.unionByName(top.select(F.lit("top").alias("kind"), F.col("l_partkey").cast("string").alias("name"), "n"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT o_custkey, total, done, CAST(floor(100.0 * done / total + 0.5) AS BIGINT) AS progress, CASE WHEN floor(100.0 * done / total + 0.5) = 100 THEN 'done' WHEN done > 0 THEN 'in_progress' ELSE 'planning' END AS status FROM p""")
def progress_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    p = p.withColumn("progress", js_round(F.col("done") * 100.0 / F.col("total")))
    return p.withColumn("status", F.when(F.col("progress") == 100, "done").when(F.col("done") > 0, "in_progress").otherwise("planning"))


@query("""WITH p AS (SELECT o_custkey, floor(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) + 0.5) AS g FROM orders GROUP BY 1)
SELECT count(*) AS epics, count(*) FILTER (WHERE g < 100) AS active, count(*) FILTER (WHERE g = 100) AS completed, CAST(floor(avg(g) + 0.5) AS BIGINT) AS mean_progress FROM p""")
def epics_summary(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("progress")
    return progress_rollup(spark, d).agg(F.count(F.lit(1)).alias("epics"), F.count_if(g < 100).alias("active"), F.count_if(g == 100).alias("completed"), js_round(F.avg(g)).alias("mean_progress"))


@query("""SELECT user_id % 7 AS model, count(*) FILTER (WHERE event_type = 'purchase') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed,
count(*) FILTER (WHERE event_type IN ('purchase', 'error')) >= 3 AS enough, coalesce(round(1.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 6), 0) AS escalation_rate FROM events GROUP BY 1""")
def routing_stats(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("model")).agg(ok.alias("ok"), bad.alias("failed"), (ok + bad >= 3).alias("enough"), F.coalesce(F.round(F.try_divide(bad.cast("double"), ok + bad), 6), F.lit(0.0)).alias("escalation_rate"))


@query("""WITH a AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)
SELECT b.event_type, b.n, round(b.m, 4) AS mean_value FROM b LEFT JOIN a USING (event_type)""")
def running_mean(spark: SparkSession, d: str) -> DataFrame:
    """An old mean brought up to date with new rows: (mean * n + sum) / (n + m)."""
    e, cut = table(spark, d, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    stat = lambda x, s: x.groupBy("event_type").agg(F.count(F.lit(1)).alias(f"n{s}"), F.avg("value").alias(f"m{s}"))
    both = stat(e.where(F.col("ts") < cut), 1).join(stat(e.where(F.col("ts") >= cut), 2), "event_type", "full_outer").na.fill(0)
    n = F.col("n1") + F.col("n2")
    return both.select("event_type", n.alias("n"), F.round((F.col("m1") * F.col("n1") + F.col("m2") * F.col("n2")) / n, 4).alias("mean_value"))


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'all' END AS dimension, coalesce(o_orderstatus, o_orderpriority, '') AS member, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS cost
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cost"), F.grouping("o_orderstatus").alias("gs"), F.grouping("o_orderpriority").alias("gp"))
    return by.select(F.when(F.col("gs") == 0, "status").when(F.col("gp") == 0, "priority").otherwise("all").alias("dimension"), F.coalesce("o_orderstatus", "o_orderpriority", F.lit("")).alias("member"), "n", "cost")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, max(n_chars) AS longest, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("n_langs"), F.max("n_chars").alias("longest"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Line items as issues: the supplier is the file, the return flag the category, the quantity sets the severity."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("issue"), F.col("l_returnflag").alias("category"), F.when(q >= 45, "critical").when(q >= 30, "error").when(q >= 10, "warning").otherwise("info").alias("severity"), F.when(q >= 45, 1).when(q >= 30, 2).when(q >= 10, 3).otherwise(4).alias("priority"), (F.col("l_linestatus") == "F").alias("fixable"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") % 7).cast("long").alias("minutes"))


_ISSUES = """i AS (SELECT l_suppkey AS file, l_orderkey || ':' || l_linenumber AS issue, l_returnflag AS category, CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'error' WHEN l_quantity >= 10 THEN 'warning' ELSE 'info' END AS severity,
CASE WHEN l_quantity >= 45 THEN 1 WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 10 THEN 3 ELSE 4 END AS priority, l_linestatus = 'F' AS fixable, l_linenumber AS line, CAST(l_quantity % 7 AS BIGINT) AS minutes FROM lineitem)"""


@query(f"WITH {_ISSUES} SELECT category, severity, count(*) AS n, CAST(sum(minutes) AS BIGINT) AS minutes, CASE WHEN sum(minutes) <= 5 THEN 'trivial' WHEN sum(minutes) <= 15 THEN 'small' WHEN sum(minutes) <= 30 THEN 'medium' WHEN sum(minutes) <= 60 THEN 'large' ELSE 'complex' END AS effort FROM i GROUP BY 1, 2")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes")).withColumn("effort", banded(F.col("minutes"), EFFORT_LEVELS, "complex", upper=True))


@query(f"""WITH {_ISSUES} SELECT file, count(*) AS n, count(*) FILTER (WHERE fixable) AS n_fixable, min(priority) AS best_priority, CASE WHEN count(DISTINCT category) > 1 THEN 'mixed' ELSE min(category) END AS category, list_sort(list(DISTINCT severity)) AS severities FROM i GROUP BY 1""")
def group_issues(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("fixable").alias("n_fixable"), F.min("priority").alias("best_priority"), F.when(F.min("category") != F.max("category"), "mixed").otherwise(F.min("category")).alias("category"), F.array_sort(F.collect_set("severity")).alias("severities"))


@query(f"WITH {_ISSUES} SELECT file, count(*) AS n, min(priority) AS best_priority FROM i GROUP BY 1 ORDER BY n DESC, file LIMIT 5")
def hotspot_files(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("best_priority")).orderBy(F.desc("n"), "file").limit(5)


@query(f"WITH {_ISSUES} SELECT issue, file, minutes FROM i WHERE fixable AND minutes <= 1 ORDER BY minutes, priority, issue LIMIT 10")
def quick_wins(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d).where(F.col("fixable") & (F.col("minutes") <= 1)).orderBy("minutes", "priority", "issue").limit(10).select("issue", "file", "minutes")


@query("""SELECT s_suppkey, count(*) AS commits, count(*) FILTER (WHERE l_returnflag = 'R') AS fixes, count(*) FILTER (WHERE l_returnflag = 'N') AS features, CAST(floor(100.0 * rank_below / n_all + 0.5) AS BIGINT) AS percentile
FROM (SELECT l_suppkey AS s_suppkey, l_returnflag, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) JOIN (SELECT k, (SELECT count(*) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey) x WHERE x.c < y.c) AS rank_below, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_all FROM (SELECT l_suppkey AS k, count(*) AS c FROM lineitem GROUP BY 1) y) ON k = s_suppkey GROUP BY s_suppkey, rank_below, n_all""")
def file_history(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    by = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("commits"), F.count_if(flag == "R").alias("fixes"), F.count_if(flag == "N").alias("features"))
    return R.percentile_n(by, [], "commits", "percentile")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT p AS p_partkey, count(*) AS importers, count(DISTINCT s_nationkey) AS dirs, count(DISTINCT n_regionkey) AS packages
FROM e JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 5""")
def import_signals(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, nations and regions of each part: counted up from one level to the next where its lines are."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    at = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    e = dealt(li, li.count(), "p_partkey").distinct().join(broadcast_few(at), "s_suppkey")
    nations = e.groupBy("p_partkey", "n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))
    regions = nations.groupBy("p_partkey", "n_regionkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("dirs"))
    return regions.groupBy("p_partkey").agg(F.sum("n").alias("importers"), F.sum("dirs").alias("dirs"), F.count("n_regionkey").alias("packages")).where("importers >= 5")


@query(f"""WITH {_ISSUES}, g AS (SELECT file, category, severity, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT count(*) FILTER (WHERE n >= 3) AS clusters, CAST(coalesce(sum(n) FILTER (WHERE n >= 3), 0) AS BIGINT) AS clustered, CAST(coalesce(sum(n) FILTER (WHERE n < 3), 0) AS BIGINT) AS unclustered, CAST(floor(avg(n) FILTER (WHERE n >= 3) + 0.5) AS BIGINT) AS mean_size, max(n) AS largest FROM g""")
def cluster_issues(spark: SparkSession, d: str) -> DataFrame:
    g, n = issues(spark, d).groupBy("file", "category", "severity").agg(F.count(F.lit(1)).alias("n")), F.col("n")
    big = n >= 3
    return g.agg(F.count_if(big).alias("clusters"), F.coalesce(F.sum(F.when(big, n)), F.lit(0)).alias("clustered"), F.coalesce(F.sum(F.when(~big, n)), F.lit(0)).alias("unclustered"), js_round(F.avg(F.when(big, n))).alias("mean_size"), F.max("n").alias("largest"))


@query("SELECT split_part(p_type, ' ', 1) AS pattern, count(*) AS n, round(avg(CASE WHEN split_part(p_type, ' ', -1) IN ('STEEL', 'BRASS') THEN 1.0 ELSE 0.0 END), 6) AS coherence FROM part GROUP BY 1")
def pattern_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.split_part("p_type", F.lit(" "), F.lit(-1)).isin("STEEL", "BRASS"), 1.0).otherwise(0.0)), 6).alias("coherence"))


@query(f"""WITH {_ISSUES} SELECT file % 10 AS area, greatest(0, 100 - 15 * count(*) FILTER (WHERE severity = 'critical' AND line = 1) - 5 * count(*) FILTER (WHERE severity = 'error' AND line = 1)) AS score FROM i GROUP BY 1""")
def architecture_score(spark: SparkSession, d: str) -> DataFrame:
    s, one = F.col("severity"), F.col("line") == 1
    return issues(spark, d).groupBy((F.col("file") % 10).alias("area")).agg(F.greatest(F.lit(0), 100 - 15 * F.count_if((s == "critical") & one) - 5 * F.count_if((s == "error") & one)).alias("score"))


@query(f"""WITH {_ISSUES}, h AS (SELECT file, floor(100 * (1 - sum(CASE severity WHEN 'critical' THEN 10 WHEN 'error' THEN 3 WHEN 'warning' THEN 1 ELSE 0.1 END) / (10 * count(*))) + 0.5) AS score FROM i GROUP BY 1)
SELECT file, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM h""")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("severity") == "critical", 100).when(F.col("severity") == "error", 30).when(F.col("severity") == "warning", 10).otherwise(1)
    by = issues(spark, d).groupBy("file").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    score = js_round(100 * (1 - F.col("w") / (100 * F.col("n"))))
    return by.select("file", score.alias("score")).withColumn("grade", banded(F.col("score"), GRADES, "F"))


@query(f"""WITH {_ISSUES}, q AS (SELECT category, greatest(1, CAST(floor(count(*) * 50 / sum(count(*)) OVER ()) AS BIGINT)) AS quota FROM i GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority, issue) AS rn FROM i)
SELECT category, issue, priority FROM r JOIN q USING (category) ORDER BY CASE WHEN rn > quota THEN 1 ELSE 0 END, priority, issue LIMIT 50""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    """The most urgent issues, each category with its share of 50."""
    return R.proportional(issues(spark, d), "category", [F.col("priority"), F.col("issue")], 50).select("category", "issue", "priority")


@query("""WITH c AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS ca FROM lineitem GROUP BY 1), e AS (SELECT l_suppkey AS s, count(DISTINCT l_orderkey) AS ce FROM lineitem GROUP BY 1)
SELECT s, ca, ce, round(ce / (ca + ce), 6) AS instability FROM c JOIN e USING (s)""")
def degree_coupling(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.countDistinct("l_partkey").alias("ca"), F.countDistinct("l_orderkey").alias("ce"))
    return by.withColumn("instability", F.round(F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ca") + F.col("ce")), F.lit(0.0)), 6))
