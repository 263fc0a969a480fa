"""Scoring of tasks, costs and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import scoring as S
from quernstone.functions.text import js_round
from quernstone.queries import query
from quernstone.sources import table


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks: the priority sets the complexity, line items are files, the status gives tags."""
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("l_suppkey").alias("criteria"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(files, "o_orderkey", "left").na.fill(0, ["files", "criteria"])
    complexity = S.mapped(F.col("o_orderpriority"), {"1-URGENT": "epic", "2-HIGH": "complex", "3-MEDIUM": "moderate", "4-NOT SPECIFIED": "simple"}, "trivial")
    tags = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("security"), F.lit("api"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("docs"))).otherwise(F.array(F.lit("migration"), F.lit("typo")))
    return o.select("o_orderkey", complexity.alias("complexity"), "files", "criteria", tags.alias("tags"))


_TASKS = """f AS (SELECT l_orderkey, count(*) AS files, count(DISTINCT l_suppkey) AS criteria FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'epic' WHEN '2-HIGH' THEN 'complex' WHEN '3-MEDIUM' THEN 'moderate' WHEN '4-NOT SPECIFIED' THEN 'simple' ELSE 'trivial' END AS complexity, coalesce(files, 0) AS files, coalesce(criteria, 0) AS criteria, CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'O' THEN -10 ELSE -10 END AS boost FROM orders LEFT JOIN f ON o_orderkey = l_orderkey),
s AS (SELECT *, greatest(0, least(100, CASE complexity WHEN 'epic' THEN 95 WHEN 'complex' THEN 75 WHEN 'moderate' THEN 50 WHEN 'simple' THEN 25 ELSE 10 END + 5 * greatest(0, files - 2) + 3 * greatest(0, criteria - 2) + boost)) AS score FROM t),
r AS (SELECT *, CASE WHEN score <= 20 THEN 'free' WHEN score <= 40 THEN 'cheap' WHEN score <= 65 THEN 'mid' ELSE 'premium' END AS tier FROM s)"""


@query(f"WITH {_TASKS} SELECT o_orderkey, CAST(score AS BIGINT) AS score, tier, CASE WHEN tier = 'premium' THEN least(5, CAST(ceil(score / 25.0) AS BIGINT)) ELSE 1 END AS agents FROM r")
def task_scoring(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d).select("o_orderkey", S.task_score(F.col("complexity"), F.col("files"), F.col("criteria"), F.col("tags")).cast("long").alias("score"))
    t = t.withColumn("tier", S.tier(F.col("score")))
    return t.withColumn("agents", F.when(F.col("tier") == "premium", F.least(F.lit(5), F.ceil(F.col("score") / 25))).otherwise(F.lit(1)).cast("long"))


@query(f"""WITH {_TASKS}, m AS (SELECT *, CASE complexity WHEN 'epic' THEN 2.5 WHEN 'complex' THEN 1.5 WHEN 'moderate' THEN 1.0 WHEN 'simple' THEN 0.75 ELSE 0.5 END * (1 + 0.1 * files) AS k FROM r),
c AS (SELECT o_orderkey, tier, CAST(floor(4000 * k + 0.5) AS BIGINT) AS tokens_in, CAST(floor(2000 * k + 0.5) AS BIGINT) AS tokens_out, CASE tier WHEN 'free' THEN 0.3 WHEN 'cheap' THEN 0.2 WHEN 'mid' THEN 0.1 ELSE 0 END AS p, CASE tier WHEN 'free' THEN 0 WHEN 'cheap' THEN 0.075 WHEN 'mid' THEN 1.25 ELSE 15 END AS pi, CASE tier WHEN 'free' THEN 0 WHEN 'cheap' THEN 0.3 WHEN 'mid' THEN 5 ELSE 75 END AS po FROM m)
SELECT o_orderkey, tokens_in, tokens_out, round((tokens_in / 1e6 * pi + tokens_out / 1e6 * po) * (1 - p) + (tokens_in / 1e6 * 15 + tokens_out / 1e6 * 75) * p, 8) AS expected_cost FROM c""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d).withColumn("tier", S.tier(S.task_score(F.col("complexity"), F.col("files"), F.col("criteria"), F.col("tags"))))
    tin, tout = S.token_estimate(F.col("complexity"), F.col("files"))
    return t.select("o_orderkey", "tier", tin.alias("tokens_in"), tout.alias("tokens_out")).select("o_orderkey", "tokens_in", "tokens_out", F.round(S.expected_cost(F.col("tier"), F.col("tokens_in"), F.col("tokens_out")), 8).alias("expected_cost"))


@query(f"""WITH {_TASKS}, h AS (SELECT complexity, boost, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS ok, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS failed FROM t GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN ok + failed > 5 AND tier = 'cheap' AND failed / (ok + failed) > 0.5 THEN 'mid' WHEN ok + failed > 5 AND tier = 'mid' AND ok / (ok + failed) > 0.6 THEN 'mid' ELSE tier END AS tier FROM r JOIN h USING (complexity, boost)""")
def history_adjustment(spark: SparkSession, d: str) -> DataFrame:
    """Tiers after the history of tasks of the same complexity and tags; every third order counts as failed."""
    t = tasks(spark, d).withColumn("tier", S.tier(S.task_score(F.col("complexity"), F.col("files"), F.col("criteria"), F.col("tags"))))
    group = F.when(F.array_contains("tags", "api"), 20).otherwise(-10)
    t = t.withColumn("boost", group)
    failed = F.col("o_orderkey") % 3 == 0
    h = t.groupBy("complexity", "boost").agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))
    return t.join(h, ["complexity", "boost"]).select("o_orderkey", S.adjusted_tier(F.col("tier"), F.col("ok"), F.col("failed")).alias("tier"))


@query(f"""WITH {_TASKS} SELECT o_orderkey, substr(md5('{{"complexity":"' || complexity || '","tags":["' || CASE WHEN boost = 20 THEN 'api","security' ELSE CASE WHEN (SELECT o_orderstatus FROM orders o WHERE o.o_orderkey = t.o_orderkey) = 'O' THEN 'docs' ELSE 'migration","typo' END END || '"],"filesRange":"' || CASE WHEN files <= 2 THEN 'few' WHEN files <= 5 THEN 'some' ELSE 'many' END || '"}}'), 1, 12) AS signature FROM t""")
def task_signatures(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).select("o_orderkey", S.signature(F.col("complexity"), F.col("tags"), F.col("files")).alias("signature"))


@query("""WITH u AS (SELECT l_partkey, count(*) AS uses, count(DISTINCT l_suppkey) AS dirs FROM lineitem GROUP BY 1), s AS (SELECT p_partkey, least(100, 25 * CASE WHEN uses >= 10 THEN 1 ELSE 0 END + 20 * CASE WHEN dirs >= 4 THEN 1 ELSE 0 END + 30 * CASE WHEN dirs >= 2 THEN 1 ELSE 0 END + 3 * least(coalesce(uses, 0), 10)) AS score FROM part LEFT JOIN u ON p_partkey = l_partkey)
SELECT p_partkey, CAST(score AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'core' WHEN score >= 50 THEN 'shared' WHEN score >= 30 THEN 'local' WHEN score >= 10 THEN 'rare' ELSE 'unused' END AS level FROM s""")
def reusability(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("l_suppkey").alias("dirs"))
    p = table(spark, d, "part").select("p_partkey").join(u, "p_partkey", "left").na.fill(0)
    on = lambda hit, n: F.when(hit, n).otherwise(0)
    score = F.least(F.lit(100), on(F.col("uses") >= 10, 25) + on(F.col("dirs") >= 4, 20) + on(F.col("dirs") >= 2, 30) + 3 * F.least("uses", F.lit(10)))
    return p.select("p_partkey", score.cast("long").alias("score")).withColumn("level", S.banded(F.col("score"), S.REUSE_LEVELS, "unused"))


@query("""SELECT doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens, CASE WHEN n_lines >= 800 THEN 'critical' WHEN n_lines >= 500 THEN 'error' WHEN n_lines >= 300 THEN 'warning' ELSE 'ok' END AS size_severity, CAST(least(100, floor(100.0 * ceil(n_chars / 4.0) / 2000 + 0.5)) AS BIGINT) AS budget_used,
round(CASE WHEN contains(source, 'src1') THEN 0.1 ELSE 1.0 END * CASE WHEN lang = 'en' THEN 1.5 ELSE 1.0 END * CASE WHEN n_chars > 5000 THEN 1.2 ELSE 1.0 END, 6) AS finding_score FROM (SELECT *, len(string_split(text, chr(10))) AS n_lines FROM documents)""")
def document_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tokens = F.ceil(F.col("n_chars") / 4)
    one = F.lit(1.0)
    score = S.finding_score(F.when(F.col("source").contains("src1"), 0.1).otherwise(1.0), one, F.when(F.col("n_chars") > 5000, 1.2).otherwise(1.0), F.when(F.col("lang") == "en", 1.5).otherwise(1.0), one)
    return docs.select("doc_id", tokens.cast("long").alias("tokens"), S.banded(F.size(F.split("text", "\n")), S.FILE_SIZES, "ok").alias("size_severity"), F.least(F.lit(100), js_round(100.0 * tokens / 2000)).cast("long").alias("budget_used"), F.round(score, 6).alias("finding_score"))
