"""Graph reports over links between suppliers, nations and conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scoring import impact_level
from quernstone.operators import graph as G
from quernstone.operators import relational as R
from quernstone.operators.cycles import shortest_cycles
from quernstone.plans import broadcast_few, dealt, shared_table
from quernstone.queries import query
from quernstone.queries.records import symbol_edges
from quernstone.sources import table

_EDGES = """s AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS ln, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT r.l_suppkey AS src, d.l_suppkey AS dst, CAST(sum(r.n) AS DOUBLE) AS w FROM s r JOIN s d ON r.l_partkey = d.l_partkey AND d.ln = 1 AND r.ln > 1 AND r.l_suppkey <> d.l_suppkey GROUP BY 1, 2)"""
#: Pairs of nations, customer to supplier, that trade more than the mean pair.
_NATIONS = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM t WHERE src <> dst AND n > 1.6 * (SELECT sum(n) FROM t) / 625)"""


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """The pairs are written once, at most a row for each two nations, so that no use of them joins the tables again."""
    li, orders = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    bought = dealt(orders, orders.count(), "o_custkey").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    sold = dealt(li, li.count(), "l_orderkey").join(broadcast_few(table(spark, d, "supplier")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    t = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    t = shared_table(t, "nation-pairs")
    total = t.agg(F.sum("n")).first()[0] or 0
    return t.where((F.col("src") != F.col("dst")) & (F.col("n") > 1.6 * total / 625)).select("src", "dst")


def _rank_sql(rounds: int) -> str:
    parts = [f"WITH {_EDGES}", "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "o AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e)", "r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM n) AS score FROM n)"]
    for k in range(rounds):
        parts.append(f"g{k} AS (SELECT dst AS node, sum(score * w) AS got FROM o JOIN r{k} ON src = node GROUP BY 1)")
        parts.append(f"r{k + 1} AS (SELECT r{k}.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(got, 0) + coalesce((SELECT sum(score) FROM r{k} WHERE node NOT IN (SELECT src FROM o)), 0) / (SELECT count(*) FROM n)) AS score FROM r{k} LEFT JOIN g{k} ON r{k}.node = g{k}.node)")
    return ", ".join(parts) + f" SELECT node, round(score, 8) AS score FROM r{rounds}"


@query(_rank_sql(8))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Eight rounds, so that the check can follow; production runs stop by tolerance."""
    e = symbol_edges(spark, d)
    return G.pagerank(e, max_rounds=8, tolerance=0.0).select("node", F.round("score", 8).alias("score"))


@query(f"""WITH {_EDGES}, a AS (SELECT dst AS node, count(*) AS ca FROM e GROUP BY 1), b AS (SELECT src AS node, count(*) AS ce FROM e GROUP BY 1), c AS (SELECT coalesce(a.node, b.node) AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM a FULL JOIN b ON a.node = b.node),
p AS (SELECT *, CAST(floor(100.0 * (rank() OVER (ORDER BY ca) - 1) / count(*) OVER () + 0.5) AS BIGINT) AS percentile FROM c)
SELECT node, ca, ce, round(ce / (ca + ce), 6) AS instability, percentile, CASE WHEN percentile >= 95 THEN 'critical' WHEN percentile >= 80 THEN 'high' WHEN percentile >= 50 THEN 'medium' ELSE 'low' END AS risk FROM p ORDER BY ca DESC, node LIMIT 10""")
def coupling_hotspots(spark: SparkSession, d: str) -> DataFrame:
    c = R.percentile_n(G.coupling(symbol_edges(spark, d)), [], "ca", "percentile")
    p = F.col("percentile")
    return c.orderBy(F.desc("ca"), "node").limit(10).select("node", "ca", "ce", F.round("instability", 6).alias("instability"), "percentile", F.when(p >= 95, "critical").when(p >= 80, "high").when(p >= 50, "medium").otherwise("low").alias("risk"))


@query(f"WITH {_EDGES} SELECT count(*) AS edges, count(DISTINCT src) AS sources, CAST(sum(w) AS BIGINT) AS weight FROM e")
def edge_count(spark: SparkSession, d: str) -> DataFrame:
    return symbol_edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.sum("weight").alias("weight"))


@query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS importers FROM e GROUP BY 1 HAVING count(*) >= 5")
def highly_connected(spark: SparkSession, d: str) -> DataFrame:
    return symbol_edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("importers")).where("importers >= 5")


@query(f"""WITH RECURSIVE {_NATIONS}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = node), node)) AS component FROM n""")
def strongly_connected(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(nation_edges(spark, d))


#: A sparse graph of suppliers: each to the ones a fixed step on within its block, which gives rings and chains.
_LOOPS = """b AS (SELECT s_suppkey AS s, s_suppkey // 10 AS k, s_suppkey % 10 AS i FROM supplier), e AS (
SELECT a.s AS src, c.s AS dst FROM b a JOIN b c ON a.k = c.k AND c.i = (a.i + 1 + a.k % 4) % 10 AND a.k % 3 <> 2
UNION SELECT a.s, c.s FROM b a JOIN b c ON a.k = c.k AND c.i = a.i + 1 AND a.k % 3 = 2 UNION SELECT s, s FROM b WHERE s % 17 = 3 UNION SELECT s, s + 10 FROM b WHERE i = 0)"""


def supplier_loops(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"))
    b = s.select("s", F.floor(F.col("s") / 10).alias("k"), (F.col("s") % 10).alias("i"))
    ring = b.where("k % 3 != 2").select("s", (F.col("k") * 10 + (F.col("i") + 1 + F.col("k") % 4) % 10).alias("dst"))
    chain = b.where("k % 3 = 2 and i < 9").select("s", (F.col("s") + 1).alias("dst"))
    known = ring.union(chain).join(s.select(F.col("s").alias("dst")), "dst", "left_semi").select(F.col("s").alias("src"), "dst")
    return known.union(b.where("s % 17 = 3").select("s", "s")).union(b.where("i = 0").select("s", F.col("s") + 10))


@query(f"""WITH RECURSIVE {_LOOPS}, r AS (SELECT src AS root, dst AS node, [src] AS way FROM e WHERE dst >= src UNION ALL SELECT root, e.dst, list_append(way, node) FROM r JOIN e ON e.src = node WHERE node <> root AND e.dst >= root AND NOT list_contains(way, node)),
c AS (SELECT root, way FROM r WHERE node = root), m AS (SELECT root, min(len(way)) AS n FROM c GROUP BY 1),
g AS (SELECT m.root, n, min(way) AS way FROM m JOIN c ON c.root = m.root AND len(c.way) = n GROUP BY 1, 2),
p AS (SELECT src AS a, dst AS b FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b)
SELECT root AS component, n AS length, array_to_string(way, '>') AS cycle FROM g WHERE NOT EXISTS (SELECT 1 FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a = root AND x.b < root)""")
def dependency_cycles(spark: SparkSession, d: str) -> DataFrame:
    """A shortest cycle of each group of suppliers that depend on each other."""
    return shortest_cycles(supplier_loops(spark, d)).select("component", F.col("length").cast("long").alias("length"), F.array_join("cycle", ">").alias("cycle"))


@query(f"""WITH RECURSIVE {_NATIONS}, dag AS (SELECT DISTINCT src, dst FROM e WHERE src > dst), l AS (SELECT n_nationkey AS node, 0 AS level FROM nation UNION SELECT dag.src, l.level + 1 FROM l JOIN dag ON dag.dst = l.node)
SELECT node, max(level) AS level FROM l GROUP BY 1""")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return G.levels(nodes, nation_edges(spark, d).where("src > dst"))


@query(f"""WITH {_NATIONS}, dag AS (SELECT DISTINCT src, dst FROM e WHERE src > dst)
SELECT n_nationkey AS node FROM nation WHERE n_nationkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM dag WHERE src = n_nationkey AND dst % 2 = 1)""")
def ready_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Nations with even keys count as complete; open ones are ready if they wait for none."""
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return G.ready_nodes(nodes, nation_edges(spark, d).where("src > dst"), nodes.where("node % 2 = 0"))


@query("""WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS a, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), u AS (SELECT a AS src, b AS dst FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
r AS (SELECT conv_id * 1000 + turn AS root, conv_id * 1000 + turn AS node, 0 AS depth FROM conversations WHERE turn = 1 UNION SELECT r.root, u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.node WHERE r.depth < 3)
SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def bounded_chain(spark: SparkSession, d: str) -> DataFrame:
    """Turns within three steps of the second one, in both directions, at their shortest distance."""
    from pyspark.sql import Window

    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("src")
    c = table(spark, d, "conversations").select("conv_id", "turn", key)
    e = c.withColumn("dst", F.lead("src").over(Window.partitionBy("conv_id").orderBy("turn"))).where("dst is not null").select("src", "dst")
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return G.reach(both, c.where("turn = 1").select(F.col("src").alias("node")), 3)


@query("""WITH RECURSIVE x AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS deps, count(*) FILTER (WHERE l_returnflag = 'R') AS bugs, count(*) AS changes FROM lineitem GROUP BY 1), p AS (SELECT *, floor(100.0 * (rank() OVER (ORDER BY deps) - 1) / count(*) OVER () + 0.5) AS pc FROM x),
q AS (SELECT s, deps, CASE WHEN deps >= 20 THEN 3 WHEN deps >= 10 THEN 2 WHEN deps >= 5 THEN 1 ELSE 0 END + CASE WHEN bugs > 3 THEN 3 WHEN bugs >= 1 THEN 2 ELSE 0 END + CASE WHEN pc >= 95 THEN 2 WHEN pc >= 80 THEN 1 WHEN pc >= 50 THEN 0.5 ELSE 0 END + CASE WHEN changes > 10 THEN 2 WHEN changes > 5 THEN 1 ELSE 0 END AS points FROM p)
SELECT s, deps, CASE WHEN points >= 8 THEN 'critical' WHEN points >= 5 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS level FROM q""")
def batch_impact(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.countDistinct("l_partkey").alias("deps"), F.count_if(F.col("l_returnflag") == "R").alias("bugs"), F.count(F.lit(1)).alias("changes"))
    p = R.percentile_n(x, [], "deps", "pc")
    return p.select("s", "deps", impact_level(F.col("deps"), F.col("bugs"), F.col("pc"), F.col("changes")).alias("level"))


@query()
def phase_order(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected groups of trade links in dependency order, with their risk."""
    e = nation_edges(spark, d)
    rank = G.pagerank(e.withColumn("weight", F.lit(1.0)), max_rounds=30)
    scores = G.coupling(e).select("node", "ca").join(rank, "node")
    return G.phases(e, scores).select("component", "size", "level", F.round("risk", 4).alias("risk"), F.when(F.col("risk") >= 50, "critical").when(F.col("risk") >= 30, "high").when(F.col("risk") >= 10, "medium").otherwise("low").alias("grade"))
