"""Scans, writes as rewrites, predicates, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import like_pattern
from quernstone.operators import relational as R
from quernstone.plans import dealt
from quernstone.queries import query
from quernstone.sources import table


@query("SELECT * FROM nation")
def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31'")
def dynamic_filter_scan(spark: SparkSession, d: str) -> DataFrame:
    asked = [F.col("o_orderstatus") == "O", F.col("o_totalprice") >= 1000, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))]
    return R.where_all(table(spark, d, "orders"), asked).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT DISTINCT event_type, k AS prop, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS value FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events)")
def unnest_json(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", T.MapType(T.StringType(), T.StringType()))
    return table(spark, d, "events").select("event_type", F.explode(props).alias("prop", "value")).distinct()


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE regexp_matches(line, '(?i)licen[cs]e')) AS BIGINT) AS n_marked
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").rlike("(?i)licen[cs]e")).alias("n_marked"))


# --- writes, as rewrites of whole tables ---

@query("""WITH old AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderpriority) AS worst FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
new AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderpriority) AS worst FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.n_orders, o.n_orders) AS n_orders, coalesce(o.worst, n.worst) AS worst FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey""")
def upsert_stats(spark: SparkSession, d: str) -> DataFrame:
    o, cut = table(spark, d, "orders"), F.lit("1996-01-01").cast("timestamp_ntz")
    stats = lambda x: x.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderpriority").alias("worst"))
    return R.upsert(stats(o.where(F.col("o_orderdate") < cut)), stats(o.where(F.col("o_orderdate") >= cut)), ["o_custkey"], prefer=["n_orders"])


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def update_in_place(spark: SparkSession, d: str) -> DataFrame:
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("_back")).distinct()
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(back, "o_orderkey", "left")
    return R.update_when(o, F.col("_back").isNotNull(), {"o_orderstatus": F.lit("X")}).drop("_back")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.missing(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def retain_newest_n(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAY >= TIMESTAMP '2024-02-01'")
def ttl_delete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.expr("ts + INTERVAL 7 DAYS >= TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("event_id", "user_id")


# --- predicates ---

@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS n_and,
count(*) FILTER (WHERE o_custkey = 7 OR o_orderstatus = 'P') AS n_or, count(*) FILTER (WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS n_in,
count(*) FILTER (WHERE o_totalprice BETWEEN 100 AND 5000) AS n_range, count(*) FILTER (WHERE o_orderstatus IS NULL) AS n_null,
count(*) FILTER (WHERE lower(o_orderpriority) = lower('5-Low')) AS n_fold, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL) AS n_safe FROM orders""")
def predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    asked = {
        "n_and": (c("o_orderstatus") == "F") & (c("o_orderpriority") == "1-URGENT"),
        "n_or": (c("o_custkey") == 7) | (c("o_orderstatus") == "P"),
        "n_in": c("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"),
        "n_range": c("o_totalprice").between(100, 5000),
        "n_null": c("o_orderstatus").isNull(),
        "n_fold": F.lower("o_orderpriority") == F.lower(F.lit("5-Low")),
        "n_safe": F.nullif(c("o_orderstatus"), F.lit("P")).eqNullSafe(F.lit(None)),
    }
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(p).alias(k) for k, p in asked.items()])


@query("""SELECT count(*) FILTER (WHERE p_type LIKE '%BRASS%') AS n_contains, count(*) FILTER (WHERE p_type LIKE 'SMALL%') AS n_starts,
count(*) FILTER (WHERE p_type LIKE '%TIN') AS n_ends, count(*) FILTER (WHERE p_name = 'part_1') AS n_exact,
count(*) FILTER (WHERE contains(lower(p_name), 'part_1')) AS n_escaped, count(*) FILTER (WHERE lower(p_name) LIKE '%part_1%') AS n_live FROM part""")
def like_modes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    live = F.lower("p_name").like("%part_1%")
    return p.agg(F.count_if(F.col("p_type").contains("BRASS")).alias("n_contains"), F.count_if(F.col("p_type").startswith("SMALL")).alias("n_starts"), F.count_if(F.col("p_type").endswith("TIN")).alias("n_ends"), F.count_if(F.col("p_name") == "part_1").alias("n_exact"), F.count_if(F.lower("p_name").like(like_pattern("part_1", "contains"))).alias("n_escaped"), F.count_if(live).alias("n_live"))


@query("""SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['STEEL', 'COPPER']) AS any_tag, len(list_filter(string_split(p_type, ' '), lambda x: contains(x, 'PO'))) > 0 AS any_part FROM part""")
def array_predicates(spark: SparkSession, d: str) -> DataFrame:
    tags = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(tags, F.array(F.lit("STEEL"), F.lit("COPPER"))).alias("any_tag"), F.exists(tags, lambda x: x.contains("PO")).alias("any_part"))


@query("""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-09-01') AS BIGINT) AS age_days FROM orders
WHERE o_orderdate < TIMESTAMP '1998-09-01' - INTERVAL 365 DAY AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')""")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-09-01 00:00:00' - INTERVAL 365 DAYS")
    return table(spark, d, "orders").where(old & F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")).select("o_orderkey", F.datediff(F.lit("1998-09-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age_days"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '\\.html$') THEN 'extension' WHEN contains(url, '/fr/') THEN 'directory' ELSE 'kept' END AS verdict,
contains(url, '/en/') AND regexp_matches(url, '^https') AS intended FROM pages""")
def path_filters(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    verdict = F.when(url.rlike(r"\.html$"), "extension").when(url.contains("/fr/"), "directory").otherwise("kept")
    return table(spark, d, "pages").select("page_id", verdict.alias("verdict"), (url.contains("/en/") & url.rlike("^https")).alias("intended"))


# --- joins ---

def turn_links(spark: SparkSession, d: str) -> DataFrame:
    """Typed links between turns of a conversation: each turn to the next one."""
    c = table(spark, d, "conversations")
    turn = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    linked = c.select("conv_id", "turn", "role", turn.alias("from_id"), nxt.alias("next")).where("next is not null")
    return linked.select("from_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("next").cast("string")).alias("to_id"), F.concat("role", F.lit("_to")).alias("link_type"))


@query("""WITH t AS (SELECT conv_id || ':' || turn AS id, role, conv_id || ':' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
l AS (SELECT id AS from_id, nxt AS to_id, role || '_to' AS link_type FROM t WHERE nxt IS NOT NULL)
SELECT from_id AS id, to_id AS other, link_type, 'out' AS direction, t.role FROM l JOIN t ON t.id = l.to_id
UNION ALL SELECT to_id, from_id, link_type, 'in', t.role FROM l JOIN t ON t.id = l.from_id""")
def links_both_ways(spark: SparkSession, d: str) -> DataFrame:
    links = turn_links(spark, d)
    turns = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("other"), "role")
    out = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "link_type", F.lit("out").alias("direction"))
    back = links.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "link_type", F.lit("in").alias("direction"))
    return out.unionByName(back).join(turns, "other").select("id", "other", "link_type", "direction", "role")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    return R.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_join_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer")
def existence_probe(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("has_urgent"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS ln, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT r.l_suppkey AS src, d.l_suppkey AS dst, r.n FROM s r JOIN s d ON r.l_partkey = d.l_partkey AND d.ln = 1 AND r.ln > 1 AND r.l_suppkey <> d.l_suppkey)
SELECT src, dst, CAST(sum(n) AS BIGINT) AS weight FROM e GROUP BY 1, 2""")
def symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    """A part is a symbol; suppliers of its first lines define it, others refer to it.

    Lines are dealt by part and pairs by both ends, into partitions by their counted numbers.
    """
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    met = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("defs"), F.count_if(F.col("l_linenumber") > 1).alias("refs"))
    lines, pairs = met.agg(F.sum("n"), F.sum(F.col("defs") * F.col("refs"))).first()
    s = dealt(li, lines or 0, "l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("ln"), F.count(F.lit(1)).alias("n"))
    refs = s.where("ln > 1").select("l_partkey", F.col("l_suppkey").alias("src"), "n")
    defs = s.where("ln = 1").select("l_partkey", F.col("l_suppkey").alias("dst"))
    both = refs.join(defs, "l_partkey").where("src != dst").select("src", "dst", "n")
    return dealt(both, pairs or 0, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s,
date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 10 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS e FROM orders)
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN a.s <= b.s AND a.e >= b.e OR b.s <= a.s AND b.e >= a.e THEN 'contains' ELSE 'overlaps' END AS kind
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", start.alias("s"), (start + 10 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("e"))
    holds = (F.col("a_start") <= F.col("b_start")) & (F.col("a_end") >= F.col("b_end")) | (F.col("b_start") <= F.col("a_start")) & (F.col("b_end") >= F.col("a_end"))
    return R.overlaps(o, "o_custkey", "o_orderkey", "s", "e", 64).select("o_custkey", "a", "b", F.when(holds, "contains").otherwise("overlaps").alias("kind"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT a.n_regionkey AS from_layer, b.n_regionkey AS to_layer, count(*) AS n, a.n_regionkey < b.n_regionkey AS violation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2""")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the customer's region to the supplier's; edges to a higher layer break the rule."""
    nation = table(spark, d, "nation")
    layer = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.col("n_regionkey").alias(name))
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # pre-aggregate by nation pair, then look the two layers up
    pairs = edges.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    named = pairs.join(layer("c_nationkey", "from_layer"), "c_nationkey").join(layer("s_nationkey", "to_layer"), "s_nationkey")
    return named.groupBy("from_layer", "to_layer").agg(F.sum("n").alias("n")).withColumn("violation", F.col("from_layer") < F.col("to_layer"))


@query("""WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS dependents FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(dependents, 0) AS dependents, CASE WHEN coalesce(dependents, 0) > 20 THEN 'high' WHEN coalesce(dependents, 0) > 5 THEN 'medium' ELSE 'low' END AS impact FROM part LEFT JOIN u ON p_partkey = l_partkey""")
def impact_enrichment(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("dependents"))
    n = F.coalesce("dependents", F.lit(0))
    return table(spark, d, "part").select("p_partkey").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", n.alias("dependents"), F.when(n > 20, "high").when(n > 5, "medium").otherwise("low").alias("impact"))


# --- sorts and limits ---

@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderdate, o_orderkey LIMIT 20""")
def suggested_tasks(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(rank, "o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, substr(o_orderpriority, 3) AS priority FROM orders ORDER BY substr(o_orderpriority, 3) DESC, o_totalprice DESC, o_orderkey LIMIT 30")
def lexical_priority(spark: SparkSession, d: str) -> DataFrame:
    """Priorities sorted as text, as the compatible output of the task list needs it."""
    name = F.substring("o_orderpriority", 3, 99)
    return table(spark, d, "orders").orderBy(name.desc(), F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", name.alias("priority"))


@query("""WITH k AS (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_partkey LIMIT 30)
SELECT p_partkey, p_size FROM k ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def overfetch_rerank(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(30)
    return wide.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_size")


@query("""SELECT source, doc_id, spent FROM (SELECT source, doc_id, CAST(sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) + 50 AS spent FROM documents) WHERE spent <= 8000""")
def budget_fit(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.ceil(F.col("n_chars") / 4).cast("long")
    return R.budget_prefix(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], tokens, 8000, 50).select("source", "doc_id", "spent")


# --- sets and duplicates ---

@query("SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(trim(lower(text))) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", "source", F.md5(F.trim(F.lower("text")).cast("binary")).alias("key"))
    # a minimum by key is combined before the shuffle, so a large group of copies never meets in one task
    return keyed.groupBy("key").agg(F.min(F.struct("doc_id", "source")).alias("first")).select("first.doc_id", "first.source")


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("n_sources")).where("n > 1")


@query("SELECT doc_id, source, prefix FROM (SELECT doc_id, source, substr(text, 1, 50) AS prefix, row_number() OVER (PARTITION BY source, substr(text, 1, 50) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", F.substring("text", 1, 50).alias("prefix")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", "prefix")


@query("""SELECT a.p_partkey, list_sort(list_distinct(list_concat(string_split(a.p_type, ' '), string_split(b.p_type, ' ')))) AS merged,
list_sort(list_distinct(list_intersect(string_split(a.p_type, ' '), string_split(b.p_type, ' ')))) AS shared, list_sort(list_distinct(list_filter(string_split(a.p_type, ' '), lambda x: NOT list_contains(string_split(b.p_type, ' '), x)))) AS own
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def array_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("a"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(nxt, "p_partkey")
    return both.select("p_partkey", F.array_sort(F.array_union("a", "b")).alias("merged"), F.array_sort(F.array_intersect("a", "b")).alias("shared"), F.array_sort(F.array_except("a", "b")).alias("own"))


@query("""WITH h AS (SELECT doc_id, 'body' AS strategy FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)),
p AS (SELECT doc_id, 'prefix' AS strategy FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h) AND substr(text, 1, 80) IN
(SELECT substr(text, 1, 80) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h) GROUP BY 1 HAVING count(*) > 1)) SELECT * FROM h UNION ALL SELECT * FROM p""")
def strategy_claims(spark: SparkSession, d: str) -> DataFrame:
    """Strategies one after the other; what an earlier one has claimed, a later one leaves out."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("body"), F.substring("text", 1, 80).alias("prefix"))
    groups = lambda x, key: x.join(x.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key, "left_semi").select("doc_id", F.lit(key).alias("strategy"))
    first = groups(docs, "body")
    return first.unionByName(groups(R.missing(docs, first, "doc_id"), "prefix"))


@query("SELECT l_partkey, max(l_quantity) AS most, min(l_linestatus) AS first_status, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1")
def merge_by_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("most"), F.min("l_linestatus").alias("first_status"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
