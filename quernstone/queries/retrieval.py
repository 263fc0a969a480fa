"""Text, vector and hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scoring import smart_relevance
from quernstone.operators import relational as R
from quernstone.operators import retrieval as S
from quernstone.operators import search as Q
from quernstone.operators.text_index import TextIndex
from quernstone.operators.vector_index import VectorIndex
from quernstone.plans import shared_dir
from quernstone.queries import query
from quernstone.sources import table

_DOCS_BM25 = r"""t AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS dl, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, dl, len(list_filter(w, lambda x: starts_with(x, 'licen'))) AS t0, len(list_filter(w, lambda x: starts_with(x, 'thwhing'))) AS t1, len(list_filter(w, lambda x: starts_with(x, 'ouvi'))) AS t2 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2 FROM c),
b AS (SELECT doc_id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / m))
+ greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / m))
+ greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / m)) AS score FROM c, s WHERE t0 + t1 + t2 > 0)"""
_WANTED = "licen thwhing ouvi"


_INDEXES: dict[tuple, TextIndex | VectorIndex] = {}


def _state(rows: DataFrame) -> tuple:
    """What tells a table's files from those of another state of it."""
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return tuple(rows.select(file.alias("f")).distinct().agg(F.count(F.lit(1)), F.sum(F.xxhash64("f").cast("decimal(38,0)"))).first())


def _stored(spark: SparkSession, d: str, name: str, build) -> TextIndex | VectorIndex:
    """The stored index of a table: made once in an application for each state of its files."""
    rows = table(spark, d, name)
    key = (spark.sparkContext.applicationId, d, name, *_state(rows))
    if key not in _INDEXES:
        _INDEXES[key] = build(rows, f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}")
    return _INDEXES[key]


def _index(spark: SparkSession, d: str) -> TextIndex:
    return _stored(spark, d, "documents", lambda rows, path: TextIndex.build(rows, "doc_id", ["text"], path))


def _cells(spark: SparkSession, d: str) -> VectorIndex:
    return _stored(spark, d, "embeddings", lambda rows, path: VectorIndex.build(rows, "vec_id", "embedding", path))


def _hits(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    return _index(spark, d).search(S.query_terms(_WANTED), k=k)


def _bm25_of(tests: list[str]) -> str:
    """SQL that scores documents by words that pass the tests, as ``_DOCS_BM25``."""
    k = range(len(tests))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / m))" for i in k)
    return rf"""t AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS dl, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
c AS (SELECT * EXCLUDE (w), {", ".join(f"len(list_filter(w, lambda x: {x})) AS t{i}" for i, x in enumerate(tests))} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS m, {", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in k)} FROM c),
b AS (SELECT c.*, {score} AS score FROM c, s WHERE {" + ".join(f"t{i}" for i in k)} > 0)"""


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


@query(f"WITH {_DOCS_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 20).select("doc_id", F.round("score", 6).alias("score"))


# Words of the stems that the query below asks for.
_STEMS = {"licens": ["license", "licenses", "licensed", "licensing", "licensable"], "onth": ["onth", "onthe", "onths", "onthes", "onthed", "onthing"], "hath": ["hath", "hathe", "haths", "hathes", "hathed", "hathing"]}


@query(f"""WITH {_bm25_of(["x IN (" + ", ".join(f"'{w}'" for w in words) + ")" for words in _STEMS.values()])}
SELECT doc_id, round(score, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 20""")
def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    """Words by their stems, which only the dictionary's distinct terms have."""
    return _index(spark, d).search(S.query_terms("Licensing (onthing) hathed"), prefix=False, stems=True, k=20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25_of(["starts_with(x, 'licen')", "starts_with(x, 'ouvi')"])}
SELECT doc_id, source, round(100 * score, 4) AS relevance FROM b WHERE (source = 'src1' OR lang = 'es') AND n_chars > 400 AND doc_id % 3 <> 0 ORDER BY score DESC, doc_id LIMIT 10""")
def filtered_text_search(spark: SparkSession, d: str) -> DataFrame:
    """A project's rows and the global ones, of some kinds only; the filters change no score."""
    rows = table(spark, d, "documents").where(((F.col("source") == "src1") | (F.col("lang") == "es")) & (F.col("n_chars") > 400) & (F.col("doc_id") % 3 != 0))
    return Q.filtered_search(_index(spark, d), rows.select("doc_id", "source"), S.query_terms("licen ouvi"), 10).select("doc_id", "source", F.round("relevance", 4).alias("relevance"))


_RULES = "SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 END AS superseded_by, doc_id * 13 % 17 AS usage_count, doc_id AS created FROM documents"


def _rules(spark: SparkSession, d: str, source: str) -> DataFrame:
    superseded = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).alias("superseded_by")
    return table(spark, d, "documents").where(F.col("source") == source).select("doc_id", superseded, (F.col("doc_id") * 13 % 17).alias("usage_count"), F.col("doc_id").alias("created"))


@query(f"""WITH {_bm25_of(["x = 'license'", "x = 'under'"])}, r AS ({_RULES})
SELECT doc_id, round(score, 6) AS score FROM b JOIN r USING (doc_id) WHERE t0 > 0 AND t1 > 0 AND r.source = 'src0' AND superseded_by IS NULL ORDER BY score DESC, doc_id LIMIT 10""")
def guardrail_search(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a project that aren't superseded and have all words of the search."""
    return Q.search_rules(_index(spark, d), _rules(spark, d, "src0"), ["license", "under"], 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25_of(["x = 'license'", "x = 'wherhere'"])}, r AS ({_RULES}), f AS (SELECT doc_id, 'tags' AS list, score, usage_count FROM b JOIN r USING (doc_id) WHERE r.source = 'src0' AND superseded_by IS NULL ORDER BY score DESC, usage_count DESC, doc_id LIMIT 5),
g AS (SELECT doc_id, 'none' AS list, 0.0 AS score, usage_count FROM r WHERE source = 'src0' AND superseded_by IS NULL ORDER BY usage_count DESC, created DESC, doc_id LIMIT 5)
SELECT list, doc_id, round(score, 6) AS score, usage_count FROM (SELECT * FROM f UNION ALL SELECT * FROM g)""")
def guardrails_by_tags(spark: SparkSession, d: str) -> DataFrame:
    """Rules in force for a task's tags, and for a task without tags."""
    rules, index = _rules(spark, d, "src0"), _index(spark, d)
    lists = [Q.rules_for_tags(index, rules, tags).withColumn("list", F.lit(name)) for name, tags in (("tags", ["license", "wherhere"]), ("none", []))]
    return lists[0].unionByName(lists[1]).select("list", "doc_id", F.round("score", 6).alias("score"), "usage_count")


@query(r"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+') AS k FROM part),
c AS (SELECT p_partkey, len(a) + len(k) AS dl, 2.0 * len(list_filter(a, lambda x: starts_with(x, 'steel'))) + len(list_filter(k, lambda x: starts_with(x, 'steel'))) AS t0, 2.0 * len(list_filter(a, lambda x: starts_with(x, 'small'))) + len(list_filter(k, lambda x: starts_with(x, 'small'))) AS t1 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM c),
b AS (SELECT p_partkey, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / m)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / m)) AS score FROM c, s WHERE t0 + t1 > 0)
SELECT p_partkey, round(100 * score / greatest(max(score) OVER (), 0.01), 4) AS score FROM b ORDER BY score DESC, p_partkey LIMIT 30""")
def bm25_weighted_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields weigh 2 and 1; scores in percent of the best, words of more than two letters."""
    hits = S.bm25(table(spark, d, "part"), "p_partkey", {"p_name": 2.0, "p_type": 1.0}, S.query_terms("STEEL small of", least=3))
    top = hits.agg(F.max("score")).first()[0] or 0.0
    return hits.orderBy(F.desc("score"), "p_partkey").limit(30).select("p_partkey", F.round(100 * F.col("score") / max(top, 0.01), 4).alias("score"))


@query("SELECT doc_id, source, 50.0 AS score FROM documents WHERE contains(lower(text), 'cc by-nc') OR contains(lower(source), 'cc by-nc') ORDER BY n_chars DESC, doc_id LIMIT 20")
def like_fallback_search(spark: SparkSession, d: str) -> DataFrame:
    hits = S.contains_search(table(spark, d, "documents"), ["text", "source"], "CC BY-NC")
    return hits.orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "source", "score")


@query(f"""WITH {_DOCS_BM25}, l1 AS (SELECT doc_id, score * 100 AS score, 1 AS level FROM b ORDER BY b.score DESC, doc_id LIMIT 5), l2 AS (SELECT doc_id, 30.0 AS score, 2 AS level FROM documents WHERE contains(lower(source), 'src1') AND doc_id NOT IN (SELECT doc_id FROM l1) ORDER BY doc_id LIMIT 10)
SELECT doc_id, round(score, 4) AS score, level FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def feature_search(spark: SparkSession, d: str) -> DataFrame:
    """Text hits first, then rows whose source contains the feature, none twice."""
    first = _hits(spark, d, 5).select("doc_id", (F.col("score") * 100).alias("score"), F.lit(1).alias("level"))
    second = R.missing(table(spark, d, "documents").where(F.lower("source").contains("src1")).select("doc_id"), first, "doc_id").orderBy("doc_id").limit(10).select("doc_id", F.lit(30.0).alias("score"), F.lit(2).alias("level"))
    return first.unionByName(second).select("doc_id", F.round("score", 4).alias("score"), "level")


_COS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, label, v.e AS e, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS sim FROM v, q)"""


#: Searches take every vector whose id is divisible by 50 as a query.
_MANY = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS sim,
round(greatest(0, 1 - (list_dot_product(e, e) + list_dot_product(qe, qe) - 2 * list_dot_product(e, qe)) / 2), 9) AS l2 FROM v, q)"""


def _best(by: str, where: str, k: int) -> str:
    return f"WITH {_MANY} SELECT query_id, vec_id, round({by}, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, vec_id) AS place FROM s WHERE {where}) WHERE place <= {k}"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0")


@query(_best("sim", "sim >= 0.0", 10))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_many(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", 10, 0.0).withColumn("similarity", F.round("similarity", 6))


@query()
def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """The nearest ten of each query in as many cells of the stored index as were measured to hold most of them."""
    return _cells(spark, d).search(_asked(spark, d), "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@query(_best("sim", "true", 10))
def knn_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """The exact search of the stored index: blocks of queries meet the blocks of every cell."""
    return _cells(spark, d).exact(_asked(spark, d), "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@query(_best("l2", "true", 20))
def knn_l2_similarity(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_many(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", 20, measure="l2").withColumn("similarity", F.round("similarity", 6))


@query(_best("sim", "label = 3 AND sim > 0.05", 10))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the top rows are chosen, so it costs no recall."""
    rows = table(spark, d, "embeddings").where("label = 3")
    return S.nearest_many(rows, _asked(spark, d), "vec_id", "embedding", 10, 0.05, strict=True).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_COS} SELECT label, count(*) AS n, round(avg(sim), 6) AS mean_similarity, count(*) FILTER (WHERE len(e) <> 64) AS wrong_dimension FROM s GROUP BY 1")
def centroid_similarity_by_label(spark: SparkSession, d: str) -> DataFrame:
    sim = S.cosine(F.col("embedding"), S.vector_literal(_vector(spark, d)))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(sim), 6).alias("mean_similarity"), F.count_if(F.size("embedding") != 64).alias("wrong_dimension"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_backfill(spark: SparkSession, d: str) -> DataFrame:
    return R.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(f"""WITH {_DOCS_BM25}, {_COS.replace("s AS (", "cs AS (")}, x AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 40), y AS (SELECT vec_id, sim FROM cs ORDER BY sim DESC, vec_id LIMIT 400)
SELECT doc_id, round(100 * (0.5 * score / greatest((SELECT max(score) FROM x), 1) + 0.5 * coalesce(sim, 0)), 4) AS score FROM x LEFT JOIN y ON doc_id = vec_id""")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Twice the wanted rows from the text side, many from the vector side, fused from the text hits."""
    text = _hits(spark, d, 40)
    vectors = S.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d), 400).withColumnRenamed("vec_id", "doc_id")
    return S.fuse(text, vectors, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query("""WITH m AS (SELECT d.doc_id, (d.doc_id * 7 % 90) * 1.0 AS age, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'critical' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS importance, CASE lang WHEN 'en' THEN 'decision' WHEN 'fr' THEN 'snippet' WHEN 'de' THEN 'observation' ELSE 'feature' END AS kind, CASE WHEN source = 'src3' THEN 1.5 ELSE 1.0 END AS context FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, floor(greatest(0, least(100, 50 * pow(0.5, age / 30) * CASE importance WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 1.0 END * CASE kind WHEN 'decision' THEN 1.3 WHEN 'snippet' THEN 1.1 WHEN 'observation' THEN 0.9 ELSE 1.0 END * CASE WHEN age * 24 < 24 THEN 1.5 WHEN age * 24 < 168 THEN 1.2 WHEN age * 24 > 720 THEN 0.8 ELSE 1.0 END * context)) * 10 + 0.5) / 10 AS relevance FROM m""")
def smart_relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    m = table(spark, d, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    q = F.col("quality")
    importance = F.when((q == 1) & (F.col("toxic") == 0), "high").when(q == 1, "critical").when(q == 0, "low").otherwise("medium")
    kind = F.when(F.col("lang") == "en", "decision").when(F.col("lang") == "fr", "snippet").when(F.col("lang") == "de", "observation").otherwise("feature")
    score = smart_relevance(F.lit(50.0), (F.col("doc_id") * 7 % 90).cast("double"), importance, kind, F.when(F.col("source") == "src3", 1.5).otherwise(1.0))
    return m.select("doc_id", score.alias("relevance"))


@query("""WITH h AS (SELECT l_partkey, count(*) AS wins FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), k AS (SELECT p_partkey, p_name, p_type, coalesce(wins, 0) AS wins FROM part LEFT JOIN h ON p_partkey = l_partkey),
s AS (SELECT p_partkey, least(40, CASE WHEN contains(p_type, 'STEEL') THEN 8 ELSE 0 END + CASE WHEN contains(p_type, 'SMALL') THEN 8 ELSE 0 END + CASE WHEN contains(lower(p_name), 'part') THEN 4 ELSE 0 END) AS keyword, CASE WHEN contains(p_type, 'STEEL') THEN 10 WHEN contains(p_type, 'SMALL') THEN 7 ELSE 0 END AS category, least(10, CASE WHEN wins >= 30 THEN 8 WHEN wins >= 20 THEN 5 WHEN wins >= 1 THEN 3 ELSE 0 END + CASE WHEN wins > 25 THEN 2 ELSE 0 END) AS history, CASE WHEN wins > 5 THEN 10 WHEN wins > 2 THEN 7 WHEN wins > 0 THEN 4 ELSE 0 END AS freshness FROM k)
SELECT p_partkey, round(least(100, 100.0 * (keyword + freshness) / 115 * 0.8 + category + history), 4) AS score FROM s WHERE 100.0 * (keyword + freshness) / 115 * 0.8 + category + history >= 20 ORDER BY score DESC, p_partkey LIMIT 40""")
def agent_search(spark: SparkSession, d: str) -> DataFrame:
    """Capability points in percent, weighed 0.8, with boosts by category and history; at least 20."""
    wins = table(spark, d, "lineitem").where("l_returnflag != 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("wins"))
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type").join(wins, "p_partkey", "left").na.fill(0, ["wins"])
    steel, small, w = F.col("p_type").contains("STEEL"), F.col("p_type").contains("SMALL"), F.col("wins")
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    keyword = F.least(F.lit(40), points(steel, 8) + points(small, 8) + points(F.lower("p_name").contains("part"), 4))
    category = F.when(steel, 10).when(small, 7).otherwise(0)
    history = F.least(F.lit(10), F.when(w >= 30, 8).when(w >= 20, 5).when(w >= 1, 3).otherwise(0) + points(w > 25, 2))
    fresh = F.when(w > 5, 10).when(w > 2, 7).when(w > 0, 4).otherwise(0)
    score = (keyword + fresh) * 100.0 / 115 * 0.8 + category + history
    return p.where(score >= 20).select("p_partkey", F.round(F.least(F.lit(100.0), score), 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)


@query(f"""WITH {_DOCS_BM25}, hit AS (SELECT doc_id, 1 AS tier FROM b ORDER BY score DESC, doc_id LIMIT 8), fill AS (SELECT doc_id, 2 AS tier FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit) ORDER BY n_chars DESC, doc_id LIMIT 4) SELECT * FROM hit UNION ALL SELECT * FROM fill""")
def select_with_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Text hits, filled up with the longest of the rest."""
    hit = _hits(spark, d, 8).select("doc_id", F.lit(1).alias("tier"))
    rest = R.missing(table(spark, d, "documents").select("doc_id", "n_chars"), hit, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(4)
    return hit.unionByName(rest.select("doc_id", F.lit(2).alias("tier")))
