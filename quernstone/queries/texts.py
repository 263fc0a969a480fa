"""Classifiers of texts and similar records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import strings as C
from quernstone.functions import text as X
from quernstone.functions.scoring import match_action, match_reason
from quernstone.functions.text import js_round
from quernstone.operators import similarity as M
from quernstone.operators.components import connected_components
from quernstone.operators.record_similarity import record_pairs, records
from quernstone.plans import dealt, shared_table
from quernstone.queries import query
from quernstone.sources import table


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _tags_sql() -> str:
    by = {k: list(v) for k, v in X.DOMAIN_KEYWORDS.items()}
    for word, tag in X.TECH_KEYWORDS.items():
        by.setdefault(tag, []).append(word)
    cases = ", ".join(f"CASE WHEN {_any('t', w)} THEN '{k}' END" for k, w in by.items())
    return f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"


def _first_sql(classes: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{k}'" for k, w in classes.items()) + f" ELSE {default} END"


@query(f"SELECT doc_id, {_tags_sql()} AS tags, {_first_sql(X.TYPE_KEYWORDS, 'NULL')} AS kind, {_first_sql(X.IMPORTANCE_WORDS, 'NULL')} AS importance FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def tag_extraction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.domain_tags(F.col("text")).alias("tags"), X.first_match(F.col("text"), X.TYPE_KEYWORDS).alias("kind"), X.first_match(F.col("text"), X.IMPORTANCE_WORDS).alias("importance"))


@query(f"""SELECT event_id, {_first_sql(X.ERROR_PHRASES, "'unknown'")} AS error_class FROM (SELECT event_id, lower(CASE event_id % 5 WHEN 0 THEN 'Syntax error near ' WHEN 1 THEN 'Validation failed for ' WHEN 2 THEN 'Model overloaded at ' WHEN 3 THEN 'Timed out after ' ELSE 'Odd ' END || event_type) AS t FROM events)""")
def error_class(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 5
    message = F.concat(F.when(kind == 0, "Syntax error near ").when(kind == 1, "Validation failed for ").when(kind == 2, "Model overloaded at ").when(kind == 3, "Timed out after ").otherwise("Odd "), "event_type")
    return table(spark, d, "events").select("event_id", X.first_match(message, X.ERROR_PHRASES, "unknown").alias("error_class"))


def _secrets_sql() -> str:
    q = lambda p: p.replace("'", "''")
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{q(p)}') THEN '{k}' END" for k, p, _ in X.SECRET_FORMATS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, {_secrets_sql()} AS kinds FROM documents")
def secret_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.secret_kinds(F.col("text")).alias("kinds"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]{8,})', 1) AS name, regexp_extract(text, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]{8,})', 2) AS v FROM documents),
c AS (SELECT doc_id, unnest(string_split(v, '')) AS ch, length(v) AS n FROM m WHERE v <> ''), e AS (SELECT doc_id, -sum(p * log2(p)) AS bits FROM (SELECT doc_id, 1.0 * count(*) / n AS p FROM c WHERE ch <> '' GROUP BY doc_id, ch, n) GROUP BY 1)
SELECT doc_id, name, round(bits, 6) AS entropy, CASE WHEN length(v) <= 11 THEN repeat('*', length(v)) ELSE substr(v, 1, 4) || repeat('*', least(length(v) - 8, 10)) || right(v, 4) END AS redacted, (contains(lower(v), '000') OR contains(lower(v), '123') OR contains(lower(v), 'test') OR contains(lower(v), 'example') OR contains(lower(v), 'xxx') OR contains(v, '__')) AS placeholder FROM m JOIN e USING (doc_id)""")
def shannon_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Assigned values with their entropy, redacted."""
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})"""
    m = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("v")).where("v != ''")
    v = F.col("v")
    return m.select("doc_id", "name", F.round(X.entropy(v), 6).alias("entropy"), X.redact(v).alias("redacted"), X.is_placeholder(v).alias("placeholder"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[a-z]+([A-Z][a-z0-9]*)+$') THEN 'camel' WHEN regexp_matches(p_name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(p_name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' ELSE 'plain' END AS style,
substr(md5(trim(regexp_replace(regexp_replace(p_name || ' = "' || p_type || '"  ;', '"[^"]*"', 'STR', 'g'), '\s+', ' ', 'g'))), 1, 16) AS body_hash FROM part""")
def naming_and_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat("p_name", F.lit(' = "'), "p_type", F.lit('"  ;'))
    return table(spark, d, "part").select("p_partkey", X.naming_style(F.col("p_name")).alias("style"), F.substring(F.md5(X.normalize_body(body).cast("binary")), 1, 16).alias("body_hash"))


@query(r"""SELECT doc_id, 1 + len(regexp_extract_all(text, '&&')) + len(regexp_extract_all(text, '\|\|')) + len(regexp_extract_all(text, '\?\?')) + len(regexp_extract_all(text, '\?\s*[^:]+:')) + len(regexp_extract_all(text, '\b(?:if|for|while|catch)\s*\(')) + len(regexp_extract_all(text, '\bdo\s*\{')) + len(regexp_extract_all(text, '\bcase\s+[^:]+:')) AS complexity,
CASE WHEN regexp_matches(trim(source), '(?i)^(implement|fix|todo|later|wip|add tests?|needs? implementation)$') THEN 0.3 WHEN length(trim(source)) < 15 THEN 0.6 ELSE 1.0 END AS quality FROM documents""")
def complexity_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.complexity(F.col("text")).cast("long").alias("complexity"), X.note_quality(F.col("source")).alias("quality"))


#: Pairs of texts that a task measures.
PAIRS = 50_000


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, x, y): each part's text with the next one's, dealt out, as a small file has much to be measured."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("x"))
    return dealt(p, p.count(), "p_partkey", each=PAIRS).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")


@query(r"""WITH w AS (SELECT a.p_partkey, a.p_name || ' ' || a.p_type AS x, b.p_name || ' ' || b.p_type AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
c AS (SELECT *, list_distinct(string_split(x, '')) AS cx, list_distinct(string_split(y, '')) AS cy FROM w)
SELECT p_partkey, round(len(list_intersect(cx, cy)) / (len(cx) + len(cy) - len(list_intersect(cx, cy))), 6) AS jaccard, round(2 * len(list_intersect(cx, cy)) / (len(cx) + len(cy)), 6) AS dice  FROM c""")
def string_metrics(spark: SparkSession, d: str) -> DataFrame:
    both = _neighbours(spark, d)
    m = C.measures(spark, F.col("x"), F.col("y"))
    return both.select("p_partkey", *[F.round(m[k], 6).alias(k) for k in ("jaccard", "dice")])


@query()
def combined_similarity(spark: SparkSession, d: str) -> DataFrame:
    both = _neighbours(spark, d)
    m = C.measures(spark, F.col("x"), F.col("y"))
    return both.select("p_partkey", *[F.round(m[k], 6).alias(k) for k in ("jaro", "jaro_winkler", "cosine", "lcs", "combined")], F.round(C.quick(F.col("x"), F.col("y"), 0.8), 6).alias("quick"))


_SHINGLES = r"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY 1), r AS (SELECT min(doc_id) AS class, n FROM k GROUP BY h, n),
t AS (SELECT class, n, g FROM r JOIN s ON s.doc_id = r.class), i AS (SELECT a.class AS a, b.class AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.class < b.class GROUP BY 1, 2, 3, 4),
p AS (SELECT a, b, c / (na + nb - c) AS sim FROM i WHERE c / (na + nb - c) >= 0.8 - 1e-9)"""


def _near(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, class), (a, b, similarity)): the classes of equal shingle sets, and similar pairs of their names; copies are in the first table alone."""
    docs = documents.select("doc_id", M.shingle_set(F.col("text")).alias("set"))
    members, sets = M.set_classes(docs, "doc_id", "set")
    return members, M.similar_pairs(sets, "class", "set", 0.8, M.names(members))


@query(f"WITH {_SHINGLES} SELECT a, b, round(sim, 6) AS similarity FROM p")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives with a Jaccard similarity of 0.8 over five-word shingles."""
    return _near(table(spark, d, "documents"))[1].select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_SHINGLES}, u AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), z AS (SELECT class AS node, class AS top FROM r UNION SELECT z.node, u.y FROM z JOIN u ON u.x = z.top),
f AS (SELECT node, min(top) AS component FROM z GROUP BY 1), m AS (SELECT k.doc_id, min(r2.class) AS class FROM k JOIN (SELECT min(doc_id) AS class, h, n FROM k GROUP BY h, n) r2 ON k.h = r2.h AND k.n = r2.n GROUP BY 1)
SELECT documents.doc_id, coalesce(f.component, (SELECT min(doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k))) AS component FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id LEFT JOIN f ON f.node = m.class""")
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document with the smallest id that near duplicates and copies connect it to."""
    members, pairs = _near(table(spark, d, "documents"))
    comp = connected_components(pairs, "a", "b").select(F.col("node").alias("class"), "component")
    return members.join(comp, "class", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "class").alias("component"))


@query(f"""WITH RECURSIVE {_SHINGLES}, e AS (SELECT b AS node, list(a) AS earlier FROM p GROUP BY 1), o AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM (SELECT a AS node FROM p UNION SELECT b FROM p)),
z(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT z.i + 1, CASE WHEN len(list_intersect(coalesce(earlier, []), leaders)) = 0 THEN list_append(leaders, o.node) ELSE leaders END FROM z JOIN o ON o.i = z.i + 1 LEFT JOIN e ON e.node = o.node),
l AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM z ORDER BY i DESC LIMIT 1)), j AS (SELECT b AS node, min(a) AS leader FROM p WHERE a IN (FROM l) AND b NOT IN (FROM l) GROUP BY 1),
m AS (SELECT k.doc_id, min(r2.class) AS class FROM k JOIN (SELECT min(doc_id) AS class, h, n FROM k GROUP BY h, n) r2 ON k.h = r2.h AND k.n = r2.n GROUP BY 1)
SELECT documents.doc_id, coalesce(j.leader, m.class, (SELECT min(doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k))) AS leader FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id LEFT JOIN j ON j.node = m.class""")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the first leader that it is similar to, in the order of ids."""
    members, pairs = _near(table(spark, d, "documents"))
    led = M.leader_clusters(pairs).select(F.col("node").alias("class"), "leader")
    return members.join(led, "class", "left").select(F.col("id").alias("doc_id"), F.coalesce("leader", "class").alias("leader"))


@query(f"""WITH RECURSIVE {_SHINGLES}, u AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), f AS (SELECT x AS node, x AS top FROM u UNION SELECT f.node, u.y FROM f JOIN u ON u.x = f.top), c AS (SELECT node, min(top) AS component FROM f GROUP BY 1),
q AS (SELECT k.doc_id, r2.class FROM k JOIN (SELECT min(doc_id) AS class, h, n FROM k GROUP BY h, n) r2 ON k.h = r2.h AND k.n = r2.n), g AS (SELECT q.doc_id, q.class, coalesce(component, q.class) AS component FROM q LEFT JOIN c ON c.node = q.class),
x AS (SELECT DISTINCT component, class FROM g), w AS (SELECT a.component, a.class AS ca, b.class AS cb, a.n AS na, b.n AS nb FROM (SELECT x.*, n FROM x JOIN r USING (class)) a JOIN (SELECT x.*, n FROM x JOIN r USING (class)) b ON a.component = b.component AND a.class < b.class),
y AS (SELECT w.component, w.ca, w.cb, any_value(na) AS na, any_value(nb) AS nb, count(t2.g) AS shared FROM w JOIN t t1 ON t1.class = ca LEFT JOIN t t2 ON t2.class = cb AND t2.g = t1.g GROUP BY 1, 2, 3), v AS (SELECT component, min(shared / (na + nb - shared)) AS least FROM y GROUP BY 1)
SELECT component, count(*) AS n, count(DISTINCT g.class) AS n_sets, round(coalesce(any_value(least), 1.0), 6) AS least, CASE WHEN coalesce(any_value(least), 1.0) > 0.8 THEN 'merge' WHEN coalesce(any_value(least), 1.0) > 0.3 THEN 'rename' ELSE 'keep' END AS advice FROM g LEFT JOIN v USING (component) GROUP BY 1 HAVING count(*) > 1""")
def least_group_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Groups that near duplicates connect, with the least similarity of two of their texts."""
    members, sets = M.set_classes(table(spark, d, "documents").select("doc_id", M.shingle_set(F.col("text")).alias("set")).where(F.size("set") > 0), "doc_id", "set")
    comp = connected_components(M.similar_pairs(sets, "class", "set", 0.8, M.names(members)), "a", "b").select(F.col("node").alias("class"), F.col("component"))
    groups = members.join(comp, "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    # only sets of groups with two members or more are moved
    several = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    rows = groups.join(several, "component", "left_semi").join(sets.select(F.col("class").alias("id"), "set"), "id")
    out = M.least_similarity(rows, "component", "set")
    least = F.col("least")
    return out.select("component", "n", "n_sets", F.round(least, 6).alias("least"), F.when(least > 0.8, "merge").when(least > 0.3, "rename").otherwise("keep").alias("advice"))


@query(r"""WITH d AS (SELECT doc_id, source, length(coalesce(text, '')) AS n, list_sort(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM documents),
p AS (SELECT a.doc_id FROM d a JOIN d b ON a.source IS DISTINCT FROM b.source AND len(a.w) >= 0.92 * len(b.w) - 1e-9 AND len(b.w) >= 0.92 * len(a.w) - 1e-9 AND abs(a.n - b.n) <= 0.5 * greatest(a.n, b.n) AND len(a.w) > 0 WHERE len(list_intersect(a.w, b.w)) >= 0.92 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9)
SELECT doc_id, min(doc_id) OVER (PARTITION BY w, n) AS class, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS n_links FROM d""")
def token_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the number of documents of other sources that hold nearly the same words."""
    return M.token_links(table(spark, d, "documents"), "doc_id", "source", "text")


@query()
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two documents or more that near duplicates and copies connect, with the mean similarity of their pairs from 0.8 on.

    Texts without a word are similar to nothing.
    """
    members, pairs = _near(table(spark, d, "documents").where(F.col("text").rlike(r"[\p{L}\p{N}]")))
    copies = members.where("id IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return M.clusters(pairs, copies).select("component", "size", F.round("mean_similarity", 6).alias("mean_similarity"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')), lambda x: length(x) > 2) AS w FROM documents WHERE doc_id % 50 = 0),
b AS (SELECT item_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')), lambda x: length(x) > 2) AS v FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(w, v)) / len(v), 6) AS overlap FROM d, b WHERE len(list_intersect(w, v)) >= 0.5 * len(v) AND len(v) > 0""")
def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of a benchmark item's words that a document of the query set holds, from one half on."""
    docs = table(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id", F.explode(M.word_set(F.col("text"))).alias("w"))
    items = table(spark, d, "benchmark").select("item_id", M.word_set(F.col("text")).alias("v")).where(F.size("v") > 0)
    words = items.select("item_id", F.size("v").alias("n"), F.explode("v").alias("w"))
    hit = docs.join(words, "w").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("c"))
    return hit.where(F.col("c") >= 0.5 * F.col("n")).select("doc_id", "item_id", F.round(F.col("c") / F.col("n"), 6).alias("overlap"))


@query("""WITH t AS (SELECT p_name, p_partkey, p_brand, list_concat(['id', 'name'], list_transform(range(1, length(p_name) % 5 + 1), lambda i: 'x' || i || '_' || p_size % 3)) AS f FROM part),
x AS (SELECT DISTINCT p_name, f FROM t), j AS (SELECT a.p_name, min(len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)))) AS least FROM x a JOIN x b USING (p_name) GROUP BY 1),
g AS (SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM t GROUP BY 1 HAVING count(*) >= 2)
SELECT p_name, n, brands, round(least, 6) AS similarity, CASE WHEN least > 0.8 THEN 'merge' WHEN least > 0.3 THEN 'rename' ELSE 'keep' END AS advice FROM g JOIN j USING (p_name)""")
def same_name_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one name with the least similarity of two members' fields, some of which depend on the size."""
    more = F.transform(F.sequence(F.lit(1), F.length("p_name") % 5), lambda i: F.concat(F.lit("x"), i, F.lit("_"), F.col("p_size") % 3))
    fields = F.concat(F.array(F.lit("id"), F.lit("name")), F.when(F.length("p_name") % 5 > 0, more).otherwise(F.array().cast("array<string>")))
    t = table(spark, d, "part").select("p_name", "p_brand", fields.alias("fields"))
    s = F.col("least")
    found = M.least_similarity(t, "p_name", "fields").select("p_name", "n", F.round(s, 6).alias("similarity"), F.when(s > 0.8, "merge").when(s > 0.3, "rename").otherwise("keep").alias("advice"))
    return found.join(t.groupBy("p_name").agg(F.countDistinct("p_brand").alias("brands")), "p_name")


# Weights of the fields of two entries.
ENTRY_SETS, ENTRY_SAME = {"title": 0.4, "description": 0.3, "tags": 0.2}, {"kind": 0.1}

_ENTRIES = r"""n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, source, lang, n_chars % 2 AS importance, ['f' || (doc_id % 7)] AS features, list_distinct(list_filter(regexp_split_to_array(lower(split_part(coalesce(text, ''), chr(10), 1)), '[\x20\x09-\x0D]+'), lambda x: length(x) > 2)) AS title,
list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: length(x) > 2)) AS description FROM n WHERE place <= 100),
r AS (SELECT *, list_sort(list_filter(description, lambda x: length(x) > 9)) AS tags FROM w)"""


@query(rf"""WITH {_ENTRIES}, p AS (SELECT a.source, a.doc_id AS newer_id, b.doc_id AS older_id, a.lang AS la, b.lang AS lb, a.importance IS NOT DISTINCT FROM b.importance AS equal, list_filter(a.tags, lambda x: list_contains(b.tags, x)) AS shared, list_intersect(a.features, b.features) AS features,
coalesce(len(list_intersect(a.title, b.title)) / nullif(len(a.title) + len(b.title) - len(list_intersect(a.title, b.title)), 0), 0.0) AS jt, coalesce(len(list_intersect(a.description, b.description)) / nullif(len(a.description) + len(b.description) - len(list_intersect(a.description, b.description)), 0), 0.0) AS jd,
coalesce(len(list_intersect(a.tags, b.tags)) / nullif(len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags)), 0), 0.0) AS jg FROM r a JOIN r b ON a.source IS NOT DISTINCT FROM b.source AND a.doc_id > b.doc_id),
s AS (SELECT *, jt * 0.4::DOUBLE + jd * 0.3::DOUBLE + jg * 0.2::DOUBLE + (la IS NOT DISTINCT FROM lb)::INT * 0.1::DOUBLE AS sim FROM p), o AS (SELECT *, floor(sim * 100 + 0.5) / 100 AS similarity FROM s WHERE sim >= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, newer_id DESC, older_id DESC) AS rank FROM o)
SELECT source, rank::INT AS rank, newer_id, older_id, similarity, CASE WHEN sim > 0.8 THEN CASE WHEN equal THEN 'delete-older' ELSE 'merge' END WHEN sim > 0.5 THEN 'merge' ELSE 'keep-both' END AS action,
coalesce(nullif(concat_ws(', ', CASE WHEN jt > 0.6 THEN 'similar titles' END, CASE WHEN la IS NOT DISTINCT FROM lb THEN 'both ' || coalesce(la, 'unknown') || 's' END, CASE WHEN len(shared) > 0 THEN 'shared tags: ' || array_to_string(shared, ', ') END, CASE WHEN len(features) > 0 THEN 'same feature: ' || array_to_string(features, ', ') END), ''), floor(sim * 100 + 0.5)::BIGINT || '% similar') AS reason FROM k WHERE rank <= 20""")
def similar_entries(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best matches among the newest 100 entries of each source, with what makes them alike and what to do.

    An entry's title is its first line, its description the whole text, its tags the words of ten characters or more.
    """
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    # ids alone are ranked, so texts are read for the entries that count
    newest = shared_table(docs.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))).alias("place")).where("place <= 100").select("doc_id"), "newest")
    newest = F.broadcast(newest) if newest.count() <= M.MAX_BROADCAST_IDS else newest
    text = F.coalesce("text", F.lit(""))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda x: F.length(x) > 2))
    entries = docs.join(newest, "doc_id", "left_semi").select("doc_id", "source", F.col("lang").alias("kind"), (F.col("n_chars") % 2).alias("importance"), F.array(F.concat(F.lit("f"), F.col("doc_id") % 7)).alias("features"), words(F.split_part(text, F.lit("\n"), F.lit(1))).alias("title"), words(text).alias("description"))
    entries = shared_table(entries.withColumn("tags", F.array_sort(F.filter("description", lambda x: F.length(x) > 9))), "entries")
    pairs = record_pairs(records(entries, "doc_id", ENTRY_SETS, ENTRY_SAME, "source"), ENTRY_SETS, ENTRY_SAME, 0.5, ["title", "description"])
    about = entries.select("doc_id", F.struct("kind", "importance", "features", "tags").alias("e"))
    both = pairs.join(entries.select(F.col("doc_id").alias("b"), "source"), "b").withColumn("rounded", js_round(F.col("similarity") * 100) / 100)
    order = Window.partitionBy("source").orderBy(F.desc("rounded"), F.desc("b"), F.desc("a"))
    best = both.withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    best = best.join(about.toDF("b", "x"), "b").join(about.toDF("a", "y"), "a")
    two = lambda f: (F.col(f"x.{f}"), F.col(f"y.{f}"))
    action = match_action(F.col("similarity"), F.col("x.importance").eqNullSafe(F.col("y.importance")))
    reason = match_reason(F.col("similarity"), F.col("title_similarity"), two("kind"), two("tags"), two("features"))
    return best.select("source", "rank", F.col("b").alias("newer_id"), F.col("a").alias("older_id"), F.col("rounded").alias("similarity"), action.alias("action"), reason.alias("reason"))
