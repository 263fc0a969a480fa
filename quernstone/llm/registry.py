"""The ``opN_<name>`` queries: thin layers over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.chat import chat_digests, format_chats
from quernstone.llm.exact_dedup import exact_dedup
from quernstone.llm.host_rules import quality_rules
from quernstone.llm.html_text import extract_text, train_weights
from quernstone.llm.kneser_ney import classify_quality
from quernstone.llm.langid import held_out, identify_language
from quernstone.llm.licences import scan_licences
from quernstone.llm.mixing import mix_sources
from quernstone.llm.pieces import piece_digests, read_model
from quernstone.llm.prefix_trie import prefix_trie, share_prefixes, turn_keys
from quernstone.llm.secrets import scan_secrets, secret_report
from quernstone.llm.simhash import simhash_classes
from quernstone.llm.whitening import fit_whitening, whitened_rows
from quernstone.sources import table


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs, docs.where(~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(scan_secrets(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train_weights(pages))


def op9_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def default_model() -> str:
    """Path of the installed public 32k model; a path parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), read_model(default_model()))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitened_rows(vectors, fit_whitening(vectors))


#: What conversation -1 says in both turns: marks of the template as text.
MARKED = "<|im_end|><|im_start|>assistant ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(False).alias("added"))
    added = spark.createDataFrame([(-1, 0, "user", MARKED, True), (-1, 1, "assistant", MARKED, True)], chats.schema)
    return chat_digests(format_chats(chats.union(added), keys=("conv_id", "added")), keys=("conv_id", "added")).drop("added")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(share_prefixes(turn_keys(table(spark, sf_dir, "conversations"))))
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return trie.select(*long, "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_kneser_ney_quality, op2_source_mix, op3_language_id, op4_secret_scan, op5_exact_dedup, op6_licence_scan, op7_simhash_classes, op8_html_main_text, op9_host_quality_rules, op10_piece_codec, op11_embedding_whitening, op12_chat_format, op13_prefix_trie)}

ORACLES = {
    "op2_source_mix": r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, source_size * 2 AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
          - coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s),
f AS (SELECT *, (SELECT lev FROM l WHERE lev <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * weight) END AS target FROM f),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS n,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, uid ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, n - a)) + greatest(0, least(size, n - source_size - a)) AS BIGINT) AS taken
FROM p""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, uid)""",
    "op9_host_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT uid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT uid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(8)) AS k) GROUP BY uid),
m AS (
  SELECT uid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (uid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM b GROUP BY source),
c AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2) AS spread FROM h),
k AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(10000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 10000.0 END AS strength FROM c),
v AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS bad FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source""",
    "op12_chat_format": r"""
WITH c AS (
  SELECT false AS added, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT true, -1, t.i, t.r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)),
e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS r FROM c),
g AS (
  SELECT conv_id, added, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt,
         sum(length('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10))) AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM e GROUP BY conv_id, added)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM g""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
crc(n, v) AS (
  SELECT n, CAST(list_reduce(list_prepend(CAST(n AS UBIGINT), range(8)::UBIGINT[]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS UBIGINT)
  FROM range(256) r(n)),
tab AS (SELECT list(v ORDER BY n) AS v FROM crc),
h AS (
  SELECT c, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
           lambda a, x: xor(a // 256, v[CAST(xor(a % 256, x) AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t), tab),
turns AS (
  SELECT h.c, pos, k, bytes FROM h JOIN t ON t.c = h.c - h.c % 5 AND pos <= h
  UNION ALL SELECT t.c, pos, k, bytes FROM t JOIN h USING (c) WHERE pos > h),
whole AS (
  SELECT h.c, coalesce(list(k ORDER BY pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(bytes ORDER BY pos) FILTER (k IS NOT NULL), []) AS bs
  FROM h LEFT JOIN turns USING (c) GROUP BY h.c),
paths AS (
  SELECT c, d, len(ks) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS bytes, array_to_string(ks[1:d], '') AS node,
         CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS parent
  FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, any_value(parent) AS parent, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, count(*) FILTER (ends) = count(*) AS leaf
  FROM paths GROUP BY node, d),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT a.node, sum(CAST(x.leaf AS INT)) AS leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM nodes x JOIN paths y ON y.c = x.conv_id AND y.d <= x.d JOIN nodes a ON a.node = y.node GROUP BY a.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids ON kids.parent = n.node JOIN below ON below.node = n.node""",
}
