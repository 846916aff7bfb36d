"""Registered queries of the corpus operators and their SQL twins. Each query applies its operator
to the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkseek.llm import centroids, decontaminate, lm_score, merkle, packing, pii, quality, quotes, sharding, simhash, token_counts, topk, toxicity, twins
from larkseek.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {**twins.TWINS}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good. Background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score_documents(rows, quality.co_train(rows))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that every call does the whole work."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of the embeddings; queries are the rows whose id is divisible by 50."""
    rows = topk.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("id") % 50 == 0))


@query
def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against texts that lost their line feeds, in about half of the rows."""
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), found={"text": found})


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(centroids.integers(table(spark, sf_dir, "embeddings"))).drop("centroid")


@query
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op6_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT item, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sizes)),
lengths AS (SELECT DISTINCT n FROM sizes),
docwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, d.n, i, item FROM docwin d JOIN windows b ON d.n = b.n AND d.win = b.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


ORACLES["op5_lm_scoring"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AND doc_id IS NOT NULL AS target,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, target, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
seq AS (SELECT r, target, i, word FROM tok UNION ALL SELECT r, target, len(w) + 1, '.' FROM d),
pairs AS (SELECT r, target, word, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), '.') AS h FROM seq),
uni AS (SELECT word, CAST(count(*) FILTER (target) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS b FROM seq GROUP BY word),
alls AS (SELECT coalesce(sum(t), 0) AS nt, coalesce(sum(b), 0) AS nb, count(*) AS v FROM uni),
bi AS (SELECT h, word, CAST(count(*) FILTER (target) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS b FROM pairs GROUP BY h, word),
loss AS (SELECT bi.h, bi.word, CAST(round((ln((bi.b + 4.0 * ((w.b + 1) / (nb + v))) / (c.b + 4.0)) - ln((bi.t + 4.0 * ((w.t + 1) / (nt + v))) / (c.t + 4.0))) * 1000000) AS BIGINT) AS diff
  FROM bi JOIN uni w ON bi.word = w.word JOIN uni c ON bi.h = c.word, alls),
sums AS (SELECT r, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(diff) AS BIGINT) AS loss_difference FROM pairs JOIN loss USING (h, word) GROUP BY r)
SELECT doc_id, n_tokens, loss_difference, CAST(loss_difference AS DOUBLE) / (1000000 * n_tokens) AS score FROM d JOIN sums USING (r)"""

ORACLES["op9_exact_top_k"] = """
WITH codes AS (
  SELECT vec_id AS id, list_transform(range(64), lambda i: coalesce(embedding[i + 1], 0) > 0) AS bits FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
pairs AS (
  SELECT q.id AS query_id, r.id AS neighbour_id,
    CAST(len(list_filter(range(64), lambda i: q.bits[i + 1] <> r.bits[i + 1])) AS INTEGER) AS distance
  FROM codes q, codes r WHERE q.id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10"""

ORACLES["op10_quotation_linking"] = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, rowid) - 1 AS message,
    string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS ls, coalesce(text, '') AS text
  FROM (SELECT row_number() OVER () AS rowid, * FROM conversations)),
every AS (SELECT conv_id, message, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw),
flagged AS (SELECT *, regexp_matches(line, '^\s{0,3}>') AS q,
    regexp_matches(line, '^[^>]{1,200}\b(wrote|schrieb|écrit|escribió) ?:[ \t]*$') AS att FROM every),
kept AS (SELECT * FROM (SELECT *, att AND coalesce(lead(q) OVER (PARTITION BY conv_id, message ORDER BY i), false) AS gone FROM flagged) WHERE NOT gone),
body AS (SELECT conv_id, message, bool_or(q) AS quotes, trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT q), ' ' || chr(9) || chr(10) || chr(13)) AS own
  FROM kept GROUP BY conv_id, message),
marked AS (SELECT *, CASE WHEN q THEN regexp_extract(line, '^((?:\s{0,3}>)+)', 1) ELSE '' END AS mark FROM kept),
said AS (SELECT conv_id, message, i, q, len(regexp_replace(mark, '[^>]', '', 'g')) AS depth,
    trim(regexp_replace(lower(substr(line, len(mark) + 1)), '\s+', ' ', 'g')) AS t FROM marked),
opens AS (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER w OR t = '' THEN 1 ELSE 0 END AS o FROM said
  WINDOW w AS (PARTITION BY conv_id, message ORDER BY i)),
runs AS (SELECT *, sum(o) OVER (PARTITION BY conv_id, message ORDER BY i) AS run FROM opens),
units AS (SELECT conv_id, message, depth, t FROM runs WHERE t <> ''
  UNION ALL SELECT conv_id, message, depth, string_agg(t, ' ' ORDER BY i) FROM runs WHERE t <> '' GROUP BY conv_id, message, depth, run),
originals AS (SELECT conv_id, t, min(message) AS original FROM units WHERE depth = 0 GROUP BY conv_id, t),
hits AS (SELECT u.conv_id, u.message, u.depth, len(u.t) AS chars, CASE WHEN o.original < u.message THEN o.original END AS original
  FROM units u LEFT JOIN originals o ON u.conv_id IS NOT DISTINCT FROM o.conv_id AND u.t = o.t WHERE u.depth > 0),
sums AS (SELECT conv_id, message, depth, original, sum(chars) AS chars, count(*) AS n FROM hits GROUP BY ALL),
links AS (SELECT conv_id, message, CAST(sum(n) AS BIGINT) AS n_quotes, CAST(coalesce(sum(n) FILTER (original IS NOT NULL), 0) AS BIGINT) AS n_linked,
    arg_max(original, row(-depth, chars, original)) FILTER (original IS NOT NULL) AS linked FROM sums GROUP BY conv_id, message),
replies AS (SELECT r.conv_id, r.turn, r.role, r.message, r.text, l.linked, l.n_quotes, l.n_linked,
    coalesce(l.linked, CASE WHEN r.message > 0 THEN r.message - 1 END) AS reply_to
  FROM raw r LEFT JOIN links l ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.message = l.message),
firsts AS (SELECT conv_id, reply_to, min(message) AS message FROM replies WHERE reply_to IS NOT NULL GROUP BY conv_id, reply_to),
chains AS (
  SELECT conv_id, message, message AS chain FROM replies r WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.message = r.message)
  UNION ALL
  SELECT c.conv_id, f.message, c.chain FROM chains c JOIN firsts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.reply_to = c.message)
SELECT r.conv_id, r.turn, r.role, r.message, r.reply_to,
  CASE WHEN r.linked IS NOT NULL THEN 'quote' WHEN r.message > 0 THEN 'previous' ELSE 'root' END AS link, c.chain,
  row_number() OVER (PARTITION BY r.conv_id ORDER BY c.chain, r.message) - 1 AS position,
  coalesce(r.n_quotes, 0) AS n_quotes, coalesce(r.n_linked, 0) AS n_linked, CASE WHEN b.quotes THEN coalesce(b.own, '') ELSE r.text END AS content
FROM replies r JOIN chains c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.message = r.message
  JOIN body b ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.message = r.message"""
