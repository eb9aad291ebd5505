"""One thin query for each operator, with production parameters, over its whole table; and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, encoding, exact, html_text, language, minhash, repeats, sharding, token_counts, warc

VOCABULARY = "word_bpe_49k.json"
SHARDS, MAX_TOKENS = 40, 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select(F.col("__id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    found = archive.read(archive.look_up(archive.captures), with_payload=False)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.balanced_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return found.select(F.col("__id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit"), percent=5).alias("contaminated"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words_removed", "n_removed", "n_words_repeated", spans.alias("removed_spans"), "text", "n_units")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    profiles = language.learn(docs.where(~held_out))
    found = language.predict(docs, profiles, [F.col("doc_id"), held_out.alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoding.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.withColumnRenamed("__id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_html_text, op2_minhash, op3_warc, op4_shards, op5_decontaminate, op6_exact, op7_repeats, op8_language, op9_token_counts, op10_bpe)}
QUERIES["pipeline"] = corpus_pipeline.run

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) % 32) + 1)::INT, 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL = {
    "op2_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
r AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
same AS (SELECT d.doc_id AS a, r.rep AS b FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) d JOIN r USING (s)),
rg AS (SELECT rep, unnest(s) AS g FROM r),
co AS (SELECT x.rep AS a, y.rep AS b, count(*) AS k FROM rg x JOIN rg y ON x.g = y.g AND x.rep < y.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM co JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k) UNION SELECT a, b FROM same WHERE a <> b),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, d.b FROM reach JOIN d ON reach.b = d.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id""",
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b""",
    "op4_shards": f"""
WITH RECURSIVE t AS (SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT doc_id, (length(h) // 2 + 16)::BIGINT AS size,
  xor(list_reduce(list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, (2 * j + 1)::INT, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c % 256, x) + 1)::INT]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM raw, tab),
p AS (SELECT *, sum(size) OVER o AS upto, row_number() OVER o - 1 AS number, sum(size) OVER () AS total FROM z WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least({SHARDS - 1}, ((upto - size // 2) * {SHARDS}) // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (number - min(number) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS i, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT i, n, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT i, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, i FROM dw JOIN bw USING (n, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT i) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, i FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_exact": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256({_FOLDED}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {_FOLDED})""",
    # t: words with the white space behind them; u: the unit of each; r: runs of units that occur again (kind 0) or earlier (kind 1)
    "op7_repeats": rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS l, length(regexp_extract(text, '^[\x20\x09-\x0D]*')) AS lead FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, lead, generate_subscripts(l, 1) AS k, unnest(l) AS t FROM d),
w AS (SELECT *, regexp_extract(t, '^[^\x20\x09-\x0D]+') AS w, regexp_extract(t, '[\x20\x09-\x0D]*$') AS gap, lead + sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) - length(t) AS o FROM t),
e AS (SELECT *, contains(gap, chr(10)) OR right(w, 1) IN ('.', '!', '?') AS stop FROM w),
u AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM e),
x AS (SELECT doc_id, u, count(*) AS n, min(o) AS a, max(o + length(w)) AS b, min(k) AS k1, max(k) AS k2, string_agg(translate(w, '{_UP}', '{_LOW}'), ' ' ORDER BY k) AS key FROM u GROUP BY 1, 2),
f AS (SELECT *, count(*) OVER (PARTITION BY key) > 1 AS again, row_number() OVER (PARTITION BY key ORDER BY doc_id, u) > 1 AS later FROM x),
g AS (SELECT *, 0 AS kind, u - row_number() OVER (PARTITION BY doc_id ORDER BY u) AS run FROM f WHERE again UNION ALL SELECT *, 1, u - row_number() OVER (PARTITION BY doc_id ORDER BY u) FROM f WHERE later),
r AS (SELECT doc_id, kind, sum(n) AS n, count(*) AS units, min(a) AS a, max(b) AS b, min(k1) AS k1, max(k2) AS k2 FROM g GROUP BY doc_id, kind, run HAVING sum(n) >= 25 OR max(b) - min(a) >= 200),
c AS (SELECT doc_id, sum(n) FILTER (kind = 1) AS n_words_removed, sum(units) FILTER (kind = 1) AS n_removed, sum(n) FILTER (kind = 0) AS n_words_repeated,
      string_agg(a || '-' || b, ',' ORDER BY a) FILTER (kind = 1) AS spans FROM r GROUP BY 1),
left_ AS (SELECT e.doc_id, string_agg(CASE WHEN r.k1 IS NULL THEN e.t WHEN e.k = r.k2 AND contains(e.gap, chr(10)) AND NOT contains(coalesce(p.gap, chr(10)), chr(10)) THEN chr(10) ELSE '' END, '' ORDER BY e.k) AS text
      FROM e LEFT JOIN r ON r.kind = 1 AND r.doc_id = e.doc_id AND e.k BETWEEN r.k1 AND r.k2 LEFT JOIN e p ON p.doc_id = r.doc_id AND p.k = r.k1 - 1 GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_units FROM x GROUP BY 1)
SELECT o.doc_id, coalesce(n_words_removed, 0)::BIGINT AS n_words_removed, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_words_repeated, 0)::BIGINT AS n_words_repeated, coalesce(spans, '') AS removed_spans,
       CASE WHEN n_removed > 0 THEN left(o.text, d.lead) || left_.text ELSE o.text END AS text, coalesce(n_units, 0)::BIGINT AS n_units
FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN left_ USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
