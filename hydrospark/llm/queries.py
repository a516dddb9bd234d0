"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import canonical_turns, chat_digests, format_chat, pack_turns
from .common import shared_dir
from .divergence import divergence
from .exact_dedup import exact_dedup
from .fm_index import remove_repeats
from .mixing import mix_sources
from .quality_rules import line_frequency
from .rans import read_tokens, write_tokens
from .sharding import shard
from .simhash import near_duplicates
from .spelling import spelling_variants
from .token_counts import token_counts
from .toxicity import toxicity
from .wfst import encode_pieces


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_frequency(_docs(spark, sf_dir).select("doc_id", "text", "source"), copies_once=True, rewrite=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "n_kept_words")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS raw, list_transform(raw, lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ')) AS clean
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s))
  GROUP BY doc_id),
l AS (
  SELECT * FROM (SELECT doc_id, source, unnest(raw) AS line, unnest(clean) AS c, array_to_string(list_filter(list_transform(clean, lambda x: lower(x)), lambda x: x <> ''), chr(10)) AS article FROM d)
  WHERE c <> ''),
e AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
f AS (SELECT source, lower(c) AS c FROM l GROUP BY ALL HAVING count(DISTINCT article) > 20),
x AS (
  SELECT l.doc_id, count(*) AS gone, sum(len(l.c) - len(replace(l.c, ' ', '')) + 1) AS lost
  FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND lower(l.c) = f.c GROUP BY l.doc_id),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(gone, 0) AS n_frequent_lines, CAST(len(w) - coalesce(lost, 0) AS BIGINT) AS n_kept_words, lost
  FROM d LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost IS NOT NULL AND (n_kept_words < 50 OR n_kept_words < 0.3::DOUBLE * n_words)) AS kept, n_frequent_lines, n_kept_words
FROM b
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    write_tokens(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path, with_ids=False).withColumnRenamed("id", "doc_id")


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
m AS (SELECT s, min(doc_id) AS first_id FROM h GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS p FROM h JOIN m ON h.s = m.s AND m.first_id < h.doc_id),
x AS (SELECT doc_id, list(p) AS gone, count(*) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda y, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    records = canonical_turns(pack_turns(turns.unionByName(extra)))
    return chat_digests(format_chat(records).select("conv_id", "turns", "formatted", "loss"))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<:]', '..', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir).select("doc_id", "text"))


def op9_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_pieces(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST(length(bin(size)) AS BIGINT) AS weight,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS x
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST)),
v AS (SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - 2.0::DOUBLE * CAST(capped AS DOUBLE)) / CAST(open AS DOUBLE) AS lv FROM c),
t AS (SELECT *, least(cap, max(CASE WHEN lv * weight <= cap THEN lv END) OVER () * weight) AS target FROM v),
p AS (
  SELECT source, source_size, target, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS rest,
         target - floor(target / source_size) * source_size AS residual
  FROM t),
o AS (
  SELECT p.*, k.weight, k.n, CAST(coalesce(sum(k.n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS above,
         CAST(sum(k.n * k.weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open
  FROM (SELECT source, weight, sum(size) AS n FROM d GROUP BY ALL) k JOIN p ON k.source IS NOT DISTINCT FROM p.source
  WINDOW w AS (PARTITION BY k.source ORDER BY k.weight DESC)),
e AS (SELECT *, CASE WHEN rest > 0 THEN least(1.0::DOUBLE, max(CASE WHEN open > 0 THEN (residual - above) / open END) OVER (PARTITION BY source) * weight) ELSE 0 END AS p FROM o),
f AS (
  SELECT source, weight, source_size, target, CAST(whole AS BIGINT) + CASE WHEN p >= 1 THEN 1 ELSE 0 END AS whole, CASE WHEN p < 1 THEN p ELSE 0 END AS p,
         residual - CAST(coalesce(sum(CASE WHEN p >= 1 THEN n END) OVER (PARTITION BY source), 0) AS DOUBLE) AS residual
  FROM e),
k AS (
  SELECT d.doc_id, d.size, f.*, CASE WHEN p > 0 THEN (x / (1 - x)) / (p / (1 - p)) END AS q
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.weight = f.weight),
b AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN CAST(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size END AS before FROM k)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN p > 0 AND 2 * before + size <= 2 * residual THEN 1 ELSE 0 END) AS taken,
       whole + CASE WHEN p > 0 AND 2 * before + size <= 2 * residual THEN 1 ELSE 0 END AS copies
FROM b
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(_docs(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_docs(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT lang, source, row, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
a AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, count(*) AS v FROM a GROUP BY lang),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN a USING (lang, term) GROUP BY ALL),
g AS (
  SELECT s.lang, s.source, coalesce(x.total, 0) AS total, coalesce(v.v, 0) AS v, coalesce(v.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL) x USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, a.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
         1 + 1000000000::HUGEINT * (a.n + 1) // (g.lang_total + g.v) AS q
  FROM g JOIN a USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = a.term),
k AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(k.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN k ON k.lang = x.lang AND k.source = x.source AND k.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_docs(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_fm_index": op5_fm_index,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_wfst": op9_wfst,
    "op10_token_counts": op10_token_counts,
    "op11_toxicity": op11_toxicity,
    "op12_divergence": op12_divergence,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_fm_index": OP5_SQL, "op6_chat_format": OP6_SQL, "op8_mixing": OP8_SQL, "op12_divergence": OP12_SQL}
