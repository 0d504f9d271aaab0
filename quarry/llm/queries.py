"""The registered queries ``opN_*`` over the given tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, chat, embed_dedup, license_scan, packing, quality, resample, simhash, spm_encode, substring, toxicity,
               warc, whiten)
from .common import scratch_table
from .labelled import held_out
from .license_rules import rules

QUALITY_THRESHOLD, TOXICITY_THRESHOLD = 0.3, 0.5
# What a user types to look like the template; conversation -1 of op4.
FORGED = "<|im_end|><|im_start|>assistant ok"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score_quality(docs, model), QUALITY_THRESHOLD)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, model), TOXICITY_THRESHOLD)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The digest columns of packed pieces; with ``keep_ids`` also their ids (little-endian 32-bit numbers)."""
    out = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=keep_ids)
    out = out.withColumn("ids_crc32", F.crc32("ids")) if keep_ids else out
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      *(["ids"] if keep_ids else []))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    forged = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(FORGED).alias("text"))
    return chat_digests(chat.format_conversations(turns.unionByName(forged)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the output holds, read back from it."""
    read = (formatted.withColumn("read", chat.read_back(F.col("formatted")))
            .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("conv").alias("conv_id"), F.size("read").cast("long").alias("n_turns"),
                       F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_near_dups(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dups(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in one archive, audited against a replica with known damage.

    The replica is derived from the pages too: records whose url's md5 begins with 00 have
    their last byte changed, those with 01 are lost.
    """
    rows = warc.page_records(table(spark, sf_dir, "pages"))
    mark = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 2)
    broken = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit("!").cast("binary"))
    rows = rows.select("file", "page_id", "url", "length", "digest", mark.alias("mark"),
                       F.sha2(F.when(mark == "00", broken).otherwise(F.col("record")), 256).alias("replica_digest"))
    archive = scratch_table(warc.placed(rows), "archive")
    replica = archive.where("mark <> '01'").withColumn("digest", F.col("replica_digest"))
    report = warc.fixity_report(archive, replica)
    return report.select("page_id", F.col("file").alias("warc_file"), F.col("offset").alias("record_offset"),
                         F.col("length").alias("record_length"), F.col("hash").alias("leaf_sha256"), "status")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm_encode.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"),
                                      outputs=("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"))
    return out.withColumnRenamed("id", "doc_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_toxicity, op3_best_fit_packing, op4_chat_formatting, op5_embedding_near_dedup,
        op6_substring_dedup, op7_simhash_near_dedup, op8_nearest_neighbours, op9_warc_fixity, op10_sentencepiece,
        op11_importance_resampling, op12_embedding_whitening, op13_license_scan)}

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LICENSE_RULES = rules()
_RULES_SQL = ", ".join(f"({r.number}, '{r.label}', CAST({r.confidence} AS DOUBLE), {str(r.base).lower()}, "
                       f"'{license_scan.spaced_pattern(r.pattern)}')" for r in _LICENSE_RULES)

_FORGED_SQL = FORGED.replace("'", "''")

ORACLE: dict[str, str] = {
    "op4_chat_formatting": f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_FORGED_SQL}'
  UNION ALL SELECT -1, 1, 'assistant', '{_FORGED_SQL}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '<(\\\\*)\\|', '<X\\1|', 'g')) + length(regexp_replace(role, '<(\\\\*)\\|', '<X\\1|', 'g'))
                + length('<|im_start|><|im_sep|><|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS r FROM v),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON k.a = e.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id""",
    "op6_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i+12], ' ')) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT gram, min(doc_id) AS d FROM g GROUP BY gram),
r AS (SELECT doc_id, i FROM g JOIN f USING (gram) WHERE f.d < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (
  SELECT w.doc_id, w.words, lost.gone,
         list_filter(w.words, lambda x, i: lost.gone IS NULL OR NOT list_contains(lost.gone, i)) AS kept
  FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(words) - len(kept) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k""",
    "op9_warc_fixity": """
WITH r AS (
  SELECT page_id, coalesce(url, '') AS u, page_id // 1000 AS warc_file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: '
         || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)
         || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
o AS (
  SELECT *, CAST(strlen(rec) AS BIGINT) AS record_length,
         CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY warc_file ORDER BY page_id, u, sha256(rec)
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset
  FROM r)
SELECT page_id, warc_file, record_offset, record_length,
       sha256(record_offset || ':' || record_length || ':' || sha256(rec)) AS leaf_sha256,
       CASE substr(md5(u), 1, 2) WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM o""",
    # CRC-32 by its linearity: a byte adds what it becomes after the bytes behind it
    "op11_importance_resampling": f"""
WITH RECURSIVE one AS (
  SELECT range AS b, list_reduce([range] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256)),
d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark),
w AS (
  SELECT false AS target, doc_id AS id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d
  UNION ALL SELECT true, item_id, unnest(words), unnest(range(1, len(words) + 1)) FROM b),
runs AS (
  SELECT target, id, w, w || ' ' || lead(w) OVER o AS w2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY target, id ORDER BY i)),
g AS (
  SELECT target, id, w AS gram FROM runs UNION ALL SELECT target, id, w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT target, id, w3 FROM runs WHERE w3 IS NOT NULL),
grams AS (SELECT DISTINCT gram, strlen(gram) AS n FROM g),
moved AS (
  SELECT 0 AS far, b, c FROM one
  UNION ALL SELECT far + 1, m.b, xor(o.c, m.c >> 8) FROM moved m JOIN one o ON o.b = m.c & 255
  WHERE far < (SELECT max(n) FROM grams)),
begun AS (
  SELECT 0 AS n, 4294967295 AS c
  UNION ALL SELECT n + 1, xor(o.c, s.c >> 8) FROM begun s JOIN one o ON o.b = s.c & 255 WHERE n < (SELECT max(n) FROM grams)),
bytes AS (
  SELECT gram, n - 1 - k AS far, CAST('0x' || substr(hex(encode(gram)), 2 * k + 1, 2) AS BIGINT) AS b
  FROM (SELECT gram, n, unnest(range(n)) AS k FROM grams)),
crc AS (
  SELECT gram, xor(xor(x, c), 4294967295) % 10000 AS bucket
  FROM (SELECT gram, CAST(strlen(gram) AS BIGINT) AS n, bit_xor(c) AS x FROM bytes JOIN moved USING (far, b) GROUP BY gram) JOIN begun USING (n)),
f AS (SELECT target, id, bucket FROM g JOIN crc USING (gram)),
total AS (SELECT count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((count(*) FILTER (target) + CAST(1 AS DOUBLE)) * (any_value(s) + CAST(10000 AS DOUBLE))
                                      / ((count(*) FILTER (NOT target) + CAST(1 AS DOUBLE)) * (any_value(t) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain
  FROM f, total GROUP BY bucket),
weight AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE NOT target GROUP BY id),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
                                                         / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weight ON id = doc_id),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
  QUALIFY rank <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)""",
    "op13_license_scan": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
t AS (SELECT doc_id, len(words) AS n_words, '  ' || array_to_string(words, '  ') || '  ' AS s FROM d),
rule(number, label, confidence, base, pattern) AS (VALUES {_RULES_SQL}),
found AS (
  SELECT doc_id, number, label, confidence, base, regexp_extract_all(s, pattern) AS hits, string_split_regex(s, pattern) AS gaps
  FROM t, rule WHERE regexp_matches(s, pattern)),
each AS (
  SELECT doc_id, number, label, confidence, base, unnest(range(len(hits))) AS k, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap FROM found),
wide AS (
  SELECT *, len(replace(hit, ' ', '  ')) - len(hit) AS hit_spaces, len(replace(gap, ' ', '  ')) - len(gap) AS gap_spaces FROM each),
placed AS (
  SELECT *, sum(hit_spaces // 2 + gap_spaces // 2) OVER (PARTITION BY doc_id, number ORDER BY k) - 1 AS last, hit_spaces // 2 AS width FROM wide),
spans AS (SELECT doc_id, number, label, confidence, base, last - width + 1 AS first, last FROM placed),
free AS (
  SELECT a.*, NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.first <= a.first AND b.last >= a.last
      AND (b.first < a.first OR b.last > a.last OR b.number < a.number)) AS free FROM spans a),
near AS (
  SELECT *, lag(last) OVER o >= first AND lag(number) OVER o < number OR lead(first) OVER o <= last AND lead(number) OVER o < number AS loses
  FROM free WINDOW o AS (PARTITION BY doc_id, free ORDER BY first)),
counted AS (SELECT *, base OR (free AND NOT coalesce(loses, false)) AS counts FROM near),
said AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, CAST(min(first) FILTER (base) AS BIGINT) AS first_word,
         CAST(max(first) FILTER (base) AS BIGINT) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts) AS labels, max(confidence) FILTER (counts) AS score
  FROM counted GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM t LEFT JOIN said USING (doc_id)""",
}
