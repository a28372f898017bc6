"""Registered queries of this subpackage: each applies one operator to its
whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (chat, decontamination, exact_dedup, fertility, fill_middle, language_id,
                            lexical, licenses, line_dedup, mixing, ngram_join, quality,
                            token_output)
from ledgerlens.llm.common import crc_bucket, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(builder):
        QUERIES[name] = builder
        if sql:
            ORACLES[name] = sql
        return builder
    return register


@query("op1_entropy_mix")
def entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query("op2_ppm_language")
def ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 3) == 1
    model = language_id.train(docs.filter(~held))
    out = language_id.predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


_CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, before IS NULL OR before <> role AS opens,
         replace(replace(replace(role, '&', '&amp;'), '[', '&lsb;'), '<', '&lt;') AS role_out,
         replace(replace(replace(text, '&', '&amp;'), '[', '&lsb;'), '<', '&lt;') AS text_out
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(3 + 4 + sum(length(text_out) + 5 * 1)
            + sum(CASE WHEN opens THEN 6 + length(role_out) + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op3_chat_format", _CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(extra))
    return chat.digest(chat.read_back(formatted))


@query("op4_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query("op5_pairwise_quality")
def pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_bucket("doc_id", 4) == 2
    model = quality.train(docs, labels.filter(~held))
    out = quality.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op6_cgk_decontamination")
def cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


@query("op7_line_runs")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


_EXACT_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm
  FROM documents),
groups AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM texts JOIN groups USING (norm)
"""


@query("op8_exact_dedup", _EXACT_SQL)
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_token_output")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.corpus_path(spark)
    token_output.write_tokens(table(spark, sf_dir, "documents"), path,
                              public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_tokens(spark, path)


_RANKED_SQL = """
WITH found AS (
  SELECT doc_id, rowid AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
docs AS (SELECT doc_id, r, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS HUGEINT) AS big_l FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
counted AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE)))
                    AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus),
parts AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS part
  FROM counted JOIN weights USING (term)
  JOIN (SELECT r, CAST(50 + ((50 * n * big_n) // big_l) AS BIGINT) AS m FROM docs, corpus) USING (r)),
scores AS (
  SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term)
  GROUP BY item_id, r HAVING sum(part) > 0),
ranked AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores JOIN docs USING (r))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op11_ranked_search", _RANKED_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_fertility_rules")
def fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(p) for p in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    out = fertility.quality_rules(table(spark, sf_dir, "documents"), paths, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "script", "broken",
                      F.col("chars_0").alias("chars_per_token"), F.col("bytes_0").alias("byte_share"),
                      F.col("bits_0").alias("token_bits"))


_MIDDLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
units AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed),
ranks AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p,
         array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s
  FROM ranks)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op13_fill_middle", _MIDDLE_SQL)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))
