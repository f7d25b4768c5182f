"""Registered queries of the llm operators, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, compression, decontam, license_scan, line_dedup, mixing, ngram_join, periodic, pii, quality,
               ranked_search, suffix_dedup, token_counts)
from .common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.chat_windows(turns))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_tokens(read(spark, sf_dir, "documents")).select(
        "doc_id", "section", "start", "stop", F.col("tokens").cast("long").alias("n_tokens"), "n_crossing")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_spans(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


#: Texts as bytes; a place is doc_id * 2**32 + start.
OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
o AS MATERIALIZED (SELECT r, unnest(range(0, octet_length(b) - 99)) AS p FROM d),
p AS MATERIALIZED (SELECT r, p, doc_id::HUGEINT * 4294967296 + p AS place, b[p + 1:p + 100] AS k FROM o JOIN d USING (r)),
f AS (SELECT k, min(place) AS first FROM p GROUP BY k HAVING count(*) > 1),
g AS (SELECT r, p FROM p JOIN f USING (k) WHERE place > first),
n AS (SELECT r, p, CASE WHEN p - lag(p) OVER w <= 100 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY r ORDER BY p)),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS no FROM n),
s AS (SELECT r, no, min(p) AS start, max(p) + 100 AS stop FROM i GROUP BY r, no),
e AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY r ORDER BY start) AS last_stop FROM s),
c AS (SELECT r, count(*) AS n, sum(stop - start) AS bytes, max(stop) AS end_,
             string_agg(CASE WHEN start > last_stop THEN hex(b[last_stop + 1:start]) ELSE '' END, '' ORDER BY start) AS head
      FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN head IS NULL THEN b WHEN end_ < octet_length(b) THEN unhex(head || hex(b[end_ + 1:octet_length(b)]))
                   ELSE unhex(head) END) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.longest_run(periodic.periodic_runs(read(spark, sf_dir, "documents"), repeat_tails=True))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT doc_id, w, len(w)::HUGEINT AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::HUGEINT AS nn, sum(n)::HUGEINT AS ll FROM sizes),
terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
each AS (SELECT doc_id, n, unnest(w) AS term FROM sizes),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM each
       WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS w FROM df, total),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf::HUGEINT) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS s
           FROM tf JOIN weight USING (term), total),
score AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM terms JOIN impact USING (term)
          GROUP BY item_id, doc_id HAVING sum(s) > 0)
SELECT item_id, rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score)
WHERE rank <= 50
"""


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_ngram_join, op4_chat_format,
                                  op5_quality_classifier, op6_personal_data, op7_decontamination,
                                  op8_compression_rules, op9_token_counts,
                                  op10_license_scan, op11_suffix_dedup, op12_periodic_runs, op13_ranked_search)}

ORACLE = {"op2_line_dedup": OP2_SQL, "op11_suffix_dedup": OP11_SQL, "op13_ranked_search": OP13_SQL}
