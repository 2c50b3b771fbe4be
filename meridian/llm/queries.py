"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fmindex, linededup, mixing, packing, periodic, pieces, pitmanyor, resampling, rules, simhash, suffixdedup, tokencounts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_sections(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op4_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(fmindex.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = packing.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return packing.read_tokens(manifest, ids=False).drop("ids")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.dedup_substrings(_table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False).drop("ids")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_key")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.scores(_table(spark, sf_dir, "documents"))


def op11_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.allocate(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=150, most=2))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return periodic.digest(periodic.find(docs.withColumn("text", periodic.planted(F.col("text"), F.col("doc_id")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_token_counts,
        op3_line_dedup,
        op4_warc_index_merge,
        op5_benchmark_decontamination,
        op6_token_id_output,
        op7_suffix_array_dedup,
        op8_sentencepiece,
        op9_quality_rules,
        op10_lm_scoring,
        op11_mixing_to_targets,
        op12_importance_resampling,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op3_line_dedup": """
WITH ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS win
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM ls WHERE doc_id IS NOT NULL)
),
f AS (SELECT doc_id, pos, first_value(struct_pack(d := doc_id, p := pos)) OVER (PARTITION BY win ORDER BY doc_id, pos) AS first
      FROM w WHERE trim(win, ' ' || chr(9) || chr(13) || chr(10)) <> ''),
gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM f WHERE doc_id <> first.d OR pos <> first.p),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
k AS (
  SELECT ls.doc_id, text, l, gone,
         CASE WHEN gone IS NULL THEN text
              ELSE coalesce(array_to_string(list_filter(l, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS kept
  FROM ls LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       length(kept)::BIGINT AS n_chars_kept, sha256(kept) AS kept_sha256
FROM k
""",
    "op4_warc_index_merge": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[i // 4 * 5 + 1 : i // 4 * 5 + 5])::INT >> (15 - i % 4 * 5)::INT) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s
""",
    "op5_benchmark_decontamination": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
