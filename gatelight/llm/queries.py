"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gatelight.llm import alignment, bpe, exact_dedup, filter_audit, hash_ring, html_extract, media, near_dedup, packing, quality, suffix_dedup, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode_table(bpe.encode_table(table(spark, sf_dir, "documents"), *rule), *rule))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(token_files.read(files))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.fingerprints(media.to_wav(table(spark, sf_dir, "documents"))))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_ring.digests(hash_ring.place(table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(filter_audit.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)[0]


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_html_extract": op10_html_extract,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
    SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size,
       (d.doc_id IS NOT DISTINCT FROM g.keep_id) AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""",
    "op12_filter_audit": r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), f AS (
    SELECT d.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
           [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
            regexp_matches(t, '[#$%&*|]'), d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS fails
    FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id
), c AS (
    SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c,
         (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
    SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS letter, fails[instr('ABCDE', substr(filter_order, step, 1))] AS fail,
           fails[1]::INTEGER + fails[2]::INTEGER + fails[3]::INTEGER + fails[4]::INTEGER + fails[5]::INTEGER AS n_fails,
           least(CASE WHEN fails[1] THEN instr(filter_order, 'A') ELSE 9 END, CASE WHEN fails[2] THEN instr(filter_order, 'B') ELSE 9 END,
                 CASE WHEN fails[3] THEN instr(filter_order, 'C') ELSE 9 END, CASE WHEN fails[4] THEN instr(filter_order, 'D') ELSE 9 END,
                 CASE WHEN fails[5] THEN instr(filter_order, 'E') ELSE 9 END) AS first_step
    FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (WHERE first_step > step), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE first_step = step), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE fail AND first_step < step), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE fail AND n_fails = 1), 0) AS unique_fails,
           coalesce(sum(n) FILTER (WHERE first_step = step AND good), 0) AS good_lost,
           coalesce(sum(n) FILTER (WHERE first_step = step AND toxic), 0) AS toxic_lost
    FROM s GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
""",
}
