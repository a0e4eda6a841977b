"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from . import packing

    return packing.packed(_table(spark, folder, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from . import simhash

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    rows = written(simhash.with_fingerprint(docs).select("doc_id", "fp"), "doc-fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return simhash.grouped(rows).select("doc_id", hexed, "component_id")


def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    from . import licenses

    return licenses.scanned(_table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from . import quality

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.judged(docs, carry=["doc_id"]).select("doc_id", *quality.BASE, "base_failed", "kept", "posterior")


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    from . import chat

    return chat.formatted(_table(spark, folder, "conversations"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from . import decontam

    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from . import tokencounts

    return tokencounts.document_counts(_table(spark, folder, "documents"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from . import ppm

    return ppm.scored(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    from . import warc

    return warc.read(warc.write(_table(spark, folder, "pages")))


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from . import suffixes

    return suffixes.repeated(_table(spark, folder, "documents"))


def op11_hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    from . import negatives

    return negatives.mined(_table(spark, folder, "embeddings"))


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from . import minhash

    return minhash.grouped(_table(spark, folder, "documents").select("doc_id", "text"))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from . import phrases

    return phrases.mined(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_license_scans": op3_license_scans,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negative_mining": op11_hard_negative_mining,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest,
            CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op11_hard_negative_mining": """
        WITH v AS (
            SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
                CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS a JOIN v AS b ON a.id % 50 = 0 AND a.id <> b.id
        ), p AS (
            SELECT anchor_id, id, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id,
            CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
            s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3
    """,
    "op13_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w
            FROM (
                SELECT lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
                FROM documents
            )
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang
        ), grams AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS t(k))
            GROUP BY ALL HAVING count(*) >= 100
        ), cuts AS (
            SELECT g.lang, g.phrase, g.k, g.f AS a, j, l.f AS l, r.f AS r, n, (1000 * g.f * n) // (l.f * r.f) AS score
            FROM grams AS g JOIN totals USING (lang), range(1, 5) AS t(j)
            JOIN grams AS l ON l.lang = g.lang AND l.phrase = array_to_string(string_split(g.phrase, ' ')[: j], ' ')
            JOIN grams AS r ON r.lang = g.lang AND r.phrase = array_to_string(string_split(g.phrase, ' ')[j + 1 :], ' ')
            WHERE g.k > j
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), inside AS (
            SELECT DISTINCT lang, f, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS phrase
            FROM (
                SELECT lang, f, phrase, m, unnest(range(1, k - m + 2)) AS i FROM grams, range(2, 5) AS t(m) WHERE m < k
            )
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
            CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM scored AS s
        WHERE NOT EXISTS (SELECT 1 FROM inside AS i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 100 * s.a)
        QUALIFY rank <= 2000
    """,
}
