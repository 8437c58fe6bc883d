"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import contamination_digest, find_contamination
from .exact_dedup import exact_dedup
from .packing import pack
from .periodic_runs import periodic_runs, planted_run, run_digest
from .personal_data import find_personal_data, personal_data_digest
from .sharding import shard_rows
from .simhash import near_duplicates
from .suffix_dedup import repeated_passages
from .tiered_packing import pack_tiers
from .token_counts import token_counts
from .toxicity import score_toxicity
from .url_filters import judge_urls
from .vector_codes import code_digest, compress_vectors

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_each=3)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(find_personal_data(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), length=200)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digest(compress_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), change=planted_run, change_by=seed))


def op13_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tiers(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tiers=(2048, 1024, 512, 256), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts,
        op2_sharding,
        op3_url_filters,
        op4_simhash,
        op5_toxicity,
        op6_personal_data,
        op7_decontamination,
        op8_suffix_dedup,
        op9_best_fit_packing,
        op10_exact_dedup,
        op11_vector_codes,
        op12_periodic_runs,
        op13_tiered_packing,
    )
}

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

_ROUNDS_SQL = "".join(
    f"""
        a{r} AS (
          SELECT x.vec_id, x.part, min_by(c.entry, d.far * 64 + c.entry) AS entry, min(d.far) AS far
          FROM x JOIN c{r} c USING (part), LATERAL (
            SELECT (x.x0 - c.x0) ** 2 + (x.x1 - c.x1) ** 2 + (x.x2 - c.x2) ** 2 + (x.x3 - c.x3) ** 2 AS far0), LATERAL (
            SELECT CAST(far0 AS BIGINT) AS far) d
          GROUP BY ALL),"""
    + f"""
        c{r + 1} AS (
          SELECT c.part, c.entry, coalesce(m.x0, c.x0) AS x0, coalesce(m.x1, c.x1) AS x1, coalesce(m.x2, c.x2) AS x2, coalesce(m.x3, c.x3) AS x3
          FROM c{r} c LEFT JOIN (
            SELECT part, entry, {", ".join(f"CAST(floor(sum(x{i}) / count(*)) AS BIGINT) AS x{i}" for i in range(4))}
            FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) m USING (part, entry)),"""
    * (r < 2)
    for r in range(3)
)

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": rf"""
        WITH u AS (
          SELECT row_number() OVER () AS rn, page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
          FROM pages),
        r(v, h, p) AS (VALUES {_RULES_SQL}),
        f AS (
          SELECT u.rn, r.*, row_number() OVER (PARTITION BY u.rn ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
          FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
        SELECT u.page_id, u.host, u.path, f.h || f.p AS rule, coalesce(f.v, 'allow') AS verdict
        FROM u LEFT JOIN f ON u.rn = f.rn AND f.k = 1""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_vector_codes": f"""
        WITH k AS (
          SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        x AS (
          SELECT vec_id, part, v[4 * part + 1] AS x0, v[4 * part + 2] AS x1, v[4 * part + 3] AS x2, v[4 * part + 4] AS x3
          FROM k, range(16) t(part)),
        c0 AS (
          SELECT part, entry, x0, x1, x2, x3
          FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),{_ROUNDS_SQL}
        s AS (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
        e AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM e JOIN k USING (vec_id), s""",
}
