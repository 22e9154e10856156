"""The queries of this subpackage, each over its whole table, and the SQL of what SQL can express.

SQL cannot express the ten operators as a whole. Of four of them it can tell some columns: these columns of the same
results are queries of their own, each with its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, media, mix, quality, search, secrets, simhash, token_files, toxicity


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets out of ``op1_source_mix``."""
    return mix.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads read back by ``op2_media_columns``."""
    return media.query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans out of ``op5_secret_scan``."""
    return secrets.query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the bytes that ``op7_byte_bpe`` decodes its ids to."""
    return bpe.query(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES = {
    "op1_source_mix": mix.query,
    "op2_media_columns": media.query,
    "op3_language_id": langid.query,
    "op4_toxicity": toxicity.query,
    "op5_secret_scan": secrets.query,
    "op6_top_k_search": search.query,
    "op7_byte_bpe": bpe.query,
    "op8_simhash": simhash.query,
    "op9_quality": quality.query,
    "op10_token_files": token_files.query,
    "mix_targets": mix_targets,
    "media_payloads": media_payloads,
    "secret_counts": secret_counts,
    "decoded_texts": decoded_texts,
}

_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGNED = f"""({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE: dict[str, str] = {
    "mix_targets": """
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
filled AS (SELECT *, 3.0 * source_size / weight AS level, row_number() OVER o AS k,
  (sum(source_size) OVER () - 3.0 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM weighed WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)),
water AS (SELECT min(k) FILTER (scale <= level) AS k FROM filled)
SELECT d.doc_id, d.size, f.source_size, round(CASE WHEN f.k < w.k THEN 3.0 * f.source_size ELSE f.weight * (SELECT scale FROM filled x WHERE x.k = w.k) END, 3)::DOUBLE AS target
FROM docs d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source, water w""",
    "media_payloads": """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents), n AS (SELECT *, CAST(octet_length(body) AS BIGINT) AS n_bytes FROM t),
p AS (SELECT *, greatest(64, (n_bytes + 63) // 64 * 64) AS payload_bytes FROM n)
SELECT doc_id, n_bytes, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(body || unhex(repeat('00', CAST(payload_bytes - n_bytes AS INTEGER)))) AS payload_sha256 FROM p""",
    "secret_counts": f"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGNED}', 2), lambda x: len(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 16)) AS BIGINT) AS n_hex FROM documents""",
    "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
}
