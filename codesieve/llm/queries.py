"""The queries op1_ to op10_ and the pipeline, with the SQL of those that SQL can express.

op2, op3 (edit distance), op4, op5 and op9 (a tokenizer), op6 (byte windows), op7 (a trained model), op8 (components) and
op10 (EM) are not expressible; tests/llm compares them with brute force, an independent version or held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_digests

    return archive_digests(_table(spark, sf_dir, "pages"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rollups import rollup_documents

    labels = _table(spark, sf_dir, "labels")
    return rollup_documents(_table(spark, sf_dir, "documents"), labels.filter("toxic = 1"), labels.filter("quality = 0"))


def op5_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import coded_documents

    return coded_documents(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_html_text, op3_decontamination, op4_token_rollups, op5_token_codec, op6_suffix_dedup, op7_language_id, op8_probminhash, op9_packing, op10_quality_rules, pipeline)
}
#: Base32 of the 160 bits of a hexadecimal SHA-1: each five digits are four letters.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = "(strpos('0123456789abcdef', substr(h, 5 * g + {k}, 1)) - 1)"
_NUMBER = " + ".join(f"{16 ** (5 - k)} * {_DIGIT.format(k=k)}" for k in range(1, 6))
_LETTERS = " || ".join(f"substr('{_BASE32}', CAST(((({_NUMBER}) // {32**k}) % 32) + 1 AS BIGINT), 1)" for k in (3, 2, 1, 0))
ORACLE: dict[str, str] = {
    "op1_warc": f"""
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: {_LETTERS}), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
    """
}
