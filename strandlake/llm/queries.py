"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import table


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandlake.llm.token_binary import token_binary

    return token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_shard_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.shard_pack import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op6_repeat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.repeat_bytes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.vector_join import vector_components

    return vector_components(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.mix_sources import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_binary, op2_license_scan, op3_shard_pack, op4_mix_sources, op5_ngram_join, op6_repeat_bytes, op7_html_text, op8_vector_join, op9_toxicity, op10_decontaminate)}


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [])"

ORACLE = {
    "op5_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT s.doc_id, any_value(len(s.sh)) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
