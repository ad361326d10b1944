"""The registered queries of the corpus operators, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import (
    digest_index,
    gray_index,
    language,
    licenses,
    lines,
    mixing,
    packing,
    piecewise,
    resampling,
    secrets,
    spelling,
    warc,
    weak_labels,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents")).drop("ids")


def op2_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predicted(docs, language.train(docs))


def op3_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compared_with_next(_table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and a digest of the text that is left."""
    docs = lines.deduplicated(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


def op5_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = gray_index.near_groups(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.scored(_table(spark, sf_dir, "documents"))


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    columns = ("doc_id", "size", "source_size", "target", "taken", "source", "copies")
    return mixing.copies(docs).select(*columns, F.round("rate", 6).alias("rate"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived(_table(spark, sf_dir, "pages"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return captures.select(*columns, "url_key", "timestamp", "range_id", "position")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op10_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digested(licenses.license_notices(_table(spark, sf_dir, "documents")))


def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_batch_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resampling.ranked(docs, target).drop("n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_curve_packing,
        op2_subword_language,
        op3_piecewise_hash,
        op4_fuzzy_lines,
        op5_gray_simhash,
        op6_weak_quality,
        op7_entropy_mix,
        op8_warc_index,
        op9_secret_scan,
        op10_digest_index,
        op11_license_scan,
        op12_permuterm_variants,
        op13_batch_resampling,
    )
}

ORACLE_SQL = {
    "op10_digest_index": digest_index.ORACLE_SQL,
    "op12_permuterm_variants": spelling.ORACLE_SQL,
    "op13_batch_resampling": resampling.ORACLE_SQL,
}
