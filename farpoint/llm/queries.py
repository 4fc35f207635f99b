"""The registered query of each operator, with production settings over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import (
    audit, bpe, decontaminate, extract, jaccard, langid, licenses, linededup, lmscore, packing, quality, search, training_order,
)
from farpoint.llm.steps import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the shards it has written."""
    return training_order.materialise(read_table(spark, sf_dir, "documents"))[0]


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(read_table(spark, sf_dir, "pages"))


def encoded(docs: DataFrame) -> DataFrame:
    """The digests of the ids and of their decoding."""
    import public_tokenizers

    out = bpe.encode_texts(docs, bpe.BpeParams(str(public_tokenizers.path("word_bpe_49k.json"))))
    return out.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    out = decontaminate.decontaminate(docs, benchmark)
    return out.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    out = langid.predict(docs, model, keep=["doc_id", held_out.alias("held_out")])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(langid.remainder("doc_id", 7) == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents")
    return lmscore.lm_score(docs, training=~held_out, keep={"held_out": held_out})


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    params = packing.PackParams(str(files.path("byte_bpe_50k.json")), str(files.path("byte_bpe_50k.tiktoken")), files.PATTERN)
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), params)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_training_order": op2_training_order,
    "op3_html_extraction": op3_html_extraction,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_filter_audit": op11_filter_audit,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_ranked_search": op13_ranked_search,
}
