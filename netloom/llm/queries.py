"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import chat, decontaminate, fingerprints, htmltext, langid, licenses, neardup, packing, quality, urls

#: The tokenizer file of the packing query, by its name among the installed public ones.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_example(table(spark, sf_dir, "conversations"))))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_license_scan": op3_license_scan,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_fingerprints": op5_fingerprints,
        "op6_html_extraction": op6_html_extraction,
        "op7_language_id": op7_language_id,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_url_filters": op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.SQL, "op10_url_filters": urls.SQL}
