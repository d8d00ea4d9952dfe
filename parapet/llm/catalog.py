"""Queries opN_<name> over whole tables, and SQL with the same rows where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import sql
from parapet.llm.common import table
from parapet.llm.decontaminate import contamination
from parapet.llm.html_main import extract_pages
from parapet.llm.language import identify_languages
from parapet.llm.licenses import TEMPLATES, THRESHOLD, scan_licenses, template_bigrams
from parapet.llm.line_dedup import line_report
from parapet.llm.minhash import near_duplicates
from parapet.llm.packing import pack_documents
from parapet.llm.periodic import periodic_runs
from parapet.llm.phrases import mine_phrases
from parapet.llm.preferences import preference_rows
from parapet.llm.private_data import personal_report
from parapet.llm.toxicity_chain import score_toxicity
from parapet.llm.vectors import near_vectors


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), percent=80)


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_rows(table(spark, sf_dir, "conversations"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), least=10, longest=3, share=50, top=2000)


def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), looped=True, texts=False)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_report(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    "op1_line_dedup": line_dedup,
    "op2_minhash_dedup": minhash_dedup,
    "op3_language_id": language_id,
    "op4_embedding_dedup": embedding_dedup,
    "op5_toxicity": toxicity,
    "op6_html_extraction": html_extraction,
    "op7_license_scan": license_scan,
    "op8_benchmark_decontamination": benchmark_decontamination,
    "op9_best_fit_packing": best_fit_packing,
    "op10_chat_preferences": chat_preferences,
    "op11_phrase_collocations": phrase_collocations,
    "op12_periodic_runs": periodic_run_detection,
    "op13_personal_data": personal_data,
}
LLM_ORACLE = {
    "op7_license_scan": sql.license_scan(
        [(name, template_bigrams(text)) for name, text in TEMPLATES], THRESHOLD
    ),
    "op8_benchmark_decontamination": sql.DECONTAMINATION,
    "op10_chat_preferences": sql.PREFERENCES,
    "op11_phrase_collocations": sql.PHRASES,
}
