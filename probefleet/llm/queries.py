"""The registered queries of this package, at production parameters, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probefleet.llm.decontaminate import decontamination
from probefleet.llm.jaccard_join import similarity_components
from probefleet.llm.language import language_id
from probefleet.llm.main_text import main_text
from probefleet.llm.oracles import ORACLES
from probefleet.llm.packing import pack_documents
from probefleet.llm.perplexity import quality_classifier
from probefleet.llm.phrases import mine_phrases
from probefleet.llm.quality_rules import quality_rules
from probefleet.llm.ranked_search import ranked_search
from probefleet.llm.secret_scan import secret_digest
from probefleet.llm.substrings import substring_digest
from probefleet.llm.url_filter import judge_urls
from probefleet.llm.warc import archive_pages
from probefleet.llm.workspace import ready, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("bad_probability")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return substring_digest(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return main_text(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return similarity_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return archive_pages(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return mine_phrases(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_packing,
        op3_language_id,
        op4_substrings,
        op5_main_text,
        op6_quality_classifier,
        op7_url_filter,
        op8_decontamination,
        op9_jaccard_join,
        op10_warc,
        op11_collocations,
        op12_secrets,
        op13_ranked_search,
    )
}

__all__ = ["ORACLES", "QUERIES"]
