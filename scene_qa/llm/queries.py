"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scene_qa.llm import decontaminate, exact_dedup, hilbert, language, lexical_search, mixture, quotation, simhash, substring_dedup, token_count, url_filter, vector_codes, vector_copies
from scene_qa.llm.common import table
from scene_qa.llm.oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]

#: A sentencepiece file whose pieces are the unigram vocabulary; read on the driver only.
VOCABULARY_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"), 16)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), token_count.zipf_vocabulary(VOCABULARY_PATH))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text is judged by a model that was fitted on it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = language.identify(docs, language.cross_fit(docs))
    return judged.select("_row.doc_id", "language", "posterior", "accepted")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all four kinds of evidence are at hand: text, markup, address and host of pages."""
    pages = language.markup_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    judged = language.identify(pages, language.fit(table(spark, sf_dir, "documents")))
    return judged.select("_row._row.page_id", "_row.lang", "language", "posterior", "accepted").withColumnRenamed("lang", "declared")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=3)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=200)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_order(table(spark, sf_dir, "conversations"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), counts=True)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_shards, op2_token_counts, op3_language_fusion, op4_url_filter, op5_simhash, op6_substring_dedup, op7_decontamination, op8_quotation_linking, op9_exact_dedup, op10_mixture, op11_lexical_search, op12_vector_copies, op13_vector_codes, page_language)}
