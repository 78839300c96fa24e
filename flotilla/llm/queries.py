"""Registered queries of the operators of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontaminate, langid, licences, line_dedup, minhash, mixing, phrases, pii, tokens, topk, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: rules first, then the calibrated language-model ratio."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op2_attention_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity(docs, labels, folds=5, held_out=0)


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and the terms that disclose them."""
    return pii.digest(pii.protect(table(spark, sf_dir, "documents", "doc_id", "text")))


def op4_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that sit on five sites or more."""
    docs = line_dedup.without_boilerplate(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return docs.select("doc_id", docs["clean_text"].alias("text"), "removed_lines")


def op5_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with whether it overlaps a benchmark item and how many it overlaps."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    flagged = decontaminate.flag_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return flagged.select("doc_id", "contaminated", "n_items")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy-balanced mix of all documents: words taken per document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, Jaccard of at least 85 %."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, percent=85)


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), folds=4, held_out=2)


def op9_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=50, k=5)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the 50k byte-level vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(table(spark, sf_dir, "documents"), path, limit=512)


def op11_filter_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of every order, per language, and its Shapley value."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return audit.filter_audit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices, identifiers and the strictness of their terms, of every document."""
    return licences.licence_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of two or three words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def queries() -> dict[str, Query]:
    return {
        "op1_url_language_ratio": op1_url_language_ratio,
        "op2_attention_gru_toxicity": op2_attention_gru_toxicity,
        "op3_disclosure_pii": op3_disclosure_pii,
        "op4_site_spread_lines": op4_site_spread_lines,
        "op5_spaced_seed_leaks": op5_spaced_seed_leaks,
        "op6_entropy_mix": op6_entropy_mix,
        "op7_circulant_minhash": op7_circulant_minhash,
        "op8_crf_language": op8_crf_language,
        "op9_block_top_k": op9_block_top_k,
        "op10_token_counts": op10_token_counts,
        "op11_filter_potential": op11_filter_potential,
        "op12_licence_scan": op12_licence_scan,
        "op13_phrase_collocations": op13_phrase_collocations,
    }
