"""Queries that SQL can't express: steps that follow one another, and searches. Each runs a kernel of operators per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import coding, cutting, generating, page_texts, searching
from glyphmill.operators.pages import alone, types_of
from glyphmill.sources.corpus import frames


def _over(f: Callable[..., DataFrame], *relations: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(**frames(spark, sf_dir, relations))

    return query


def _paged(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, on arrays of whole pages where each row of documents is one."""

    def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = frames(spark, sf_dir, ("documents",))["documents"]
        return page_texts.PAGED[name](docs) if alone(docs) else query(spark, sf_dir)

    return paged


def _bpe_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are counted where pages lie, if each row of documents is one."""
    docs = frames(spark, sf_dir, ("documents",))["documents"]
    types = types_of(docs).groupBy("tok").agg(F.sum("n").alias("n")) if alone(docs) else frames(spark, sf_dir, ("types",))["types"]
    return searching.bpe_curve(types)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bpe_curve": _bpe_curve,
    "t2a_permutations": _over(searching.final_form, "tk"),
    "slot_rigidity": _over(searching.slot_rigidity, "ty"),
    "drift_segmentation": _over(cutting.drift_segmentation, "xs"),
    "drift_shape": _over(cutting.drift_shape, "xs"),
    "line_packing": _over(cutting.line_packing, "tk"),
    "t3b_chunks": _over(searching.chunk_rigidity, "ch", "tk"),
    "compressed_size": _over(coding.compressed_size, "documents"),
    "message_round_trip": _over(coding.message_round_trip, "tk"),
    "markup_edits": _over(coding.markup_edits, "ln"),
    "automaton_text": _over(generating.automaton_text, "tk"),
    "copied_text": _over(generating.copied_text, "tk"),
    "recency_text": _over(generating.recency_text, "tk"),
    "wrapped_text": _over(generating.wrapped_text, "tk"),
    "autokey_text": _over(generating.autokey_text, "ln"),
    "deck_text": _over(generating.deck_text, "ln"),
    "verbose_text": _over(generating.verbose_text, "ln"),
    "grammar_text": _over(generating.grammar_text, "tk"),
    "two_route_text": _over(generating.two_route_text, "tk"),
    "page_mixture_text": _over(generating.page_mixture_text, "tk"),
    "smooth_drift_text": _over(generating.smooth_drift_text, "tk"),
    "step_drift_text": _over(generating.step_drift_text, "tk"),
    "tilted_text": _over(generating.tilted_text, "tk"),
    "walking_text": _over(generating.walking_text, "tk"),
    "tuning_sweep": _over(generating.tuning_sweep, "tk"),
    "twin_residual": _over(generating.twin_residual, "tk"),
    "mixture_shares": _over(searching.mixture_shares, "ty"),
    "substitution_search": _over(searching.substitution_search, "tk"),
    "grid_fit": _over(searching.grid_fit, "ty"),
    "mantel_strata": _over(searching.mantel_pages, "xs", "pg", "embeddings"),
}
QUERIES |= {name: _paged(name, QUERIES[name]) for name in page_texts.PAGED}
