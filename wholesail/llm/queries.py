"""The registered ``opN_*`` queries: each applies one operator to its whole table and derives the
columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import conversation_trie, exact_dual_tree, mixing, near_cross_polytope, near_order_minhash, pii_feistel, quality_pu, sentencepiece_rounds, target_resampling, token_attribution, token_wavelet, toxicity_chain, url_link_trust
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(table(configure(spark), sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_cross_polytope.links(table(configure(spark), sf_dir, "embeddings"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    return toxicity_chain.score(docs, toxicity_chain.train(docs, table(spark, sf_dir, "labels")))


def op4_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dual_tree.search(table(configure(spark), sf_dir, "embeddings"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_order_minhash.groups(table(configure(spark), sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(configure(spark), sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_rounds.encode(table(configure(spark), sf_dir, "documents"), digest=True)


def op8_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_link_trust.judge(table(configure(spark), sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.attribute(table(configure(spark), sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.train(docs, table(spark, sf_dir, "labels")))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_wavelet.encoded(table(configure(spark), sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(table(configure(spark), sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_dual_tree": op4_dual_tree,
    "op5_order_minhash": op5_order_minhash,
    "op6_source_mix": op6_source_mix,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_url_trust": op8_url_trust,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_target_resampling": op11_target_resampling,
    "op12_token_wavelet": op12_token_wavelet,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE: dict[str, str] = {
    "op4_dual_tree": exact_dual_tree.ORACLE,
    "op6_source_mix": mixing.ORACLE,
    "op8_url_trust": url_link_trust.ORACLE,
    "op11_target_resampling": target_resampling.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
