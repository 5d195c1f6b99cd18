"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconaudit.llm import bin_slack, embeddings, fuzzy_lines, mixing, packing, pii, prefix_trie, quality, simhash, spelling, substrings, warc, wavelet
from beaconaudit.llm.common import table


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those that go as similar to an earlier one, and the digest of the text that is left."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fuzzy_lines.dedup_lines(documents)
    return found.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"),
                        F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",").alias("removed_lines"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that start earlier in the corpus."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every document and the verdict on its host."""
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op4_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read back from the wavelet matrix files."""
    return wavelet.round_trip(table(spark, sf_dir, "documents"))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from archives with a dictionary of their own."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component it is in."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of the sources."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base patterns and the spans the model adds."""
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.build(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, the words one edit apart from it and the form it is a variant of."""
    return spelling.group(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences that are full or as long as a power of two."""
    return bin_slack.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fuzzy_lines, op2_bwt_dedup, op3_host_rules, op4_pca_tiles, op5_wavelet_ids, op6_warc_dictionary, op7_simhash_ball, op8_lp_packing, op9_pfair_mixing, op10_semi_markov_pii,
                             op11_prefix_trie, op12_spelling_forms, op13_bin_slack)
}
ORACLES: dict[str, str] = {"op3_host_rules": quality.ORACLE, "op4_pca_tiles": embeddings.ORACLE, "op6_warc_dictionary": warc.ORACLE,
                           "op9_pfair_mixing": mixing.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
                           "op12_spelling_forms": spelling.ORACLE}
