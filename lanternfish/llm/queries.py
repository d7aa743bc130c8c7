"""The registered queries of these operators: each applies one to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import hard_negatives, line_dedup, mixing, phrases, topk


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.fingerprints import with_edits

    return with_edits(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.ngram_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.common import work_path
    from lanternfish.llm.token_store import checksums, numbered, read_store, write_store

    docs = table(spark, sf_dir, "documents")
    path = work_path(spark, "token-store")
    write_store(docs, path, tokenizer_path())
    return checksums(read_store(spark, path, numbered(docs)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.substring_dedup import remove_repeats

    made = remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"))


QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_bpe": op2_bpe, "op3_quality": op3_quality, "op4_mixing": op4_mixing, "op5_topk": op5_topk, "op6_ngram_join": op6_ngram_join, "op7_toxicity": op7_toxicity, "op8_token_store": op8_token_store, "op9_sharding": op9_sharding, "op10_substring_dedup": op10_substring_dedup, "op11_line_dedup": op11_line_dedup, "op12_phrases": op12_phrases, "op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op4_mixing": mixing.ORACLE, "op5_topk": topk.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op12_phrases": phrases.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
