"""A training corpus in five stages, each an operator of lanternfish.llm over all that the one before kept.

1. quality: documents that the boosted trees score under 0.5 go.
2. near_copies: of documents linked by five-word shingles at a similarity of 0.8
   the one with the least doc_id stays (null ones last), of equal doc_ids one, by a
   hash of its text. Documents without words have no copies and stay.
3. repeats: passages of 35 words or more that stand elsewhere as well are cut
   out; what is left of a changed text is joined by single spaces, n_chars follows.
4. mixing: rows are repeated or left out so that sources meet their targets.
5. tokens: ids of each row's text, their number and digests of ids and decoded text.

Stages 1 to 4 return the columns of documents. Empty tables, null and empty texts
go through all of them; each operator's docstring says with what result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import bpe, mixing, ngram_join, quality, queries, substring_dedup
from lanternfish.llm.common import few, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = stored(ngram_join.similar_groups(docs, k=5, num=4, den=5).where("set_id <> 0").select("doc_id", "text_hash", "root"), "near-groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("f"))
    gone = groups.join(first, "root").where(~F.col("f.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("f.text_hash") != F.col("text_hash")))
    gone = few(stored(gone.select("doc_id", "text_hash").distinct(), "near-copies"))
    # Rows that are equal in doc_id and text as well: one of them stays.
    twins = stored(groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"), "twins")
    names = [f"_x{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumns({"_id": F.col(at["doc_id"]).cast("long"), "_hash": F.xxhash64(at["text"])})
    same = lambda keys: F.col("_id").eqNullSafe(keys["doc_id"]) & (F.col("_hash") == keys["text_hash"])
    rows = rows.join(gone, same(gone), "left_anti")
    if not twins.isEmpty():
        twins = few(twins)
        one = rows.join(twins, same(twins), "left_semi").groupBy("_id", "_hash").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
        rows = rows.join(twins, same(twins), "left_anti").select(*names).unionByName(one)
    return rows.select(*(F.col(x).alias(c) for c, x in at.items()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(docs, keep=True)
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, queries.tokenizer_path(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("mixing", mix_sources), ("tokens", tokenize)]
#: The stages' models and hashes are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
