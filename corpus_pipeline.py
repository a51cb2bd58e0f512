"""A training corpus from raw documents, in five stages that each work on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import bpe, langid, minhash, rlbwt, winnow
from mnemo.llm._io import materialize, spare


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    part = langid.fold("doc_id", 5)
    lists = langid.train(docs.filter(part != 0), "lang", "text", F.xxhash64("doc_id"))
    found = langid.predict(docs, lists, out=("__lang_pred", "__lang_score"))
    return found.filter(F.col("__lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; n_chars follows the text."""
    found = rlbwt.remove_repeats(docs, as_text=True, out=("__bytes", "__removed", "__kept"))
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("__kept")), "n_chars": F.when(F.size("__removed") > 0, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of ten words with the benchmark; rows are told apart by id and text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, at, mark = spare(docs, "__own", "__at", "__mark")
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias(own), "text")
    hit = winnow.contamination(keyed, items, own).filter("n_hit > 0").select(F.col("id.id").alias(at), F.col("id.hash").alias(mark))
    hit = materialize(hit.distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[at]) & (F.xxhash64(docs["text"]) == hit[mark]), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("benchmark", decontaminate),
    ("encode", encode),
]

#: Language ranks, repeated byte strings and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
