"""Corpus pipeline: documents in, token ids out.

language ID -> quality -> near duplicates -> benchmark decontamination -> byte-level BPE

Each stage reads what the one before wrote and drops the rows its operator decides against; models
are fitted on the documents a stage is given (labels and benchmark come from their own tables).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.llm import bpe, langid, quality, simhash
from formspark.llm.common import read, shared_folder
from formspark.llm.decontaminate import decontaminate


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the models know; texts they reject go."""
    model = langid.fit(langid.learnable(docs.select("doc_id", "text", "lang")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return langid.identify(rows, model).where("not rejected").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality.score(rows, model).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each_group(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to speak of."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return decontaminate(rows, read(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return coded.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("tokens", tokenise),
]

# The stages are trained models, hashes, an automaton and merges: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
