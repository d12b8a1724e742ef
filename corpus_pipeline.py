"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import shared_dir
from ruleloom.llm.language_id import fit, identify
from ruleloom.llm.mixing import mixed
from ruleloom.llm.ngram_join import one_of_each_class
from ruleloom.llm.secret_scan import scan_secrets
from ruleloom.llm.sentencepiece_coding import encode_texts

#: Documents whose language is less likely than this are rejected.
LEAST_POSTERIOR = 0.5
#: So are those that are less likely in it than letters drawn evenly from an alphabet of so many.
BACKGROUND_LETTERS = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language or of none that was learnt; a missing lang becomes the
    predicted one."""
    found = identify(docs, fit(docs.select("doc_id", "text", "lang")))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR) & (F.col("per_letter") >= -math.log(BACKGROUND_LETTERS)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class at a Jaccard similarity of 0.8 of word 5-grams, that with the smallest id."""
    return one_of_each_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; no document goes. n_chars follows where a text has changed."""
    found = scan_secrets(docs)
    changed = F.col("n_secrets") > 0
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources have their shares."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    return encode_texts(docs).select("doc_id", "lang", "source", "n_tokens", "round_trip", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL has neither the language model nor the forest; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables between stages lie in the shared folder, each until the one after the next is made."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if old is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        old = f"{folder}/{k}"
    return docs
