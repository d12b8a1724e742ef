"""A verifier service as tables in a shared folder: batches of requests, and results that something else puts beside them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import schema

from .artifacts import claim, exists, read_lines, write_lines


class TableService:
    """What a client asks of a service, answered from tables. Every answer is a DataFrame; nothing is held here."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, batch: str, requests: DataFrame) -> bool:
        """Files a batch of requests (custom_id, params); False, and nothing is filed, if there is one of that name."""
        if not claim(self.spark, f"{self.folder}/{batch}.submission", batch):
            return False
        write_lines(requests.select("custom_id", "params"), f"{self.folder}/{batch}/requests")
        return True

    def answer(self, batch: str, results: DataFrame) -> None:
        """What the far side does: files results (custom_id, result)."""
        write_lines(results.select("custom_id", "result"), f"{self.folder}/{batch}/results", mode="append")

    def results(self, batch: str) -> DataFrame:
        path = f"{self.folder}/{batch}/results"
        return read_lines(self.spark, path, schema.RAW_RESULT) if exists(self.spark, path) else self.spark.createDataFrame([], schema.RAW_RESULT)

    def status(self, batch: str) -> DataFrame:
        """One row: batch, requests, answered, status (in_progress or ended)."""
        asked = read_lines(self.spark, f"{self.folder}/{batch}/requests", "custom_id string").agg(F.count("*").alias("requests"))
        got = self.results(batch).agg(F.countDistinct("custom_id").alias("answered"))
        ended = F.when(F.col("answered") >= F.col("requests"), "ended").otherwise("in_progress")
        return asked.crossJoin(got).select(F.lit(batch).alias("batch"), "requests", "answered", ended.alias("status"))

    @staticmethod
    def count_tokens(requests: DataFrame, characters: int = 4) -> DataFrame:
        """custom_id, input_tokens of requests (custom_id, prompt): a token for so many characters, rounded up."""
        return requests.select("custom_id", F.ceil(F.length("prompt") / characters).alias("input_tokens"))


def wait(service: TableService, batch: str, seconds: float = 30, most: int = 2880) -> bool:
    """Asks until the batch has ended, `most` times at the most; whether it has."""
    for k in range(most):
        if k:
            time.sleep(min(60, max(5, seconds)) if seconds >= 5 else seconds)
        if service.status(batch).first()["status"] == "ended":
            return True
    return False
