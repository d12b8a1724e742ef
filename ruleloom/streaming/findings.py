"""Findings from raw results as they arrive, by the same columns as the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.operators.runs import finding_key, message_text, parsed


def arriving_results(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of raw result lines from a folder."""
    return spark.readStream.schema(schema.RAW_RESULT + ", received timestamp").json(folder)


def arriving_findings(results: DataFrame, groups: DataFrame, late: str = "1 day") -> DataFrame:
    """custom_id, pair, variant, received of valid findings, each variant of a request once within the time for late data.

    groups is static: custom_id, rule_ids."""
    done = results.withWatermark("received", late).where((F.col("result.type") == "succeeded") & (F.col("result.message.stop_reason") == "end_turn")).join(groups, "custom_id")
    got = parsed(message_text(F.col("result")), F.col("rule_ids"))
    found = done.select("custom_id", "received", F.explode(got["findings"]).alias("f")).select("custom_id", "received", finding_key(F.col("f")).alias("key"))
    return found.select("custom_id", "received", F.array_join("key.pair", "|").alias("pair"), F.sha2(F.to_json("key"), 256).alias("variant")).dropDuplicatesWithinWatermark(["custom_id", "pair", "variant"])
