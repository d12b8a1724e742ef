"""What a run does next: a table of runs in, the step that each takes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ["check-tokens", "submit", "collect", "run"]


def next_steps(runs: DataFrame) -> DataFrame:
    """run, step, problem of runs (run, action, direct, started, submitted, summarized, reprocess).

    Of a run that isn't direct: token counts are only checked, a submission only submitted. Reprocessing needs a summary. `run`
    submits what hasn't been submitted, but not what was started without an outcome on record: that must be reconciled first, as a
    blind retry might pay twice. What is summarized is reprocessed, anything else collected. A direct run submits once and
    collects."""
    action, done = F.col("action"), F.col("summarized")
    unknown = ~F.coalesce(action.isin(*ACTIONS), F.lit(False))
    unresolved = (action == "run") & ~F.col("submitted") & F.col("started") & ~F.col("direct")
    problem = (
        F.when(unknown, "unknown action").when(~F.col("direct") & F.col("reprocess") & action.isin("collect", "run") & ~done, "no completed batch")
        .when(~F.col("reprocess") & unresolved, "submission unresolved").when((action == "submit") & F.col("started"), "submitted already")
    )
    step = (
        F.when(action == "check-tokens", F.array(F.lit("count tokens"))).when(action == "submit", F.array(F.lit("submit")))
        .when(F.col("direct"), F.when((action == "run") & ~F.col("submitted"), F.array(F.lit("submit"), F.lit("collect"))).otherwise(F.array(F.lit("collect"))))
        .when(F.col("reprocess") | done, F.array(F.lit("reprocess"), F.lit("aggregate")))
        .when((action == "run") & ~F.col("submitted"), F.array(F.lit("submit"), F.lit("collect"), F.lit("aggregate")))
        .otherwise(F.array(F.lit("collect"), F.lit("aggregate")))
    )
    return runs.withColumn("problem", problem).select("run", F.when(F.col("problem").isNull(), step).alias("steps"), "problem")
