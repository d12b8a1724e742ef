"""Tables cut so that Spark still knows how their rows are dealt out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

_ADAPTIVE = "spark.sql.adaptive.enabled"


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() that keeps the dealing: joins, groups and windows by keys that hold the dealing's (spec, say) need no shuffle of what is cut.

    A checkpoint of an adaptive plan forgets how its rows are dealt, so this one is written by a plan that is none."""
    conf = df.sparkSession.conf
    was = conf.get(_ADAPTIVE)
    conf.set(_ADAPTIVE, "false")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(_ADAPTIVE, was)


def stored(df: DataFrame, by: str = "spec") -> DataFrame:
    """The table written once as compressed Parquet in the checkpoint folder, in buckets, so that it is dealt out by a column when read again.

    As cut(), but smaller on disk, and only the columns that are asked for are read. The name that a bucketed table needs is dropped at once; its files stay."""
    spark = df.sparkSession
    folder, name = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}", f"stored_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(name)
    found = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")
    return found
