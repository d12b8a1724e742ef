"""A graph of pairs kept up to date: groups whose members changed are drawn anew, and only the files that hold them are replaced.

Pairs follow from members (keys and id): two ids of one group are an edge both ways. When the members change, the edges of all other
groups stay as they are, so that work grows with the changed groups and not with the graph. The stored table is dealt to a fixed number of
parts by group; only parts with a changed group are read, and only those are overwritten, each as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .edges import pairs

#: Changed groups that are sent to all tasks; more are met by a shuffle, and stored edges aren't sorted for that.
FEW_GROUPS = 100_000


def changed_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The groups that gained or lost a member, those that are new or gone too; a member counts once."""
    columns = [*keys, "id"]
    side = lambda df, was, is_: df.select(*columns, F.lit(was).alias("__was"), F.lit(is_).alias("__is"))
    both = side(old, True, False).unionByName(side(new, False, True)).groupBy(*columns).agg(F.max("__was").alias("__was"), F.max("__is").alias("__is"))
    return both.where("__was <> __is").select(*keys).distinct()


def refreshed(edges: DataFrame, new: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst: the edges of other groups, and those of the changed groups by their members now."""
    again = pairs(new.join(groups, keys, "left_semi"), "id", keys).select(*keys, "src", "dst")
    return edges.select(*keys, "src", "dst").join(groups, keys, "left_anti").unionByName(again)


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")


def _dealt(edges: DataFrame, parts: int) -> DataFrame:
    """Edges with `part` dealt out to be written in some four files a task, one a part at least: a part's edges go to its files by their src, so that
    no task takes a hot group, and not to all tasks, each of which would write a file of every part."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(tasks, F.col("part"), F.pmod(F.xxhash64("src"), F.lit(max(1, 4 * tasks // parts))))


def write_graph(members: DataFrame, path: str, keys: list[str], parts: int = 64) -> None:
    """The edges of all groups, in a folder for each part."""
    edges = pairs(members, "id", keys).select(*keys, "src", "dst", part_of(keys, parts))
    _dealt(edges, parts).write.partitionBy("part").parquet(path)


def _files(spark: SparkSession, path: str, part: int) -> set[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()


def update_graph(path: str, old: DataFrame, new: DataFrame, keys: list[str], parts: int = 64) -> list[int]:
    """Brings the stored edges from the old members to the new ones; the parts that were replaced. `parts` as it was written.

    The edges are read and written in one go: Spark writes the parts that it overwrites beside the table, and replaces their folders when all are
    written. A part without edges any more isn't written, so its files are still the old ones then, and it loses its folder."""
    spark = new.sparkSession
    groups = changed_groups(old, new, keys).withColumn("part", part_of(keys, parts)).checkpoint()
    changed = {r["part"]: r["count"] for r in groups.groupBy("part").count().collect()}  # at most `parts`
    touched = sorted(changed)
    if not touched:
        return []
    groups = groups.drop("part").hint("broadcast" if sum(changed.values()) <= FEW_GROUPS else "shuffle_hash")
    before = {part: _files(spark, path, part) for part in touched}
    shape = new.select(*keys, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("part")).schema
    stored = spark.read.schema(shape).parquet(path).where(F.col("part").isin(touched))
    edges = refreshed(stored, new, groups, keys).withColumn("part", part_of(keys, parts))
    _dealt(edges, parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for part, files in before.items():
        if files and files == _files(spark, path, part):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
