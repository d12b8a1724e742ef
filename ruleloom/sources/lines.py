"""Line tables: (spec, ln, line) from Markdown files or from any text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What ends a line, as in Python's str.splitlines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Line ends beside the line feed.
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _without_last_empty(parts: Column) -> Column:
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _parts(text: Column) -> Column:
    """The text cut at its line ends. Most texts have line feeds alone, and a search for the others is cheaper than their pattern at every place."""
    others = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in OTHER_ENDS))
    return F.when(others, F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))


def lines_of(df: DataFrame, spec: Column | str, text: Column | str, together: bool = False) -> DataFrame:
    """Lines numbered from 1. An empty last line (after a final line end) is none; a null text has no lines.

    together: the texts are dealt out by spec before they become lines, so that windows over a document's lines need no
    shuffle of their own; one of whole texts is cheaper than one of all lines for each operator."""
    text = F.col(text) if isinstance(text, str) else text
    spec = F.col(spec) if isinstance(spec, str) else spec
    df = df.select(spec.alias("spec"), text.alias("text"))
    if together:
        df = df.repartition("spec")
    df = df.select("spec", _parts(F.col("text")).alias("parts"))
    return df.select("spec", F.posexplode(_without_last_empty(F.col("parts"))).alias("p", "line")).select("spec", (F.col("p") + 1).alias("ln"), "line")


def lines_from_files(spark: SparkSession, path: str, name: str = "file_name") -> DataFrame:
    """Lines of text files of any size; spec is the file's name (or its file_path).

    Files are read in byte ranges. A range's records end at line feeds, which no other UTF-8 character holds, so that a range may begin
    within a character or between carriage return and line feed; other line ends lie inside records. Lines are numbered within their range
    as they come, and a file's ranges, one row each, sum the lines before them: no line is shuffled or sorted. Both
    looks at the files must cut them alike (set spark.sql.files.minPartitionNum where executors come and go); if they don't, it raises.
    A byte order mark is no text."""
    meta = lambda f: F.col(f"_metadata.{f}").alias(f"__{f}")
    records = spark.read.option("lineSep", "\n").text(path).select("value", F.col(f"_metadata.{name}").alias("spec"), meta("file_path"), meta("file_size"), meta("file_block_start"))
    # the line feed at the end is put back, so that a carriage return before it is no line end of its own
    parts = F.split(F.concat("value", F.lit("\n")), LINE_END, -1)
    size = F.octet_length("value").cast("long") + 1
    lines = records.select("spec", "__file_path", "__file_size", "__file_block_start", size.alias("__size"), F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("__p", "line"))
    lines = lines.withColumn("__id", F.monotonically_increasing_id())

    key = ["__file_path", "__file_block_start"]
    record = F.when(F.col("__p") == 0, F.col("__size"))
    ranges = lines.groupBy(*key).agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.max("__file_size").alias("__bytes"), F.sum(record).alias("__read"), F.max_by("line", "__id").alias("__end"), F.max_by("__p", "__id").alias("__at"))
    by = Window.partitionBy("__file_path").orderBy("__file_block_start")
    before = F.coalesce(F.sum(F.col("__last") - F.col("__first") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # without a line feed at the end the file has a byte less than its records; an empty line after another line end is none then
    left = F.col("__bytes") - F.sum("__read").over(Window.partitionBy("__file_path"))
    final = F.lead("__first").over(by).isNull() & left.isin(-1, 2) & (F.col("__end") == "") & (F.col("__at") > 0)
    ranges = ranges.select(*key, "__first", F.col("__last").alias("__until"), before.alias("__before"), F.when(final, F.col("__last")).alias("__none"))
    met = lines.join(ranges, key, "left")
    same = F.coalesce(F.col("__id").between(F.col("__first"), F.col("__until")), F.lit(False))
    ln = F.when(same, F.col("__before") + F.col("__id") - F.col("__first") + 1).otherwise(F.raise_error(F.lit("the files were cut otherwise between two looks at them; set spark.sql.files.minPartitionNum")))
    return met.where(F.coalesce(F.col("__id") != F.col("__none"), F.lit(True))).select("spec", ln.cast("long").alias("ln"), "line")


def paired_lines(raw: DataFrame, other: DataFrame) -> DataFrame:
    """Both texts by spec and line; a line that one of them lacks is null there."""
    return raw.select("spec", "ln", F.col("line").alias("raw")).join(other.select("spec", "ln", F.col("line").alias("other")), ["spec", "ln"], "full")
