"""Artifacts in and out: JSON, JSON lines, fragments, text, hashes, and runs in folders. Spark's commit protocol makes writes atomic."""

from __future__ import annotations

import contextlib
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.operators.rules import flattened_fragments


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Whole JSON documents with a declared schema; nothing is inferred."""
    return spark.read.option("multiLine", True).schema(shape).json(path)


def read_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a folder of fragments with file and pos, in the order of names."""
    raw = spark.read.option("multiLine", True).schema(schema.FRAGMENT).json(folder)
    return flattened_fragments(raw.select(F.col("_metadata.file_name").alias("file"), "records", "fragments"))


def read_lines(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(shape).json(path)


def read_optional(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """A JSON document, or an empty table of its schema if there is none."""
    return read_json(spark, path, shape) if exists(spark, path) else spark.createDataFrame([], shape)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """JSON lines in a folder for each value; a whole rewrite leaves nothing stale behind."""
    df.write.mode(mode).partitionBy(*columns).json(path)


def pretty(df: DataFrame, *columns: str) -> DataFrame:
    """value: each row as indented JSON with nulls kept."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_text(df: DataFrame, path: str, value: str = "value", by: str | None = None, mode: str = "overwrite") -> None:
    out = df.select(F.col(value).alias("value"), *([by] if by else [])).write.mode(mode)
    (out.partitionBy(by) if by else out).text(path)


def write_documents(df: DataFrame, path: str, value: str = "value", mode: str = "overwrite") -> None:
    """Many JSON documents, each as it is (indented ones too), in a file for each task: JSON text sequences (RFC 7464), a record separator
    before each document and a line feed after it. JSON escapes the separator within strings."""
    df.select(F.concat(F.lit("\x1e"), F.col(value)).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def read_documents(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """What write_documents() has written, read in byte ranges, with a declared schema; nulls are no documents."""
    return spark.read.option("lineSep", "\x1e").schema(shape).json(path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def inside(root: str, path: str) -> str:
    """The path, if it stays inside the root."""
    full = posixpath.normpath(posixpath.join(root, path))
    if full != posixpath.normpath(root) and not full.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} leaves {root}")
    return full


def escapes(path: Column) -> Column:
    """Whether a path leaves the folder that it is relative to: absolute, or going up more often than down at some point."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    low = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return path.startswith("/") | (low["low"] < 0)


def publish(df: DataFrame, path: str) -> None:
    """Writes a folder that a reader sees whole or not at all; refuses one that has been published.

    A claim on the name, created exclusively, decides between several writers before any of them writes; the data go to a
    folder of their own, which the target file names once they are there. Nothing is renamed, so stores without an atomic
    rename will do. What was claimed but never finished is reported by `published` as missing."""
    spark = df.sparkSession
    staged = f"{path}.data-{uuid.uuid4().hex}"
    if not claim(spark, f"{path}.claim", staged):
        raise FileExistsError(path)
    df.write.json(staged)
    if not claim(spark, path, staged):
        raise FileExistsError(path)


def published(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """What publish() has written, by the folder that the target names."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_lines(spark, spark.read.text(path, wholetext=True).first()["value"], shape)


def replace_json(df: DataFrame, path: str) -> None:
    """Replaces one JSON document (one row) by a new one: written beside it, then renamed over it."""
    spark = df.sparkSession
    value = pretty(df).collect()
    if len(value) != 1:
        raise ValueError("one row makes one document")
    fs, target = _file_system(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    claim(spark, beside, value[0]["value"] + "\n")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target, options)


@contextlib.contextmanager
def locked(spark: SparkSession, folder: str):
    """Holds a run's folder, or raises BlockingIOError at once if another holds it."""
    path = f"{folder.rstrip('/')}/run.lock"
    if not claim(spark, path, uuid.uuid4().hex):
        raise BlockingIOError(f"another runner holds {folder}")
    try:
        yield
    finally:
        fs, p = _file_system(spark, path)
        fs.delete(p, False)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a ledger file once; False if it is there already."""
    fs, p = _file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True
