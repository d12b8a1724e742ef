"""Helpers that several operators share: checkpoints, size-checked broadcasts, byte-level tokenising."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its rows have been measured to take at most so many bytes.
BROADCAST_BYTES = 24 << 20
#: Bits of the fixed-size map that lets through what may have a partner, where the other side is too large to be broadcast.
MAP_BITS = 1 << 26
#: Bytes of text that a Python worker handles at a time; one longer text is handled alone.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where the session names none and all runs in one process.
    Raises on a cluster without one: other machines wouldn't see a local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut, as a Parquet table: what reads it later reads only the columns that it needs."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows, and about how many bytes they take in memory."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(32) * F.greatest(F.size(f.name), F.lit(0)) if f.dataType.simpleString().startswith("array") else F.lit(0) for f in df.schema.fields]
    row = sum(wide, F.lit(16 + 8 * len(wide)))
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()
    return got["n"], got["b"]


def sized_join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str, size: int | None = None) -> DataFrame:
    """Broadcast right if it has been measured to fit (size: its bytes), else leave a shuffled join to AQE. right should be cut."""
    fits = (measured(right)[1] if size is None else size) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if fits else right.hint("merge"), on, how)


def maybe_in(keys: DataFrame, key: str) -> Callable[[DataFrame, Column], tuple[DataFrame, Column]]:
    """A function that adds to a table whether its key (a long) may be among the given ones: no for most others, never no for one
    of them. What is broadcast is a bit map of MAP_BITS bits, whatever the number of keys."""
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(MAP_BITS)) + 1
    bits = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    bits = cut(bits)

    def mark(df: DataFrame, of: Column) -> tuple[DataFrame, Column]:
        s = F.pmod(F.xxhash64(of, F.lit(5)), F.lit(MAP_BITS)) + 1
        place = F.bitmap_bit_position(s)
        byte = F.conv(F.hex(F.substr(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = df.join(F.broadcast(bits), F.bitmap_bucket_number(s) == F.col("__bucket"), "left")
        return out, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))

    return mark


def matched(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, on: Column, how: str = "inner", size: int | None = None) -> DataFrame:
    """The rows joined (inner or left) with `wanted` (cut; size: its bytes). A side too large for a broadcast is shuffled, and then
    only those of `rows` that the bit map lets through, so that wide rows without a partner stay where they are."""
    if (measured(wanted)[1] if size is None else size) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wanted), on, how)
    some, may = maybe_in(wanted, wanted_key)(rows, key)
    near = some.where(may).drop("__bucket", "__bits").join(wanted.hint("merge"), on, how)
    return near if how == "inner" else near.unionByName(some.where(~may).drop("__bucket", "__bits"), allowMissingColumns=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text; at least one row each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def trimmed(work):
    """A function over batches that gives freed memory back when its task ends: workers live on from task to task, and what
    their allocators keep adds up on an executor."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From sorted batches: tables of whole groups with at least so many rows (all at the end), and where groups begin."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in by:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= max(least, 1):
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins (one more: where the last ends). Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters and all that isn't ASCII.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: `[^\x20\x09-\x0D]+`
TOKEN = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser for uint64 hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a slice of texts as arrays: start and end bytes, the text's first word (`first`, one more at the end), 64-bit hashes."""

    def __init__(self, texts: pa.Array, word: np.ndarray, hashed: bool = True):
        raw, self.offsets = flat_bytes(texts)
        self.data = LOWER[raw]
        n = len(raw)
        isw = word[raw]
        start, end = isw.copy(), isw.copy()
        start[1:] &= ~isw[:-1]
        end[:-1] &= ~isw[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        start[inner] = isw[inner]
        end[inner - 1] = isw[inner - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        if hashed:
            power, inverse = _grown(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def document(self) -> np.ndarray:
        """The number of each word's text in the slice."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row (for the last k-1 words of the array none)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + n] + np.uint64(i + 1))
    return out


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id as text modulo m; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def written_in(df: DataFrame) -> tuple[DataFrame, str]:
    """As written, and the folder, for `removed` once nothing reads it any more."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of the shared folder."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
