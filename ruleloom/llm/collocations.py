"""Phrases whose words keep together, by language, with exact counts.

1. Words of all texts are counted by (language, word). Those with `least` or more occurrences are the dictionary; no phrase with so many
   occurrences holds another word.
2. Texts become streams of ids, written once: pieces end at punctuation and at every word outside the dictionary. Where the
   dictionary's hashes have been measured to fit a broadcast, an id is a word's place among them (four bytes); beyond that it is the
   hash itself (eight bytes), and a bit map of fixed size breaks the streams at nearly all other words. Both give the same counts.
3. Each task packs runs of n ids into fixed-width binary keys, radix-sorts them by 16-bit digits and counts runs, so that a phrase leaves a
   task a few times at most however often it occurs. Keys are then dealt by range and sorted, and runs are counted once more.
   Two-word phrases come first; three-word keys are packed only where a bit map lets both of their two-word phrases pass.
4. Counts of parts are joined to the phrases (shuffled joins beyond a measured size) and the best of each language are found by
   levels of buckets, so that no task sorts a language whole.

Null and empty texts have no words. A null language is `und`. Repeated documents count each. Texts and words of any length are whole.
Ties: score, then occurrences, then the phrase in byte order. An empty table gives an empty result.

Words are told apart by 64-bit hashes of language and word. Words that share a hash are found when they are counted and
get another one; only two such words within one slice of a task would count as one (a chance of 1e-9 a slice).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Words, byte_class, cut, mix, removed, sized_join, slices, trimmed, written_in

#: `[.,;:!?\x0A-\x0D]` ends a piece; these and blanks end a word.
ENDS = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
WORD = ~(ENDS | byte_class((0x20, 0x20), (0x09, 0x09)))
#: Keys that a task sorts at a time; ids of a stream's row.
RUN, ROW = 1 << 21, 1 << 18
#: Bits of the map of two-word phrases and of frequent words (8 MB whatever their number).
BITS = 1 << 26
#: Rows of a range; rows that a task ranks at a time.
RANGE, RANKED = 1 << 21, 1 << 17
#: The id that stands for a break.
BREAK = {4: np.uint64(0xFFFFFFFF), 8: np.uint64(0xFFFFFFFFFFFFFFFF)}


def hash_of(*parts: str | bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(p.encode() if isinstance(p, str) else p for p in parts), digest_size=8).digest(), "little")


class Dealt:
    """Words of a slice with hashes of language and word; `odd`: sorted hashes that several words share."""

    def __init__(self, batch: pa.RecordBatch, odd: np.ndarray):
        self.words = w = Words(batch.column("text"), WORD)
        self.langs = batch.column("lang").to_pylist()
        codes = {x: mix(np.array([hash_of(x)], np.uint64))[0] for x in set(self.langs)}
        self.document = w.document()
        of = np.array([codes[x] for x in self.langs], np.uint64)
        self.hash = mix(w.hash ^ of[self.document]) if len(w.hash) else w.hash
        self.hash[self.hash == BREAK[8]] -= np.uint64(1)
        for i in np.flatnonzero(np.isin(self.hash, odd)) if len(odd) else ():
            self.hash[i] = other_hash(self.langs[self.document[i]], w.data[w.start[i] : w.end[i]].tobytes())

    def broken(self) -> np.ndarray:
        """Whether each word begins a piece."""
        w = self.words
        ends = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(ENDS[w.data], out=ends[1:])
        at = ends[w.start]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (self.document[1:] != self.document[:-1])
        return new


def other_hash(lang: str, word: bytes) -> int:
    return min(hash_of("other", lang, word), int(BREAK[8]) - 1)


def lower_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(texts: DataFrame) -> tuple[DataFrame, str, np.ndarray]:
    """hash, lang, word, f of every word (written), its folder, and the hashes that several words share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                d = Dealt(part, np.zeros(0, np.uint64))
                h, first, n = np.unique(d.hash, return_index=True, return_counts=True)
                w = d.words
                words = pa.array([w.text(i) for i in first], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([d.langs[d.document[i]] for i in first], pa.string()), words, pa.array(n.astype(np.int64))], ["hash", "lang", "word", "n"])

    found = texts.mapInArrow(trimmed(work), "hash bigint, lang string, word string, n bigint")
    counts, folder = written_in(found.groupBy("hash", "lang", "word").agg(F.sum("n").alias("f")))
    shared = [r["hash"] for r in counts.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash").collect()]  # in all likelihood none
    return counts, folder, np.sort(np.array(shared, np.int64).view(np.uint64))


def with_other_hashes(dictionary: DataFrame, odd: np.ndarray) -> DataFrame:
    if not len(odd):
        return dictionary
    other = F.udf(lambda lang, word: int(np.uint64(other_hash(lang, word.encode())).astype(np.int64)), "bigint")
    return dictionary.withColumn("hash", F.when(F.col("hash").isin([int(x) for x in odd.view(np.int64)]), other("lang", "word")).otherwise(F.col("hash")))


def bit_map(keys: DataFrame, slot: Column) -> np.ndarray:
    """BITS bits as bytes, set at each row's slot (0 to BITS - 1); a fixed size, whatever the rows."""
    at = slot + 1
    rows = keys.select(at.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        begin = (r["bucket"] - 1) * len(part)
        out[begin : begin + len(part)] |= part[: max(0, len(out) - begin)]
    return out


def is_set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def streams(texts: DataFrame, known: np.ndarray | None, bits: np.ndarray | None, odd: np.ndarray) -> DataFrame:
    """ids binary: streams of whole slices with breaks, four bytes an id where `known` holds the dictionary's sorted hashes."""
    size = 4 if known is not None else 8
    sc = texts.sparkSession.sparkContext
    sent = sc.broadcast((known, bits, odd))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, odd = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                d = Dealt(part, odd)
                if known is not None:
                    at = np.searchsorted(known, d.hash)
                    fine = known[np.minimum(at, len(known) - 1)] == d.hash if len(known) else np.zeros(len(at), bool)
                    ids = at.astype(np.uint64)
                else:
                    ids, fine = d.hash, is_set(bits, d.hash % np.uint64(BITS))
                new = d.broken() | ~fine
                new[1:] |= ~fine[:-1]
                # a break before every word that begins a piece; words outside the dictionary go
                place = np.cumsum(new & fine)
                keep = np.flatnonzero(fine)
                out = np.full(len(keep) + (place[-1] if len(place) else 0), BREAK[size], np.uint64)
                out[np.arange(len(keep)) + place[keep]] = ids[keep]
                raw = out.astype(f"<u{size}").tobytes()
                if raw:
                    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["ids"])

    return texts.mapInArrow(trimmed(work), "ids binary")


def packed(ids: np.ndarray, n: int, size: int) -> np.ndarray:
    """All runs of n ids without a break, as rows of big-endian bytes."""
    m = max(0, len(ids) - n + 1)
    fine = np.ones(m, bool)
    for i in range(n):
        fine &= ids[i : i + m] != BREAK[size]
    at = np.flatnonzero(fine)
    keys = np.empty((len(at), n, size), np.uint8)
    for i in range(n):
        keys[:, i] = ids[at + i].astype(f">u{size}").view(np.uint8).reshape(-1, size)
    return keys.reshape(len(at), n * size)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, digit by digit of 16 bits from the last; digits that are all equal are passed over."""
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16).T
    order = None
    for digit in digits[::-1]:
        if len(digit) and (digit != digit[0]).any():
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys)) if order is None else order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
    return keys[new], np.add.reduceat(counts, new)


def as_binary(keys: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(keys) + 1) * keys.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])


def as_keys(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint8)


def pair_slots(keys: np.ndarray) -> np.ndarray:
    """Slots of two-word keys in the bit map."""
    out = np.zeros(len(keys), np.uint64)
    for i in range(0, keys.shape[1], 4):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + np.ascontiguousarray(keys[:, i : i + 4]).view(">u4")[:, 0].astype(np.uint64) + np.uint64(1))
    return out % np.uint64(BITS)


def slots(two: DataFrame, size: int) -> DataFrame:
    """slot of each two-word phrase in the bit map."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_slots(as_keys(batch.column("key"), 2 * size)).view(np.int64))], ["slot"])

    return two.mapInArrow(trimmed(work), "slot bigint")


def runs(held: DataFrame, n: int, size: int, pairs: np.ndarray | None) -> DataFrame:
    """key, n: each task's phrases of n words, RUN keys sorted and counted at a time. pairs: the map that both two-word parts of a
    three-word phrase must pass."""
    sent = held.sparkSession.sparkContext.broadcast(pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, waiting, rows = sent.value, [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(waiting)
            keys, count = run_lengths(keys[radix_order(keys)], np.ones(len(keys), np.int64))
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([as_binary(keys[i : i + (1 << 16)]), pa.array(count[i : i + (1 << 16)])], ["key", "n"])

        for batch in batches:
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), f"<u{size}").astype(np.uint64)
                for i in range(0, len(ids), ROW):
                    keys = packed(ids[i : i + ROW + n - 1], n, size)
                    if pairs is not None and len(keys):
                        keys = keys[is_set(pairs, pair_slots(keys[:, : 2 * size])) & is_set(pairs, pair_slots(keys[:, size:]))]
                    waiting.append(keys)
                    rows += len(keys)
                    if rows >= RUN:
                        yield from counted()
                        waiting, rows = [], 0
        if rows:
            yield from counted()

    return held.mapInArrow(trimmed(work), "key binary, n bigint")


def phrases(held: DataFrame, n: int, size: int, least: int, pairs: np.ndarray | None = None) -> tuple[DataFrame, str]:
    """key, a: phrases of n words with at least so many occurrences (written), and the folder."""
    width = n * size
    rows, folder = written_in(runs(held, n, size, pairs))
    many = rows.count()
    spark = held.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // RANGE))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sum_ = None, 0

        def kept(keys: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            fine = count >= least
            return pa.RecordBatch.from_arrays([as_binary(keys[fine]), pa.array(count[fine])], ["key", "a"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, count = run_lengths(as_keys(batch.column("key"), width), batch.column("n").to_numpy())
            count = count.copy()
            if last is not None and (keys[0] == last[0]).all():
                count[0] += sum_
            elif last is not None:
                yield kept(last, np.array([sum_], np.int64))
            last, sum_ = keys[-1:].copy(), int(count[-1])
            yield kept(keys[:-1], count[:-1])
        if last is not None:
            yield kept(last, np.array([sum_], np.int64))

    out = written_in(rows.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(trimmed(work), "key binary, a bigint"))
    removed(spark, folder)
    return out


def hashes(found: DataFrame, n: int, size: int, known: np.ndarray | None) -> DataFrame:
    """h0, h1, ..., a: the words' hashes in place of keys."""
    sent = found.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids = np.ascontiguousarray(as_keys(batch.column("key"), n * size)).view(f">u{size}")
            h = known[ids] if known is not None else ids.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(h[:, i]).view(np.int64)) for i in range(n)), batch.column("a")], [*(f"h{i}" for i in range(n)), "a"])

    return found.mapInArrow(trimmed(work), ", ".join([*(f"h{i} bigint" for i in range(n)), "a bigint"]))


def cohesion(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact in 38 digits for counts below 10**15; at most 1,000,000 as a is neither above l nor above r."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right)).cast("long")


def best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """Each group's first k rows with their rank. Buckets of about RANKED rows keep their first k, until buckets are few."""
    n = rows.count()
    while n > RANKED:
        buckets = -(-n // RANKED)
        w = Window.partitionBy(by, "bucket").orderBy(*order)
        rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("bucket", "rank"))
        m = rows.count()
        if m > 0.7 * n:  # nearly all rows are among some group's first k
            break
        n = m
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def collocations(documents: DataFrame, least: int = 10, most: int = 2000, inside: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `most` phrases of two and three words.

    a: occurrences; n: the language's words; l and r: occurrences of the two parts of the cut with the lowest score (ties: the
    earlier cut). A phrase goes that lies within a longer one of at least `inside` percent of its occurrences."""
    spark = documents.sparkSession
    texts = lower_texts(documents)
    counts, counts_at, odd = word_counts(texts)
    all_words = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    dictionary, dictionary_at = written_in(with_other_hashes(counts.where(F.col("f") >= least), odd))
    if 8 * dictionary.count() <= common.BROADCAST_BYTES:
        known, bits, size = np.sort(dictionary.select("hash").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)), None, 4
    else:
        known, bits, size = None, bit_map(dictionary, F.pmod("hash", F.lit(BITS))), 8
    held, held_at = written_in(streams(texts, known, bits, odd))
    two, two_at = phrases(held, 2, size, least)
    pairs = bit_map(slots(two, size), F.col("slot"))
    three, three_at = phrases(held, 3, size, least, pairs)

    words = lambda i: dictionary.select(F.col("hash").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 0 else []))
    b = cut(sized_join(sized_join(hashes(two, 2, size, known), words(0), ["h0"], "inner"), words(1), ["h1"], "inner"))
    t = hashes(three, 3, size, known)
    first = b.select("h0", "h1", "lang", "w0", "w1", "f0", F.col("a").alias("a01"))
    rest = b.select(F.col("h0").alias("h1"), F.col("h1").alias("h2"), F.col("w1").alias("w2"), F.col("f1").alias("f2"), F.col("a").alias("a12"))
    t = cut(sized_join(sized_join(t, first, ["h0", "h1"], "inner"), rest, ["h1", "h2"], "inner"))

    over = t.select("h0", "h1", "a").union(t.select("h1", "h2", "a")).groupBy("h0", "h1").agg(F.max("a").alias("longer"))
    alone = b.join(over, ["h0", "h1"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    out2 = alone.select("lang", F.concat_ws(" ", "w0", "w1").alias("phrase"), "a", F.col("f0").alias("l"), F.col("f1").alias("r"), cohesion(F.col("a"), F.col("f0"), F.col("f1")).alias("score"))
    one, other = cohesion(F.col("a"), F.col("f0"), F.col("a12")), cohesion(F.col("a"), F.col("a01"), F.col("f2"))
    t = t.withColumn("one", one).withColumn("other", other)
    early = F.col("one") <= F.col("other")
    out3 = t.select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "a", F.when(early, F.col("f0")).otherwise(F.col("a01")).alias("l"), F.when(early, F.col("a12")).otherwise(F.col("f2")).alias("r"), F.least("one", "other").alias("score"))
    found = cut(out2.union(out3))
    ranked = best(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    out = cut(sized_join(ranked, all_words, ["lang"], "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    removed(spark, counts_at, dictionary_at, held_at, two_at, three_at)
    return out
