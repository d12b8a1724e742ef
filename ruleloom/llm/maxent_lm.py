"""Hashed maximum-entropy language model with class-factored softmax.

p(w | h) = p(class of w | h) * p(w | class, h). Both factors are softmaxes over hashed features of the history: the previous word
(2-gram), the one before it (skip) and the two together (3-gram), beside the class's or word's own frequency. Classes follow
from counts: the most frequent words and the end of text are dealt in the order of their counts, SLOTS to a class; all other
words are the last class, whose slots are groups of words by their first two bytes and whether they end in punctuation. Within
a group a word has its relative frequency with one added count as in the unigram base, (c + 1) / (N + V + 1), so that every
word has a probability, known or not.

Training goes over all training texts, dealt to rounds by a hash of the id. The first round counts: features and outcomes that
met give the weights that iterative scaling starts with. Each later round is a synchronous gradient update: under the weights so
far all tasks sum what is expected and what was seen by weight row, in whole numbers, so that the sums don't depend on how the
texts lie, and the difference over its curvature is the step.

Counts cover all training texts and are keyed by 64-bit hashes of the words. The counts of frequent words (a fixed number
of them) go to every worker; the rest is joined by word, where no key is frequent any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, Words, crc_mod, cut, mix, slices, trimmed

#: Classes; slots of a class. The last class is that of all words that have no slot of their own.
CLASSES, SLOTS = 16, 16
REST = CLASSES - 1
#: Weight rows of the class factor for each unit of the cube root of the training tokens, at every size; the word factor has twice
#: as many. 80 give 34,000 rows for 75 million tokens (0.5 GB), 130,000 for 30 GB and 2 million for 100 TB.
ROWS_PER_ROOT = 80
FEATURES = 3
#: Rounds of training, the first of which only counts.
ROUNDS = 3
#: The most words whose counts are sent to every worker (16 bytes each).
HOT_WORDS = 1 << 18
#: Tokens of a batch; fixed-point unit of expected counts; what a row's own evidence is weighed against.
BATCH, UNIT, PRIOR = 1 << 16, 1 << 20, 10.0
END = np.uint64(0x45)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*b".,;:!?\"')]}"]] = True


def with_ends(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of all tokens with an end after each text, and where each text begins."""
    n = len(w.counts)
    first = w.data[w.start].astype(np.uint64)
    second = np.where(w.end - w.start > 1, w.data[np.minimum(w.start + 1, len(w.data) - 1)] if len(w.data) else 0, 0).astype(np.uint64)
    last = _PUNCTUATION[w.data[w.end - 1]].astype(np.uint64)
    kind = (mix(first * np.uint64(512) + second * np.uint64(2) + last) % np.uint64(SLOTS)).astype(np.int8)
    at = np.arange(len(w.hash)) + w.document()
    h = np.full(len(w.hash) + n, END, np.uint64)
    c = np.zeros(len(h), np.int8)
    h[at], c[at] = w.hash, kind
    return h, c, w.first + np.arange(n + 1)


def features(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of each token's history; before a text's begin there are ends."""
    n = len(h)
    back = np.full((2, n), END, np.uint64)
    back[0, 1:], back[1, 2:] = h[:-1], h[:-2]
    place = np.arange(n) - np.repeat(begin[:-1], np.diff(begin))
    back[0, place < 1] = END
    back[1, place < 2] = END
    return np.stack([mix(x ^ s) for x, s in zip((back[0], back[1], back[0] * np.uint64(31) + back[1]), _SALTS, strict=True)])


@dataclass
class Model:
    """frequent: sorted hashes of the words with a slot, and their counts, classes and slots. Priors are logarithms of the frequencies of
    classes (CLASSES) and slots (CLASSES x SLOTS); weights are rows of the two factors. words and tokens: those of each group."""

    frequent: np.ndarray
    count: np.ndarray
    of_class: np.ndarray
    of_slot: np.ndarray
    class_prior: np.ndarray
    slot_prior: np.ndarray
    class_weights: np.ndarray
    slot_weights: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def outcomes(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and slot of each token, and its place among the frequent words (-1: none)."""
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        known = self.frequent[at] == h
        return np.where(known, self.of_class[at], REST), np.where(known, self.of_slot[at], kind), np.where(known, at, -1)

    def token_logs(self, h: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; for words of the last class without log10(count + 1), for the others less that: what
        is to be added to the base's counts."""
        f = features(h, begin)
        y, s, at = self.outcomes(h, kind)
        out = np.empty(len(h))
        for i in range(0, len(h), BATCH):
            o = slice(i, i + BATCH)
            a, b = self.log_probabilities(self.rows(f[:, o], y[o]), y[o])
            t = np.arange(len(a))
            out[o] = (a[t, y[o]].astype(np.float64) + b[t, s[o]]) / np.log(10)
        rest = at < 0
        out[rest] -= np.log10(self.tokens + self.words + 1)[s[rest]]
        out[~rest] -= np.log10(self.count[at[~rest]] + 1)
        return out

    def rows(self, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight rows of the class factor, and of the word factor, where each class has its own."""
        n, m = len(self.class_weights), len(self.slot_weights) // CLASSES
        return (f % np.uint64(n)).astype(np.int64), ((f >> np.uint64(20)) % np.uint64(m)).astype(np.int64) + m * y

    def log_probabilities(self, rows: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of all classes, and of all slots of the token's class."""
        return log_softmax(self.class_weights, rows[0], self.class_prior), log_softmax(self.slot_weights, rows[1], self.slot_prior[y])


def log_softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += prior
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def word_counts(documents: DataFrame) -> DataFrame:
    """hash, kind, count of every token of the texts, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def merged():
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, c, n = h[order], c[order], n[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return h[at], c[at], np.add.reduceat(n, at)

        def out(x):
            for i in range(0, len(x[0]), 1 << 17):
                yield pa.record_batch({"h": x[0][i : i + (1 << 17)].view(np.int64), "kind": x[1][i : i + (1 << 17)], "c": x[2][i : i + (1 << 17)]})

        for batch in batches:
            for part in slices(batch, "text"):
                h, c, _ = with_ends(Words(part.column("text"), TOKEN))
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, c[at], n))
                if sum(len(x[0]) for x in held) > 1 << 21:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 20:
                        yield from out(held.pop())
        if held:
            yield from out(merged())

    return documents.select("text").mapInArrow(trimmed(count), "h long, kind byte, c long").groupBy("h").agg(F.max("kind").alias("kind"), F.sum("c").alias("c"))


def dealt(documents: DataFrame, rounds: int) -> DataFrame:
    """text and round: the texts of a round are those whose id hashes to it, so that all have their turn."""
    return documents.select("text", F.pmod(F.xxhash64(F.lit("round"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(rounds)).alias("round"))


def sums_by_row(model: Model, texts: DataFrame, expected: bool) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For the class and the word factor: how often each outcome was seen with each weight row, and how often it is expected under
    the model (nothing if not `expected`), in units of 1 / UNIT. Sums of whole numbers; a task returns its rows once. The tasks are
    twice as many as the cluster runs at a time, so what they return grows with it and not with the texts."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    shapes = (model.class_weights.shape, model.slot_weights.shape)
    columns = [f"s{i}" for i in range(CLASSES)] + ([f"e{i}" for i in range(CLASSES)] if expected else [])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen = [np.zeros(n * k, np.int64) for n, k in shapes]
        means = [np.zeros((k, n)) for n, k in shapes] if expected else []
        for batch in batches:
            for part in slices(batch, "text"):
                h, kind, begin = with_ends(Words(part.column("text"), TOKEN))
                f = features(h, begin)
                y, s, _ = model.outcomes(h, kind)
                for i in range(0, len(h), BATCH):
                    o = slice(i, i + BATCH)
                    rows = model.rows(f[:, o], y[o])
                    for j, outcome in enumerate((y[o], s[o])):
                        seen[j] += np.bincount((rows[j] * shapes[j][1] + outcome).ravel(), minlength=len(seen[j]))
                    for j, log in enumerate(model.log_probabilities(rows, y[o]) if expected else ()):
                        p = np.rint(np.exp(log).astype(np.float64) * UNIT)
                        for c in range(shapes[j][1]):
                            weight = np.tile(p[:, c], FEATURES)
                            means[j][c] += np.bincount(rows[j].ravel(), weight, shapes[j][0])
        for j, (n, k) in enumerate(shapes):
            got = seen[j].reshape(n, k)
            at = np.flatnonzero(got.any(1))
            for i in range(0, len(at), 4096):
                r = at[i : i + 4096]
                values = [got[r, c] for c in range(k)] + [means[j][c, r].astype(np.int64) for c in range(k) if expected]
                yield pa.record_batch([pa.array(r + j * shapes[0][0]), *map(pa.array, values)], ["row", *columns])

    tasks = 2 * spark.sparkContext.defaultParallelism
    told = texts.select("text").coalesce(tasks).mapInArrow(trimmed(learn), "row long, " + ", ".join(f"{c} long" for c in columns))
    got = told.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("row")
    sent.unpersist()
    out = []
    row = got["row"].to_numpy(np.int64)
    for j, (n, k) in enumerate(shapes):
        mine = (row >= j * shapes[0][0]) & (row < j * shapes[0][0] + n)
        sums = [np.zeros((n, k)), np.zeros((n, k))]
        for x, names in zip(sums, (columns[:k], columns[k:]), strict=True):
            if names:
                x[row[mine] - j * shapes[0][0]] = got.loc[mine, names].to_numpy(np.float64)
        out.append((sums[0], sums[1] / UNIT))
    return tuple(out)


def start(counts: DataFrame, n: int) -> Model:
    """A model without weights: classes, slots and their frequencies from the counts."""
    top = counts.where(F.col("h") != int(END)).orderBy(F.desc("c"), "h").limit(REST * SLOTS - 1).select("h", "c").collect()
    ends = counts.where(F.col("h") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = sorted([(int(END), ends), *((r["h"], r["c"]) for r in top)], key=lambda x: (-x[1], x[0]))
    h = np.array([x for x, _ in words], np.int64).view(np.uint64)
    c = np.array([x for _, x in words], np.float64)
    place = np.arange(len(words))
    slots = np.zeros((CLASSES, SLOTS))
    slots[place // SLOTS, place % SLOTS] = c
    tokens, kinds = np.zeros(SLOTS), np.zeros(SLOTS)
    spark = counts.sparkSession
    known = F.broadcast(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"))
    for r in counts.join(known, "h", "left_anti").groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["kind"]], kinds[r["kind"]] = r["n"], r["v"]
    slots[REST] = tokens
    of_class = slots.sum(1)
    order = np.argsort(h)
    rows = CLASSES * max(1, round(ROWS_PER_ROOT * n ** (1 / 3) / CLASSES))
    return Model(
        h[order], c[order], (place // SLOTS)[order], (place % SLOTS)[order],
        np.log((of_class + 1) / (of_class.sum() + CLASSES)).astype(np.float32), np.log((slots + 1) / (of_class[:, None] + SLOTS)).astype(np.float32),
        np.zeros((rows, CLASSES), np.float32), np.zeros((2 * rows, SLOTS), np.float32), tokens, kinds,
    )


def train(documents: DataFrame, counts: DataFrame, n: int, rounds: int = ROUNDS) -> Model:
    """The model of (doc_id, text) with the counts of their n tokens. Each text is learnt from in one of the rounds."""
    model = start(counts, n)
    priors = np.exp(model.class_prior.astype(np.float64))[None, :], np.repeat(np.exp(model.slot_prior.astype(np.float64)), len(model.slot_weights) // CLASSES, 0)
    texts = dealt(documents, rounds)
    for k in range(rounds):
        sums = sums_by_row(model, texts.where(F.col("round") == k), expected=k > 0)
        for weights, prior, (seen, mean) in zip((model.class_weights, model.slot_weights), priors, sums, strict=True):
            times = seen.sum(1, keepdims=True)
            if k == 0:
                weights += (np.log((seen + PRIOR * prior) / ((times + PRIOR) * prior)) / FEATURES).astype(np.float32)
            else:
                curve = mean * (1 - mean / np.maximum(times, 1)) + PRIOR * prior
                weights += np.clip((seen - mean) / (FEATURES * curve), -1, 1).astype(np.float32)
    return model


def lm_scores(documents: DataFrame, held_out: tuple[int, int] = (7, 2), rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Texts whose id has the held-out remainder (crc32 of the id as text; a null id counts as '') aren't learnt from. A null or
    empty text has its end alone. Rows with equal ids are scored each on its own. Without training texts every count is 0 and
    train_tokens is 0. What is sent to workers grows with the cube root of the input (three times the weight rows, of 16 floats each), beside HOT_WORDS counts.
    Rerunning gives the same weights, however the rows are dealt out.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", (crc_mod("doc_id", held_out[0]) == held_out[1]).alias("held_out"))
    train_ = docs.where(~F.col("held_out"))
    counts = cut(word_counts(train_))
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = all_["n"], all_["v"]
    # the least count of a hot word, from a histogram in steps of an eighth of an octave: the step's bounds are counts
    stepped = F.floor(F.log2("c") * 8).cast("int")
    least, hot_words = 1 << 62, 0
    for r in sorted(counts.groupBy(stepped.alias("s")).agg(F.min("c").alias("c"), F.count("*").alias("n")).collect(), key=lambda r: -r["s"]):
        hot_words += r["n"]
        if hot_words > HOT_WORDS:
            break
        least = r["c"]
    hot = counts.where(F.col("c") >= least).select("h", "c").toPandas().sort_values("h")
    model = train(train_, counts, n, rounds)
    sent = spark.sparkContext.broadcast((model, hot["h"].to_numpy(np.int64), hot["c"].to_numpy(np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot_h, hot_c = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                h, group, begin = with_ends(Words(part.column("text"), TOKEN))
                factors = model.token_logs(h, group, begin)
                size = np.diff(begin)
                doc = np.repeat(np.arange(len(size)), size)
                signed = h.view(np.int64)
                at = np.minimum(np.searchsorted(hot_h, signed), max(0, len(hot_h) - 1))
                known = hot_h[at] == signed if len(hot_h) else np.zeros(len(h), bool)
                logs = np.where(known, np.log10(hot_c[at] + 1.0), 0.0) if len(hot_h) else np.zeros(len(h))
                key = part.column("key").to_numpy()
                n = len(size)
                yield pa.record_batch(
                    [part.column("key"), pa.array(key * 2, pa.int64()), pa.nulls(n, pa.int64()), part.column("doc_id"), part.column("held_out"), pa.array(size, pa.int64()), pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(np.bincount(doc, logs, n)), pa.array(np.bincount(doc, factors, n))],
                    names,
                )
                # words without a hot count, once for each text
                order = np.lexsort((signed[~known], doc[~known]))
                d, s = doc[~known][order], signed[~known][order]
                at = np.flatnonzero(np.r_[len(d) > 0, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]) if len(d) else np.zeros(0, int)
                m = len(at)
                tf = np.diff(np.r_[at, len(d)])
                for i in range(0, m, 1 << 16):
                    o = slice(i, i + (1 << 16))
                    k = len(at[o])
                    yield pa.record_batch([pa.array(key[d[at[o]]]), pa.array(s[at[o]]), pa.array(tf[o], pa.int64()), pa.nulls(k, kind), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], names)

    names = ["key", "h", "tf", "doc_id", "held_out", "size", "known", "logs", "model"]
    of_id = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(of_id)
    rows = docs.withColumn("key", F.monotonically_increasing_id()).mapInArrow(trimmed(score), f"key long, h long, tf long, doc_id {of_id.simpleString()}, held_out boolean, size long, known long, logs double, model double")
    # a text's own row has a spread-out h and no tf, and so joins no count
    cold = counts.where(F.col("c") < least).select(F.col("h").alias("h2"), "c")
    joined = rows.join(cold, (F.col("h") == F.col("h2")) & F.col("tf").isNotNull(), "left")
    base = F.sum("logs") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf") * F.log10(F.col("c") + 1.0)).otherwise(0.0))
    out = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("size").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("b"), F.sum("model").alias("m"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("b") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("b") + F.col("m")).alias("score"))
