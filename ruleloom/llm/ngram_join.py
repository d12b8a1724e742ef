"""N-gram Jaccard join by chosen paths.

A text is the set of its word 5-grams, embedded as T minhashes: two sets agree in a minhash with the probability of their
similarity. A run is a recursion: at each node a hash of the node's path chooses some of the T places (about 1 / similarity
of them, one at least), and a set goes down to the child that its minhash at a chosen place names. A child with few sets is a
bucket, whose sets are compared; one with more is a node again. Runs are repeated: as many as the target recall asks for
where buckets are small at once, and more for the sets in large ones, whose partners must stay with them on every level. What
is still large at the last level is compared block by block, so that none is dropped or cut.

Equal sets are one before that. In a bucket sketches (a byte of each minhash) sort out pairs far below the similarity, and
two sets that are already in one class aren't compared again; so a large group of copies costs a forest, not its pairs. What
is left gives the candidate classes, of which each text is read once more and every pair is decided exactly. A class of one
block is compared there. In a larger one each set becomes its difference from the class's centre: sets that are close enough to it
are linked to each other without a comparison and counted by two sums, and only differences meet for the others. Links are
counted and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, cut, groups_of, matched, measured, mix, rolled, sized_join, slices, trimmed, written
from .components import components, forest

K = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Minhashes of a set.
T = 64
#: Sets that are compared directly in a bucket; of a block of a bucket that stays too large at level LEVELS.
BUCKET, WIDE = 512, 512
LEVELS = 3
#: Sets, and shingles of them, in a block of exact comparison, about; sets whose differences from a centre make a strip.
BLOCK, SHINGLES, STRIP = 1024, 1 << 22, 1 << 14


def survival(levels: int, p: float, similarity: float) -> float:
    """How probable it is that two sets which agree in a minhash with probability p are together after so many levels of a run."""
    choose = 1 / (similarity * T)
    places = [math.comb(T, c) * choose**c * (1 - choose) ** (T - c) for c in range(T + 1)]
    places[1] += places[0]
    stay = 1.0
    for _ in range(levels):
        stay = 1 - sum(places[c] * (1 - p * stay) ** c for c in range(1, T + 1))
    return stay


def runs_for(recall: float, levels: int, similarity: float = SIMILARITY) -> int:
    """Runs that reach the recall for two sets at the similarity that must meet on so many levels. Their minhashes are taken to
    agree less often than the similarity says, by two standard deviations."""
    p = similarity - 2 * math.sqrt(similarity * (1 - similarity) / T)
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels, p, similarity)))


def shingle_sets(w: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, and how many each has. Fewer than k words are one shingle."""
    grams = rolled(w.hash, k)
    out = []
    for at, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if n >= k:
            g = np.sort(grams[at : at + n - k + 1])
            out.append(g[np.r_[True, g[1:] != g[:-1]]] if len(g) > 1 else g)
        else:
            out.append(rolled(w.hash[at : at + n], n) if n else w.hash[:0])
    return np.concatenate(out) if out else w.hash[:0], np.fromiter(map(len, out), np.int64, len(out))


_MULTIPLY = mix(np.arange(1, T + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, T + 1001, dtype=np.uint64))
_PLACE = mix(np.arange(2001, T + 2001, dtype=np.uint64))


def minhashes(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """T minhashes of 32 bits for each set; zeros for an empty one."""
    out = np.zeros((len(sizes), T), np.uint32)
    some = sizes > 0
    if some.any():
        at = (np.cumsum(sizes) - sizes)[some]
        for i in range(T):
            least = np.minimum.reduceat(tokens * _MULTIPLY[i] + _ADD[i], at)
            out[some, i] = mix(least + np.uint64(i)) >> np.uint64(32)
    return out


def chosen(paths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places that each node chooses, as (node, place): each with probability 1 / (similarity T), but one at least."""
    h = mix(paths[:, None] ^ _PLACE[None, :])
    pick = h < np.uint64(2.0**64 / (similarity * T))
    none = np.flatnonzero(~pick.any(1))
    pick[none, h[none].argmin(1)] = True
    return np.nonzero(pick)


def roots(runs: range, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places that the runs choose at their roots, and the path of each. No place comes twice before all have been chosen."""
    seeds = mix(np.arange(1, runs.stop + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    run, _ = chosen(seeds, similarity)
    place = np.argsort(_PLACE)[np.arange(len(run)) % T]
    path = mix(seeds[run] + np.arange(len(run), dtype=np.uint64))
    return place[run >= runs.start], path[run >= runs.start]


def children(path: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path + value.astype(np.uint64)).view(np.int64)


def _fixed(x: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    rows, width = len(x), x.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _rows(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def signatures(documents: DataFrame, similarity: float, runs: int) -> DataFrame:
    """row, doc_id, text_hash, n (shingles), h1, h2 (of the set), minhashes, sketch and the keys of the runs' first level."""
    place, path = roots(range(runs), similarity)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                tokens, n = shingle_sets(Words(part.column("text"), WORD))
                rows, some = len(n), n > 0
                h = np.zeros((2, rows), np.uint64)
                for i in (0, 1):
                    if some.any():
                        h[i, some] = np.add.reduceat(mix(tokens + np.uint64(i + 1)), (np.cumsum(n) - n)[some])
                mins = minhashes(tokens, n)
                keys = children(path[None, :], mins[:, place])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                sketch = (mins & np.uint32(255)).astype(np.uint8)
                yield pa.record_batch([*(part.column(c) for c in ("row", "doc_id", "text_hash")), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), _fixed(mins), _fixed(sketch), keys], names)

    names = ["row", "doc_id", "text_hash", "n", "h1", "h2", "minhashes", "sketch", "keys"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(trimmed(sign), f"row long, doc_id {kind}, text_hash long, n long, h1 long, h2 long, minhashes binary, sketch binary, keys array<long>")


_LEVEL = "row long, label long, key long, n long, sketch binary"


def _level(rows: pa.RecordBatch, mins: np.ndarray, of: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows of a level: of says which of the rows (row, label, n) with these minhashes each of the keys belongs to."""
    take, sketch = pa.array(of), (mins & np.uint32(255)).astype(np.uint8)
    return pa.record_batch([rows.column("row").take(take), rows.column("label").take(take), pa.array(keys), rows.column("n").take(take), _fixed(sketch[of])], ["row", "label", "key", "n", "sketch"])


def with_minhashes(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (cut) with the n and minhashes of their sets. The rows come to the sets, which are many and wide: of these none is dealt
    while the rows fit a broadcast, and else only those that have a row."""
    return matched(reps.select("row", "n", "minhashes"), F.col("row"), rows.withColumnRenamed("row", "of"), "of", F.col("row") == F.col("of")).drop("of")


def further_keys(rows: DataFrame, runs: range, similarity: float) -> DataFrame:
    """row, label, key, n, sketch: the first level of other runs, from (row, label, n, minhashes)."""
    place, path = roots(runs, similarity)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                mins = _rows(part.column("minhashes"), np.uint32, T)
                yield _level(part, mins, np.repeat(np.arange(part.num_rows), len(place)), children(path[None, :], mins[:, place]).ravel())

    return rows.select("row", "label", "n", "minhashes").mapInArrow(trimmed(go), _LEVEL)


def next_level(rows: DataFrame, similarity: float) -> DataFrame:
    """row, label, key, n, sketch: the children of the nodes `key`, from (row, label, key, n, minhashes)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                path = part.column("key").to_numpy().view(np.uint64)
                node, place = chosen(path, similarity)
                mins = _rows(part.column("minhashes"), np.uint32, T)
                yield _level(part, mins, node, children(mix(path[node] + _PLACE[place]), mins[node, place]))

    return rows.select("row", "label", "key", "n", "minhashes").mapInArrow(trimmed(go), _LEVEL)


def least_agreement(similarity: float) -> float:
    """The share of equal sketch bytes below which a pair is given up: four standard deviations under the similarity."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / T)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == b).sum(-1) / T - 1 / 256) * (256 / 255)


def bucket_edges(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: labels that sketches join in a bucket (key, own) of (label, n, sketch); a forest, so fewer than its members."""
    least = least_agreement(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups_of(batches, ["key", "own"], 4096):
            n, label = t.column("n").to_numpy(), t.column("label").to_numpy()
            sketch = _rows(t.column("sketch"), np.uint8, T)
            sizes = np.diff(np.r_[at, t.num_rows])
            group = np.repeat(np.arange(len(at)), sizes)
            # rows of one label are one node from the begin: the first of them in the bucket
            order = np.lexsort((label, group))
            new = np.r_[True, (np.diff(group[order]) != 0) | (np.diff(label[order]) != 0)]
            start = np.empty(t.num_rows, np.int64)
            start[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            now = start.copy()
            for d in range(1, int(sizes.max(initial=1))):  # pairs d apart: every pair of a bucket once
                open_ = sizes > d
                m = sizes[open_] - d
                a = np.repeat(at[open_], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                a = a[(now[a] != now[a + d]) & (np.minimum(n[a], n[a + d]) >= similarity * np.maximum(n[a], n[a + d]))]
                a = a[agreement(sketch[a], sketch[a + d]) >= least]
                if len(a):
                    now = forest(t.num_rows, now[a], now[a + d])[now]
            i = np.flatnonzero((now != start) & (start == np.arange(t.num_rows)))
            if len(i):
                yield pa.record_batch({"a": label[now[i]], "b": label[i]})

    return members.repartition("key", "own").sortWithinPartitions("key", "own").select("key", "own", "label", "n", "sketch").mapInArrow(trimmed(compare), "a long, b long")


def cross_edges(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: labels that sketches join between the two sides of (key, p, q): a forest of them, from (side, label, n, sketch)."""
    least = least_agreement(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups_of(batches, ["key", "p", "q"]):
            for low, high in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
                part = t.slice(low, high - low)
                n, side = part.column("n").to_numpy(), part.column("side").to_numpy()
                names, now = np.unique(part.column("label").to_numpy(), return_inverse=True)
                sketch = _rows(part.column("sketch"), np.uint8, T)
                left = np.flatnonzero(side == 0)
                merged = np.arange(len(names))
                for y in np.flatnonzero(side == 1):
                    x = left[merged[now[left]] != merged[now[y]]]
                    x = x[np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])]
                    x = x[agreement(sketch[x], sketch[y]) >= least]
                    if len(x):
                        merged[np.isin(merged, merged[now[x]])] = merged[now[y]]
                i = np.flatnonzero(merged != np.arange(len(names)))
                if len(i):
                    yield pa.record_batch({"a": names[merged[i]], "b": names[i]})

    return members.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").select("key", "p", "q", "side", "label", "n", "sketch").mapInArrow(trimmed(compare), "a long, b long")


def _dealt(salt: int, blocks: Column) -> Column:
    """The block of a row in its bucket: other in other buckets."""
    return F.pmod(F.xxhash64("row", "key", F.lit(salt)), blocks).cast("int")


def one_round(reps: DataFrame, level: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """a, b of the buckets under (row, label, key, and n and sketch if they are there); the rows that were in a large bucket on the first level; and the
    members of the buckets that are large on the last one. Buckets of one label alone are done already. A row carries its sketch,
    so that it is dealt to its bucket once and the sets aren't."""
    buckets, first, last = [], None, None
    if "sketch" not in level.columns:
        level = level.join(reps.select("row", "n", "sketch"), "row")
    for depth in range(LEVELS):
        counts = level.groupBy("key").agg(F.count("*").alias("count"), F.min("label").alias("x"), F.max("label").alias("y"))
        counts = cut(counts.where("x < y").select(F.col("key").alias("of"), "count"))
        keys, most = counts.agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0))).first()
        met = matched(level, F.col("key"), counts, "of", F.col("key") == F.col("of"), size=32 * keys).drop("of")
        buckets.append(met.where(F.col("count") <= BUCKET).select("key", F.lit(0).alias("own"), "label", "n", "sketch"))
        if most <= BUCKET:
            break
        large = met.where(F.col("count") > BUCKET)
        large = cut(large if depth == LEVELS - 1 else large.select("row", "label", "key"))
        if depth == 0:
            first = large.select("row").distinct()
        if depth == LEVELS - 1:
            last = large
            buckets.append(last.select("key", (_dealt(1, F.ceil(F.col("count") / WIDE)) + 1).alias("own"), "label", "n", "sketch"))
        else:
            level = written(next_level(with_minhashes(reps, large), similarity))
    return bucket_edges(reduce(DataFrame.unionByName, buckets), similarity), first, last


def rest_edges(last: DataFrame, labels: DataFrame, similarity: float) -> DataFrame | None:
    """a, b: what joins the labels of a bucket that is large on the last level. Most rows of such a bucket have one label by now;
    each other row is compared with all, and only those rows meet several blocks."""
    named = sized_join(last, labels.select(F.col("node").alias("row"), "component"), ["row"], "left").select("key", "row", F.coalesce("component", "row").alias("label"), F.col("n").alias("shingles"), "sketch")
    of = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("labels"))
    of = cut(of.where("labels > 1").select("key", "main", F.ceil(F.col("all") / WIDE).cast("int").alias("ps"), F.ceil((F.col("all") - F.col("most")) / WIDE).cast("int").alias("qs")))
    if of.isEmpty():
        return None
    rows = sized_join(named, of, ["key"], "inner")

    def counted(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = rows.withColumn("p", _dealt(2, F.col("ps"))).withColumn("q", counted(F.col("qs"))).withColumn("side", F.lit(0))
    right = rows.where("label <> main").withColumn("q", _dealt(3, F.col("qs"))).withColumn("p", counted(F.col("ps"))).withColumn("side", F.lit(1))
    return cross_edges(left.unionByName(right).select("key", "p", "q", "side", "label", F.col("shingles").alias("n"), "sketch"), similarity)


def candidate_classes(reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """node, component: classes that sketches make of the sets that meet in a bucket. A first round for all, enough runs for one
    level; another, up to the runs for all levels, for the sets that were in a large bucket."""
    reached = runs_for(recall, 1, similarity)
    level = reps.select("row", F.col("row").alias("label"), F.explode("keys").alias("key"), "n", "sketch")
    edges, first, last = one_round(reps, level, similarity)
    edges = cut(edges)
    for runs in (range(reached, runs_for(recall, LEVELS, similarity)), None):
        labels = components(edges)
        if last is not None:
            rest = rest_edges(last, labels, similarity)
            if rest is not None:
                edges = cut(edges.unionByName(rest))
                labels = components(edges)
        if first is None or runs is None:
            break
        open_ = sized_join(first, labels.select(F.col("node").alias("row"), "component"), ["row"], "left").select("row", F.coalesce("component", "row").alias("label"))
        level = written(further_keys(with_minhashes(reps, cut(open_)), runs, similarity))
        more, _, last = one_round(reps, level, similarity)
        edges, first = cut(edges.unionByName(more)), None
    return labels


def common_counts(own: tuple, chunk: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of own sets (as indexed() gives them) has in common with each of a chunk."""
    token, place, owner, rows = own
    n = np.array([len(s) for s in chunk])
    flat = np.concatenate(chunk) if len(chunk) else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(token, flat), max(0, len(token) - 1))
    hit = token[at] == flat if len(token) else np.zeros(len(flat), bool)
    code, of = at[hit], np.repeat(np.arange(len(chunk)), n)[hit]
    used = np.unique(code)
    code = np.searchsorted(used, code)
    order = np.argsort(code, kind="stable")
    code, of = code[order], of[order]
    out = np.zeros((rows, len(chunk)), np.float32)
    wide = 4096
    for low in range(0, len(used), wide):
        some = used[low : low + wide]
        a, b = np.zeros((rows, len(some)), np.float32), np.zeros((len(chunk), len(some)), np.float32)
        count = place[some + 1] - place[some]
        which = np.repeat(place[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        a[owner[which], np.repeat(np.arange(len(some)), count)] = 1
        x = slice(*np.searchsorted(code, [low, low + len(some)]))
        b[of[x], code[x] - low] = 1
        out += a @ b.T
    return out


def indexed(sets: list[np.ndarray]) -> tuple:
    """Distinct shingles of some sets, where each one's owners begin, the owners, and the number of sets."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.flatnonzero(np.r_[len(flat) > 0, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, int)
    return flat[new], np.r_[new, len(flat)], owner, len(sets)


def linked(own: list[np.ndarray], chunk: list[np.ndarray], similarity: float, index: tuple | None = None) -> np.ndarray:
    """Which of own sets and of a chunk's are at the similarity or above, by exact counts of common shingles."""
    both = common_counts(index or indexed(own), chunk)
    n, m = (np.array([len(s) for s in x], np.float64) for x in (own, chunk))
    return both >= similarity * (n[:, None] + m[None, :] - both) - 1e-6


def verify_blocks(texts: DataFrame, similarity: float) -> DataFrame:
    """row, component, block, blocks, copies, links, to, tokens and centre of (component, block). Of a class of one block: links to
    its other sets, each as often as it has copies, and the least row that the row is joined to. Of a class of several: tokens, and
    on one row of each block the shingles that more than half of the block's sets have."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in groups_of(batches, ["component", "block"]):
            row = t.column("row").to_numpy()
            t = t.filter(pa.array(np.r_[True, np.diff(row) != 0])) if len(row) else t  # a document that is there twice
            comp, block, blocks, row, copies = (t.column(c).to_numpy() for c in ("component", "block", "blocks", "row", "copies"))
            sets: list[np.ndarray] = []
            for part in slices(pa.record_batch({"text": t.column("text").combine_chunks()}), "text"):
                tokens, n = shingle_sets(Words(part.column("text"), WORD))
                sets += np.split(tokens, np.cumsum(n)[:-1])
            at = np.flatnonzero(np.r_[True, (np.diff(comp) != 0) | (np.diff(block) != 0)]) if len(row) else np.zeros(0, int)
            links, to = np.zeros(len(row), np.int64), row.copy()
            centre: list[bytes | None] = [None] * len(row)
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(row)], strict=True):
                if blocks[a] > 1:
                    token, place, _, _ = indexed(sets[a:b])
                    centre[a] = token[2 * np.diff(place) > b - a].tobytes()
                elif b - a == 2:
                    both = np.intersect1d(sets[a], sets[a + 1], assume_unique=True).size
                    if both >= similarity * (len(sets[a]) + len(sets[a + 1]) - both) - 1e-6:
                        links[a], links[a + 1], to[a + 1] = copies[a + 1], copies[a], row[a]
                elif b - a > 2:
                    good = linked(sets[a:b], sets[a:b], similarity)
                    np.fill_diagonal(good, False)
                    links[a:b] = good @ copies[a:b]
                    x, y = np.nonzero(np.triu(good))
                    to[a:b] = row[a:b][forest(b - a, x, y)]
            tokens = pa.array([s.tobytes() if k > 1 else None for s, k in zip(sets, blocks.tolist(), strict=True)], pa.binary())
            yield pa.record_batch([pa.array(x) for x in (row, comp, block, blocks, copies, links, to)] + [tokens, pa.array(centre, pa.binary())], names)

    names = ["row", "component", "block", "blocks", "copies", "links", "to", "tokens", "centre"]
    dealt = texts.repartition("component", "block").sortWithinPartitions("component", "block", "row")
    return dealt.select("component", "block", "blocks", "row", "copies", "text").mapInArrow(trimmed(compare), "row long, component long, block int, blocks int, copies long, links long, to long, tokens binary, centre binary")


def differences(blocks: DataFrame, centres: DataFrame, size: int, similarity: float) -> DataFrame:
    """row, component, copies, n, base, gone, light, diff of the classes with several blocks: how each set differs from its class's
    centre, which is any set of shingles and here those that most sets of one block have. base counts the centre's shingles, gone
    those that the set lacks; diff holds these and what it has beside the centre. Two sets have
    base - gone - gone + |diff and diff| shingles in common, so that the sets themselves needn't meet.

    light are those for which gone + similarity * added is at most (1 - similarity) * base / 2: any two of them are linked."""
    own = blocks.where("tokens is not null").select("row", "component", "copies", "tokens")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, base, gone, light, diff = [], [], [], [], []
            for tokens, centre in zip(batch.column("tokens"), batch.column("centre"), strict=True):
                x, c = (np.frombuffer(v.as_buffer(), np.uint64) for v in (tokens, centre))
                lacks, has = np.setdiff1d(c, x, assume_unique=True), np.setdiff1d(x, c, assume_unique=True)
                n.append(len(x))
                base.append(len(c))
                gone.append(len(lacks))
                light.append(len(lacks) + similarity * len(has) <= (1 - similarity) * len(c) / 2)
                diff.append(np.concatenate([lacks, has]).tobytes())
            yield pa.record_batch([*(batch.column(c) for c in ("row", "component", "copies")), pa.array(n, pa.int64()), pa.array(base, pa.int64()), pa.array(gone, pa.int64()), pa.array(light, pa.bool_()), pa.array(diff, pa.binary())], names)

    names = ["row", "component", "copies", "n", "base", "gone", "light", "diff"]
    met = sized_join(own, centres, ["component"], "inner", size).select("row", "component", "copies", "tokens", "centre")
    return met.mapInArrow(trimmed(differ), "row long, component long, copies long, n long, base long, gone long, light boolean, diff binary")


def shared_counts(index: tuple, chunk: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets in indexed() has in common with each of a chunk; work as the common elements ask for."""
    token, place, owner, rows = index
    flat = np.concatenate(chunk) if chunk else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(chunk)), [len(x) for x in chunk])
    out = np.zeros(rows * len(chunk), np.int64)
    if len(token) and len(flat):
        at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
        hit = token[at] == flat
        at, of = at[hit], of[hit]
        times = place[at + 1] - place[at]
        ends = np.cumsum(times)
        low = 0
        while low < len(at):  # about 2^21 common elements at once
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 21), "right")))
            t = times[low:high]
            which = np.repeat(place[at[low:high]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            out += np.bincount(owner[which] * len(chunk) + np.repeat(of[low:high], t), minlength=len(out))
            low = high
    return out.reshape(rows, len(chunk))


def shipped(met: DataFrame) -> DataFrame:
    """What meets in the strips (component, strip) of the classes that have sets which aren't light: every set once in its own strip
    (other 0), and those that aren't light in every strip of their class (other 1)."""
    met = met.where("heavy > 0")
    own = met.withColumn("strip", F.pmod(F.xxhash64("row", F.lit(11)), F.col("strips")).cast("int")).withColumn("other", F.lit(0))
    others = met.where(~F.col("light")).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).withColumn("other", F.lit(1))
    return own.unionByName(others).select("component", "strip", "other", "row", "copies", "n", "base", "gone", "light", "diff")


def verify_across(blocks: DataFrame, similarity: float) -> DataFrame:
    """row, links, to: the links of the classes with several blocks. Light sets are linked to each other without a comparison, by
    two sums of their class; the others' differences meet those of all sets, strip by strip. Only pairs with a set that isn't light
    are compared, and only differences are shipped."""
    centres = cut(blocks.where("centre is not null").groupBy("component").agg(F.min_by("centre", "block").alias("centre")))
    many, size = measured(centres)
    diffs = written(differences(blocks, centres, size, similarity))
    strips = F.greatest(F.ceil(F.count("*") / STRIP), F.ceil(F.sum(F.octet_length("diff") / 8) / SHINGLES), F.lit(1)).cast("int")
    light = F.col("light")
    classes = cut(diffs.groupBy("component").agg(strips.alias("strips"), F.sum((~light).cast("long")).alias("heavy"), F.sum(F.when(light, F.col("copies"))).alias("total"), F.min(F.when(light, F.col("row"))).alias("least")))
    met = sized_join(diffs, classes, ["component"], "inner", many * 128)  # a class is a row of five numbers
    closed = met.where(light).select("row", (F.col("total") - F.col("copies")).alias("links"), F.col("least").alias("to"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = None
        held: list[pa.RecordBatch] = []
        mine: dict | None = None

        def sets_of(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
            return [np.frombuffer(x, np.uint64) for x in t.column("diff").to_pylist()]

        def gathered() -> dict:
            t = pa.Table.from_batches(held)
            x = {c: t.column(c).to_numpy() for c in ("row", "copies", "n", "base", "gone")}
            return x | {"light": np.array(t.column("light").to_pylist(), bool), "index": indexed(sets_of(t)), "links": np.zeros(t.num_rows, np.int64), "to": np.arange(t.num_rows)}

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                key = list(zip(part.column("component").to_pylist(), part.column("strip").to_pylist(), part.column("other").to_pylist(), strict=True))
                begin = 0
                while begin < len(key):
                    end = begin
                    while end < len(key) and key[end] == key[begin]:
                        end += 1
                    some = part.slice(begin, end - begin)
                    if key[begin][:2] != strip:
                        if mine is not None:
                            yield pa.record_batch({"row": mine["row"], "links": mine["links"], "to": mine["row"][mine["to"]]})
                        strip, held, mine = key[begin][:2], [], None
                    if not key[begin][2]:
                        held.append(some)
                    else:
                        mine = mine or gathered()
                        row, copies, n, gone = (some.column(c).to_numpy() for c in ("row", "copies", "n", "gone"))
                        both = mine["base"][:, None] - mine["gone"][:, None] - gone[None, :] + shared_counts(mine["index"], sets_of(some))
                        good = both >= similarity * (mine["n"][:, None] + n[None, :] - both) - 1e-6
                        good &= mine["row"][:, None] != row[None, :]
                        mine["links"] += good @ copies
                        # one of the strip's sets for each that came; all others that it is linked to are joined to that one
                        first = good.argmax(0)
                        x, y = np.nonzero(good)
                        a, b = mine["to"][x], mine["to"][first[y]]
                        if (a != b).any():
                            a, b = np.unique(np.c_[a, b][a != b], axis=0).T
                            mine["to"] = forest(len(mine["row"]), a, b)[mine["to"]]
                        some_ = np.flatnonzero(good.any(0))
                        yield pa.record_batch({"row": row[some_], "links": (good * mine["light"][:, None]).T[some_] @ mine["copies"], "to": mine["row"][first[some_]]})
                    begin = end
        if mine is not None:
            yield pa.record_batch({"row": mine["row"], "links": mine["links"], "to": mine["row"][mine["to"]]})

    dealt = shipped(met).repartition("component", "strip").sortWithinPartitions("component", "strip", "other")
    return closed.unionByName(dealt.mapInArrow(trimmed(compare), "row long, links long, to long"))


def exact_links(documents: DataFrame, reps: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """row, links, to: exact links of the sets in candidate classes (node, component), whose texts are read once more."""
    about = matched(reps.select("row", "doc_id", "text_hash", "copies", "n"), F.col("row"), near, "node", F.col("row") == F.col("node"))
    about = cut(about.select("row", "component", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "copies", "n"))
    sizes = about.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    several = cut(sizes.where("blocks > 1"))
    wanted = sized_join(about, several, ["component"], "left").select("row", "component", "id", "hash", "copies", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    wanted = cut(wanted.withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), F.col("blocks")).cast("int")))
    read = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = matched(read, F.col("text_hash"), wanted, "hash", (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    within = written(verify_blocks(texts, similarity))
    links = within.select("row", "links", "to")
    return links if several.isEmpty() else links.unionByName(cut(verify_across(within, similarity)))


def jaccard_join(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """row, doc_id, text_hash, class_id, n_links, first: a row for each document.

    class_id is the smallest id in the document's class, the classes being the components of the links; n_links counts the
    other documents whose sets are at the similarity or above, equal sets included; `first` marks one document of each
    class, that with the smallest id (null ids last). A text without a word (or null) is linked to nothing; one with fewer
    than five words is one shingle. Repeated rows are copies of each other. An empty table gives an empty one.
    """
    all_ = written(signatures(documents.select("doc_id", "text"), similarity, runs_for(recall, 1, similarity)))
    # the representative of equal sets is the document with the smallest id; min() of a structure puts null first
    ranked = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    sets = cut(all_.where("n > 0").groupBy("h1", "h2").agg(F.min(ranked).alias("best"), F.count("*").alias("copies")).select("h1", "h2", F.col("best.row").alias("rep"), F.col("best.doc_id").alias("rep_id"), "copies"))
    several = cut(sets.where("copies > 1").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "rep", F.col("copies").alias("times")))
    reps = sized_join(all_.where("n > 0"), several, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").where("rep is null or rep = row")
    reps = reps.select("row", "doc_id", "text_hash", "n", "minhashes", "sketch", "keys", F.coalesce("times", F.lit(1)).alias("copies"))
    links = exact_links(documents, reps, candidate_classes(reps, similarity, recall), similarity)
    found = links.groupBy("row").agg(F.sum("links").alias("links")).where("links > 0")
    classes = components(links.select(F.col("row").alias("a"), F.col("to").alias("b")))
    ids = classes.join(sets.select(F.col("rep").alias("node"), "rep_id"), "node").groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no"), F.col("rep_id").alias("id"), F.col("node"))).alias("least"))
    known = sets.join(found.select(F.col("row").alias("rep"), "links"), "rep", "left").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").join(ids, "component", "left")
    known = cut(known.where("copies > 1 or links is not null").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("least.id", "rep_id").alias("class"), F.coalesce("least.node", "rep").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    out = sized_join(all_.select("row", "doc_id", "text_hash", "n", "h1", "h2"), known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") > 0), "left")
    alone = F.col("head").isNull()
    return out.select("row", "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("head") == F.col("row"))).alias("first"))


def one_of_each_class(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents without those that are not the first of their class; all columns, every other row as it is.

    Documents are matched to the join's rows by id and text hash. Where rows are repeated as a whole, one of them stays."""
    rows = jaccard_join(documents, similarity, recall)
    kept = rows.groupBy("doc_id", "text_hash").agg(F.sum(F.col("first").cast("int")).alias("__keep"), F.count("*").alias("n"))
    gone = cut(kept.where(F.col("__keep") < F.col("n")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__keep"))
    keep = gone.agg(F.max("__keep")).first()[0]
    on = F.col("__hash_of").eqNullSafe(F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    hashed = documents.withColumn("__hash_of", F.xxhash64("text"))
    marked = matched(hashed, F.col("__hash_of"), gone, "__hash", on, "left")
    if not keep:
        return marked.where("__hash is null").select(*documents.columns)
    once = marked.where("__keep > 0").dropDuplicates(["__id", "__hash"])
    return marked.where("__hash is null").unionByName(once).select(*documents.columns)
