import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import centroids as C
from ruleloom.llm import collocations as P
from ruleloom.llm import common
from ruleloom.llm import toxicity as T

# --- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, most):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = {}
    for key, a in f.items():
        lang, *w = key
        if len(w) > 1 and a >= least:
            longer = [b for (l2, *v), b in f.items() if l2 == lang and len(v) == 3 and len(w) == 2 and w in (v[:2], v[1:]) and 100 * b >= 50 * a and b >= least]
            if not longer:
                cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
                s, k = min(cuts)
                found.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1))


def odd_texts():
    rng = random.Random(5)
    words = ["New", "york", "é", "É", "a", "of", "the", "x-y", " ", " z", "long" * 400, "0"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b", "\x0c", " \x85 "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", "", None])))
    return rows + [(3, rows[3][1], "en")] * 15 + [(None, None, "en"), (7, "", None), (8, " \t.,", "fr"), (9, "new york new york new york " * 500, "en")]


@pytest.mark.parametrize("room", [common.BROADCAST_BYTES, 0])
def test_collocations_equal_plain_counts(spark, monkeypatch, room):
    monkeypatch.setattr(common, "BROADCAST_BYTES", room)  # without room for the dictionary ids are hashes
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS hash", "'w' AS word")
    got = sorted(tuple(r) for r in P.collocations(docs.repartition(3), least=4, most=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(rows, 4, 40) and len(got) > 60


def test_collocations_of_nothing(spark):
    assert P.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert P.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id long, text string, lang string")).collect() == []


def test_levels_of_buckets_find_the_best(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 50)
    rows = [("l", f"p{i}", i % 7, 10 + i % 3) for i in range(700)] + [("m", "q", 1, 10)]
    got = P.best(spark.createDataFrame(rows, "lang string, phrase string, score long, a long"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], 20)
    want = sorted(rows[:-1], key=lambda r: (-r[2], -r[3], r[1]))[:20]
    assert sorted((r["rank"], r["phrase"]) for r in got.where("lang = 'l'").collect()) == [(i, r[1]) for i, r in enumerate(want, 1)]


def test_cohesion_beyond_64_bits(spark):
    big = [(10**14 - 1, 10**14, 3 * 10**14 + 7), (12, 12, 12)]
    got = spark.createDataFrame(big, "a long, l long, r long").select(P.cohesion(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r["s"] for r in got] == [10**6 * a * a // (left * right) for a, left, right in big]


def test_radix_order_and_runs_without_breaks():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (500, 12)).astype(np.uint8)
    assert [bytes(k) for k in keys[P.radix_order(keys)]] == sorted(map(bytes, keys))
    b = int(P.BREAK[4])
    ids = np.array([b, 1, 2, 3, b, 4, b, 5, 6], np.uint64)
    assert [bytes(k) for k in P.packed(ids, 2, 4)] == [int.to_bytes(x, 4, "big") + int.to_bytes(y, 4, "big") for x, y in ((1, 2), (2, 3), (5, 6))]
    got, n = P.run_lengths(np.array([[1], [1], [2]], np.uint8), np.array([4, 5, 6]))
    assert got.ravel().tolist() == [1, 2] and n.tolist() == [9, 6]


def test_words_that_share_a_hash_get_another():
    batch = pa.RecordBatch.from_pydict({"text": ["one two one"], "lang": ["en"]})
    plain = P.Dealt(batch, np.zeros(0, np.uint64)).hash
    other = P.Dealt(batch, plain[:1].copy()).hash
    assert other[1] == plain[1] and other[0] == other[2] == P.other_hash("en", b"one") != plain[0]


# --- centroids -----------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, length, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda: [min((square(v, x), j) for j, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        of = [j for _, j in place()]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = place()
    each = Counter()
    for d, j in at:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr)


@pytest.mark.parametrize(("scale", "shift"), [(1024, 0.0), (1 << 20, 90.0)])
def test_clusters_equal_plain_rounds(spark, scale, shift):
    rng = np.random.default_rng(8)
    v = lambda x: [float(y) for y in np.asarray(x, np.float32)]
    rows = [(i, v(rng.standard_normal(6) / 4 + shift * (i % 2) + (i % 5))) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(400, 480)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (500, None), (501, [1.0] * 5), (502, [None] + [1.0] * 5), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "'x' AS v", "2 AS ids", "3 AS total").repartition(3)
    got = sorted((tuple(r) for r in C.clustered(df, k=8, rounds=4, length=6, scale=scale).collect()), key=repr)
    assert got == plain_clusters(rows, 8, 4, 6, scale)


def test_clusters_of_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -4.5])]
    assert sorted(map(tuple, C.clustered(make(rows), length=2).collect())) == plain_clusters(rows, 8, 10, 2, 1024)
    assert C.clustered(make([]), length=2).collect() == [] == C.clustered(make([(1, None)]), length=2).collect()
    with pytest.raises(Exception, match="might not fit a long"):
        C.clustered(make([(1, [1e30, 0.0])] * 2), length=2).collect()


def test_trees_of_ties_prune_nothing_that_owns():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-3, 4, (900, 4)), np.zeros((200, 4), np.int64)])
    tree, order = C.Tree.build(points)
    assert sorted(order.tolist()) == list(range(1100)) and (tree.points == points[order]).all()
    centroids = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [-3, 2, 1, 0], [50, 50, 50, 50]])
    n, sums, owner = C.Tree.unpacked(tree.packed(), 4).assign(centroids)
    want = np.square(tree.points[:, None] - centroids).sum(2).argmin(1)
    assert (owner == want).all() and n.tolist() == np.bincount(want, minlength=5).tolist()
    assert all((sums[j] == tree.points[want == j].sum(0)).all() for j in range(5))


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_gradients_equal_differences():
    x = T.Pieces.of(pa.array(["one two three two", "", "a averylongwordthatgoesonandonandonandon bb ccc " * 9, "two"], pa.large_string()), np.zeros(0, np.uint64))
    x.known = np.arange(len(x.hash)) % 3
    p = T.initial(np.array([0.3, -0.2]), 3, np.float64)
    text, begin, size = x.windows()
    label, weight, forget = (np.arange(len(begin)) % 2).astype(float), np.linspace(0.5, 1.5, len(begin)), np.arange(len(x.start)) == 1
    loss = lambda: T.gradients(p, x, begin, size, label, weight, forget)[0]
    grads = T.gradients(p, x, begin, size, label, weight, forget)[1]
    for k in p:
        for i in np.random.default_rng(1).integers(T.VOCABULARY if k == "words" else 0, p[k].size, 4):
            was, e = p[k].flat[i], 1e-5
            p[k].flat[i] = was + e
            up = loss()
            p[k].flat[i] = was - e
            down = loss()
            p[k].flat[i] = was
            assert abs((up - down) / (2 * e) - grads[k].flat[i]) < 1e-7, k


def test_windows_hold_every_word():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 31, 32, 33, 55, 56, 57, 400)] + [None, "x" * 1000]
    x = T.Pieces.of(pa.array(texts, pa.string()), np.zeros(0, np.uint64))
    text, begin, size = x.windows()
    for i in range(len(texts)):
        a, b = x.first[i], x.first[i + 1]
        covered = {j for t, s, n in zip(text, begin, size, strict=True) if t == i for j in range(s, s + n)}
        assert covered == set(range(a, b)) and (text == i).any()
        own = [(s, n) for t, s, n in zip(text, begin, size, strict=True) if t == i]
        assert all(s + n > s2 for (s, n), (s2, _) in zip(own, own[1:], strict=False))
    assert x.first[-1] - x.first[-2] == -(-1000 // T.PIECE)


def toxic_texts(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "er", "tion", "the", "re", "ing", "ed", "ou", "st", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(10, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["grubble", "snark", "zounded"]))
        rows.append((i + 10_000 * seed, " ".join(words), int(bad)))
    return rows


def test_toxicity_of_other_texts_is_learnt(spark):
    train, other = toxic_texts(1, 400), toxic_texts(2, 200)
    docs = lambda rows: spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(5, None), (None, 1), (999_999, 1), (6, 7)], "doc_id long, toxic int")
    model = T.fit(docs(train), labels)
    odd = [(-1, None, 0), (-2, "", 0), (-3, "...", 0), (-4, "an er " * 30_000 + "snark " + "x" * 5000, 1), other[0], other[0]]
    rows = docs(other + odd).selectExpr("*", "1 AS score", "'y' AS predicted", "2 AS `a b`").repartition(5)
    got = T.toxicity(rows, model, ["doc_id"]).collect()
    assert len(got) == len(other) + len(odd)
    right = sum(r["predicted"] == dict((i, y) for i, _, y in other + odd)[r["doc_id"]] for r in got if r["doc_id"] >= 0)
    assert right >= 0.97 * (len(other) + 2) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    same = {r["score"] for r in got if r["doc_id"] == other[0][0]}
    empty = {r["score"] for r in got if r["doc_id"] in (-1, -2, -3)}
    assert len(same) == 1 == len(empty)
    assert T.toxicity(docs([]), model, ["doc_id"]).collect() == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    clean = T.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in T.toxicity(docs, none, ["doc_id"]).collect()} == {0.5}
    assert {r["predicted"] for r in T.toxicity(docs, clean, ["doc_id"]).collect()} == {0}


def test_a_sample_is_bounded_in_texts_and_bytes(spark):
    rows = toxic_texts(3, 120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert T.fit(docs, labels, T.Sample(toxic=10, other=12, rounds=1)).p
    none = T.fit(docs, labels, T.Sample(text_bytes=0))
    assert not none.p and none.share == 0.5
    few = T.fit(docs, labels, T.Sample(toxic=0, other=9))
    assert not few.p and few.share == 0.5 / 10
