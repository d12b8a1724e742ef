import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import maxent_lm as lm
from ruleloom.llm.exact_search import exact_top_k
from ruleloom.llm.mixing import mix_plan, mixed
from ruleloom.llm.near_search import near_top_k
from ruleloom.llm.warc import parse, ranges, read_records, with_types, write_archives


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1))


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((150, 8)).astype(np.float32))]
    rows += [(200 + i, rows[40][1]) for i in range(30)] + [(40, rows[40][1]), (300, [0.0] * 8), (320, None), (340, [1.0] * 7 + [None]), (360, [float("nan")] * 8), (380, [float("inf")] + [0.0] * 7), (400, [1.0, 2.0]), (None, rows[3][1])]
    return rows


def brute(rows, score, zero):
    ok = [(i, [*v, *[0.0] * (8 - len(v))]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % 20 == 0:
            best = sorted((-score(q, v), j if j is not None else 1 << 62) for b, (j, v) in enumerate(ok) if a != b)[:20]
            out += [(i, k, None if j == 1 << 62 else j, -s) for k, (s, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


def test_exact_search(spark):
    rows = odd_vectors()
    got = sorted(map(tuple, exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()), key=repr)
    whole = lambda v: [math.floor(64 * x) for x in v]
    assert got == brute(rows, lambda q, v: sum(a * b for a, b in zip(whole(q), whole(v), strict=True)), True)


def test_exact_search_in_several_blocks(spark, monkeypatch):
    import ruleloom.llm.exact_search as E

    monkeypatch.setattr(E, "VECTORS", 40)
    monkeypatch.setattr(E, "QUERIES", 3)
    test_exact_search(spark)


def test_exact_search_of_large_numbers(spark):
    big = [(i, [float(x) for x in v]) for i, v in enumerate((np.random.default_rng(1).integers(-(1 << 24), 1 << 24, (60, 3))).astype(np.float32))]
    whole = lambda v: [64 * int(x) for x in v]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_top_k(vectors(spark, big), F.col("vec_id") % 20 == 0).collect())
    want = []
    for i in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(whole(big[i][1]), whole(v), strict=True)), j) for j, v in big if j != i)[:20]
        want += [(i, k, j, -x) for k, (x, j) in enumerate(best, 1)]
    assert got == want
    with pytest.raises(Exception, match="fit a long"):
        exact_top_k(vectors(spark, [(0, [1e18]), (1, [1e18])]), F.col("vec_id") % 20 == 0).collect()


def test_bounds_hold_and_few_exact_vectors_are_read():
    from ruleloom.llm.exact_search import scanned

    rng = np.random.default_rng(2)
    v, q = np.floor(64 * rng.standard_normal((500, 32))), np.floor(64 * rng.standard_normal((20, 32)))
    low, width = v.min(), max(1.0, np.ceil((v.max() - v.min() + 1) / 256))
    upper, spread = scanned(((v - low) // width).astype(np.uint8), low, width, q)
    assert (upper >= q @ v.T).all() and (upper - spread[:, None] <= q @ v.T).all()


def test_near_search_in_several_groups_with_a_hot_bucket(spark, monkeypatch):
    """All rows are visited when the recall is 1 on every query; a bucket of equal vectors is split."""
    import ruleloom.llm.near_search as N

    for name, value in (("GROUP", 32), ("BUCKET", 8), ("SAMPLE", 1000)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((400, 8)).astype(np.float32))]
    rows += [(1000 + i, rows[40][1]) for i in range(150)]
    for parts in (1, 7):
        got = near_top_k(vectors(spark, rows).repartition(parts), F.col("vec_id") % 20 == 0, recall=1.0).collect()
        want = [(i, k, j) for i, k, j, _ in brute(rows, lambda q, v: float(np.dot(np.array(q), np.array(v))), False)]
        assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)


def test_near_search_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32) * rng.random((1500, 1)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = near_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    s = x[::20].astype(float) @ x.astype(float).T
    s[np.arange(len(s)), np.arange(0, 1500, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert sum(r.vec_id in best[r.query_id // 20] for r in got) / best.size >= 0.9 and len(got) == best.size
    assert all(r.score == pytest.approx(s[r.query_id // 20, r.vec_id], abs=1e-12) for r in got)


def test_near_search_few_vectors(spark):
    rows = [r for r in odd_vectors() if r[0] in (0, 1, 2, 40, 300, 320, 340, 360, 380, 400)]
    got = sorted(((r.query_id, r.rank, r.vec_id) for r in near_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    assert got == sorted(x[:3] for x in brute(rows, lambda q, v: sum(a * b for a, b in zip(q, v, strict=True)), False))
    empty = vectors(spark, [])
    assert near_top_k(empty, F.col("vec_id") % 20 == 0).count() == exact_top_k(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_mixing_targets_and_draws(docs):
    rows = [(i, "w " * (1 + i % 50), None, f"s{i % 7}" if i % 11 else None) for i in range(3000)] + [(9000, None, None, "zz"), (9001, "", None, "zz"), (9002, "a b c", None, "s1")]
    got = mix_plan(docs(rows).selectExpr("*", "1 as size")).collect()
    total = sum(r["__size"] for r in got)
    by = {r["source"]: (r["__source_size"], r["__target"]) for r in got}
    assert sum(t for _, t in by.values()) == pytest.approx(total) and all(t <= 3 * s + 1e-9 for s, t in by.values())
    order = sorted(by, key=lambda s: (s is None, s or ""))
    open_ = [(by[s][1] / (1, 2, 3)[k % 3]) for k, s in enumerate(order) if by[s][1] < 3 * by[s][0] - 1e-6]
    assert max(open_) == pytest.approx(min(open_))
    for s, (size, target) in by.items():
        taken = sum(r["__size"] * r["__copies"] for r in got if r["source"] == s)
        assert all(r["__copies"] <= 3 for r in got) and (not size or abs(taken - target) <= max(50, 0.02 * target))
    assert {r.doc_id: r["__size"] for r in got}[9002] == 2
    again = {(r.doc_id, r["__copies"]) for r in mix_plan(docs(rows[::-1])).collect()}
    assert again == {(r.doc_id, r["__copies"]) for r in got}
    assert mixed(docs(rows)).count() == sum(r["__copies"] for r in got) and mixed(docs([])).count() == 0


def test_small_sources_meet_their_targets(docs):
    """Sources of some dozen documents of sizes far apart, a very long one, rows without an id and an extra column of a clashing
    name: each source within a document or 2 % of its target."""
    rows = [(i, "w " * (1 + (i * i * 37) % 900), None, f"s{i % 23}") for i in range(800)]
    rows += [(None, "w " * (5 + i), None, "noid") for i in range(40)] + [(5000, "w " * 400_000, None, "long"), (5001, "w w", None, "long")]
    got = mix_plan(docs(rows).selectExpr("*", "1 as size", "2 as cell", "3 as u", "4 as n")).collect()
    by = {}
    for r in got:
        x = by.setdefault(r["source"], [0, r["__target"], 0])
        x[0] += r["__size"] * r["__copies"]
        x[2] = max(x[2], r["__size"])
    assert len(by) == 25 and all(abs(taken - target) <= max(most, 0.02 * target) for taken, target, most in by.values())


def test_one_source_mix(docs):
    got = mix_plan(docs([(1, "a b c", None, "only"), (2, None, None, "only")])).collect()
    assert [(r["__target"], r["__copies"]) for r in got] == [(3.0, 1), (3.0, 1)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>é\r\n\r\nWARC/1.1</p>"), (2, "http://b", "same"), (3, "http://c", "same"), (7, "http://d", "same"), (4, None, None), (5, "u\r\nX: y", ""), (8, "http://e", "x" * 300_000), (9, "t", "tie"), (9, "t", "tie"), (9, "t", "tie"), (None, "n", "nul"), (None, "n", "nul")]
    index = write_archives(pages(spark, rows))
    got = read_records(index).collect()
    assert len(got) == len(rows) == index.count()
    for p, _, h in rows:
        data = (h or "").encode()
        mine = [r for r in got if r.page_id == p and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()]
        assert mine and all(r.payload_bytes == len(data) for r in mine)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert [k for k in kinds if k[0] in (2, 3, 7)] == [(2, "revisit", 7), (3, "revisit", 7), (7, "response", None)]
    assert Counter(k[1:] for k in kinds if k[0] == 9) == {("response", None): 1, ("revisit", 9): 2}
    assert Counter(k[1] for k in kinds if k[0] == 0) == {"response": 1, "revisit": 1}
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}[1] == rows[0][2]
    one = read_records(index.where("page_id = 8")).collect()
    assert [len(r.payload) for r in one] == [300_000]
    assert {r.record_type for r in with_types(pages(spark, rows), 10).where("page_id in (2, 3, 7)").collect()} == {"response"}
    assert read_records(write_archives(pages(spark, []))).count() == 0


def test_warc_leaves_orphans_alone_and_nothing_behind(spark, tmp_path):
    """A lost task's archive in the folder is never read; after reading the archives are gone."""
    import os

    from ruleloom.llm.common import shared_dir
    from ruleloom.llm.warc import archived

    folder = tmp_path / "warcs"
    folder.mkdir()
    (folder / "lost.warc.gz").write_bytes(b"half a record")
    rows = [(i, f"http://h/{i}", f"page {i % 4}") for i in range(40)]
    assert read_records(write_archives(pages(spark, rows), f"file:{folder}")).count() == 40
    before = {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("warc-")}
    got = archived(pages(spark, rows), ["page_id", "record_type"])
    assert got.count() == 40 and got.where("record_type = 'response'").count() == 4
    assert {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("warc-")} == before


def test_warc_ranges_and_bad_records():
    assert list(ranges([0, 10, 100_000], [10, 10, 5])) == [(0, 2, 0, 20), (2, 3, 100_000, 100_005)]
    with pytest.raises(ValueError):
        parse(b"HTTP/1.1 200\r\n\r\n")


def test_lm_base_score_and_odd_rows(docs):
    rows = [(i, f"The cat {i % 5} sat on\tthe mat. word{i}") for i in range(60)] + [(61, None), (62, ""), (62, ""), (None, "the   CAT"), (64, "the cat " * 20_000)]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), " end"]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    count = Counter(w for i, t in rows if crc(i) != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = lm.lm_scores(docs(rows).selectExpr("*", "1 as key", "2 as h")).collect()
    want = sorted(((i if i is not None else -1, crc(i) == 2, len(w := tokens(t)), sum(x in count for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows))
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert [h[5] for h in have] == pytest.approx([w[5] for w in want])
    assert all(r.score < 0 for r in got) and lm.lm_scores(docs([])).count() == 0


def test_lm_words_without_hot_counts(docs, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 3)
    test_lm_base_score_and_odd_rows(docs, )


def plain_score(model, tokens, count):
    """log10 probability of a text's tokens by loops over the features and outcomes, with the model's tables alone."""
    def mixed(x):
        m = (1 << 64) - 1
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 29
        x = x * 0x9FB21C651E98DF25 & m
        return x ^ x >> 32

    hashes, kinds, _ = lm.with_ends(lm.Words(pa.array([" ".join(tokens)]), lm.TOKEN))
    n, m = len(model.class_weights), len(model.slot_weights) // lm.CLASSES
    total, back = 0.0, [0x45, 0x45]
    for h, kind in zip(hashes.tolist(), kinds.tolist(), strict=True):
        f = [mixed(x ^ s) for x, s in zip((back[0], back[1], (back[0] * 31 + back[1]) % (1 << 64)), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True)]
        at = [i for i, x in enumerate(model.frequent.tolist()) if x == h]
        y, s = (int(model.of_class[at[0]]), int(model.of_slot[at[0]])) if at else (lm.REST, kind)
        z = [float(model.class_prior[c]) + sum(float(model.class_weights[x % n][c]) for x in f) for c in range(lm.CLASSES)]
        u = [float(model.slot_prior[y][k]) + sum(float(model.slot_weights[(x >> 20) % m + m * y][k]) for x in f) for k in range(lm.SLOTS)]
        total += z[y] - math.log(sum(map(math.exp, z))) + u[s] - math.log(sum(map(math.exp, u)))
        if not at:
            total += math.log((count.get(h, 0) + 1) / (model.tokens[s] + model.words[s] + 1))
        back = [h, back[0]]
    return total / math.log(10)


def test_lm_scores_match_plain_loops_however_the_rows_lie(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(lm.lm_scores(d.repartition(5)).collect(), key=lambda r: r.doc_id)
    train = d.where(lm.crc_mod("doc_id", 7) != 2)
    counts = lm.cut(lm.word_counts(train))
    models = [lm.train(train.repartition(k), counts, rows[0].train_tokens) for k in (1, 6)]
    assert all(np.array_equal(getattr(models[0], x), getattr(models[1], x)) for x in ("frequent", "class_weights", "slot_weights", "tokens"))
    count = {r["h"] % (1 << 64): r["c"] for r in counts.collect()}
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in rows[::9]:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert r.score == pytest.approx(plain_score(models[0], tokens, count), rel=1e-5)


def test_lm_beats_the_base_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.lm_scores(d).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.05
    z = np.random.default_rng(0).standard_normal((7, lm.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(lm.log_softmax(z, np.array([[0, 1], [2, 3], [4, 5]]), z[6])).sum(1), 1, atol=1e-5)
