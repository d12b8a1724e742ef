import random
import re
from itertools import combinations

import pytest

from ruleloom.llm.components import components
from ruleloom.llm.ngram_join import jaccard_join, one_of_each_class, runs_for


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * (len(sets[i] | sets[j])) - 1e-9:
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        k = (r[0] is None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((r[0] if r[0] is not None else -1, None if least[root(i)][0] else least[root(i)][1], links[i]) for i, r in enumerate(rows))


def fixture():
    """Copies, a large group of near copies, a passage in many documents, short and empty texts, ties and repeated rows."""
    rows, passage = [], " ".join(words(60, 99))
    base = words(120, 1)
    for i in range(60):
        w = list(base)
        w[i] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(150, 200 + i)) + " " + passage) for i in range(20)]
    rows += [(200, "One two THREE"), (201, "one, two three!"), (202, "one two"), (203, ""), (204, None), (205, "?!"), (206, " ".join(words(300, 5)))]
    rows += [(207, rows[-1][1]), (206, rows[-1][1]), (None, rows[-1][1].upper()), (300, "a b c d e f g h i j"), (301, "a b c d e f g h i k")]
    w = words(100, 7)
    rows += [(400, " ".join(w)), (401, " ".join(w[:90])), (402, " ".join(w[:80])), (403, " ".join(w[:70]))]
    return rows


def test_matches_brute_force(docs):
    rows = fixture()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in jaccard_join(docs(rows)).collect())
    assert got == brute(rows)


def test_blocks_and_second_level_lose_nothing(docs, monkeypatch):
    """Tiny buckets and blocks make every group take the split ways."""
    import ruleloom.llm.ngram_join as N

    for name, value in (("BUCKET", 4), ("BLOCK", 8), ("WIDE", 8), ("STRIP", 8)):
        monkeypatch.setattr(N, name, value)
    rows = fixture()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in jaccard_join(docs(rows), recall=0.99999).collect())
    assert got == brute(rows)


def test_one_of_each_class_keeps_columns_and_clean_rows(spark, docs):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, None), (3, None), (4, "other words are here in this text")]
    df = docs(rows).selectExpr("*", "'x' as key", "1 as row", "2 as n")
    kept = one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4]


def test_empty_table(docs):
    assert jaccard_join(docs([])).count() == one_of_each_class(docs([])).count() == 0


def test_a_side_too_large_for_a_broadcast_changes_nothing(docs, monkeypatch):
    from ruleloom.llm import common

    rows = fixture()
    want = sorted(map(tuple, one_of_each_class(docs(rows)).fillna(-1).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in jaccard_join(docs(rows)).collect())
    assert got == brute(rows)
    assert sorted(map(tuple, one_of_each_class(docs(rows)).fillna(-1).collect()), key=str) == want


def test_thousands_of_near_copies_and_a_very_long_text(docs):
    """Every two of the near copies are at 0.9; beside them copies of a very long text, one of which is altered."""
    base, rows = words(200, 1), []
    for i in range(2600):
        w = list(base)
        w[5 + i % 190] = f"x{i}"
        rows.append((i, " ".join(w)))
    long = words(120_000, 2)
    rows += [(5000, " ".join(long)), (5001, " ".join(long)), (5002, " ".join(long[:-1000])), (5003, " ".join(long[60_000:])), (5004, " ".join(words(300, 3)))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs(rows)).collect()}
    assert all(got[i] == (0, 2599) for i in range(2600))
    assert [got[i] for i in range(5000, 5005)] == [(5000, 2), (5000, 2), (5000, 2), (5003, 0), (5004, 0)]


def test_a_large_bucket_edge_count_is_linear(spark, docs):
    """What a bucket of near copies emits is a forest, also where it is dealt to several blocks."""
    from pyspark.sql import functions as F

    from ruleloom.llm import ngram_join as N

    base, rows = words(200, 1), []
    for i in range(2600):
        w = list(base)
        w[5 + i % 190] = f"x{i}"
        rows.append((i, " ".join(w)))
    reps = N.written(N.signatures(docs(rows), 0.8, 3))
    level = reps.select("row", F.col("row").alias("label"), F.explode("keys").alias("key"))
    edges, first, last = N.one_round(reps, level, 0.8)
    # a row is in so many buckets at most: the first places and what they branch to
    assert 2599 <= edges.count() < 4 * level.count() and first.count() == 2600


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_without_a_partner_are_not_dealt(spark, docs, monkeypatch):
    """A group of near copies that fills large buckets on two levels, among many other texts: the minhashes and sketches of those stay
    where they are, whatever Spark itself would broadcast."""
    from pyspark.sql import functions as F

    from ruleloom.llm import ngram_join as N

    base, rows = words(200, 1), [(1000 + i, " ".join(words(20, 100 + i))) for i in range(4000)]
    for i in range(60):
        w = list(base)
        w[5 + i] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(N, "BUCKET", 16)
    monkeypatch.setattr(N, "WIDE", 16)
    reps = N.written(N.signatures(docs(rows), 0.8, N.runs_for(0.999, 1)).withColumn("copies", F.lit(1)))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        classes = N.candidate_classes(reps, 0.8, 0.999)
        took = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert classes.where("component = node").count() == 1 and classes.count() == 60
    assert took < 4060 * (256 + 64)  # less than all minhashes and sketches once


def near_copies(n, edits, seed=1):
    """n texts of 200 words with so many words replaced, all different."""
    base, rows = words(200, seed), []
    for i in range(n):
        w = list(base)
        for j in range(edits):
            w[(7 * i + 61 * j + i // 200) % 195] = f"x{i}y{j}"
        rows.append((10_000 * seed + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("edits", [1, 3, 5])
def test_large_classes_by_differences(docs, monkeypatch, edits):
    """Two families in many blocks and strips, with sets near the centre, at the limit and beyond it: links and classes as by brute
    force, whichever of the ways a pair takes."""
    import ruleloom.llm.ngram_join as N

    for name, value in (("BLOCK", 16), ("STRIP", 16)):
        monkeypatch.setattr(N, name, value)
    rows = near_copies(50, edits) + near_copies(40, edits, 2) + near_copies(12, 6)[6:]
    rows += rows[:3]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs(rows), recall=0.99999).collect())
    assert got == brute(rows)


def test_what_verification_ships_is_linear(docs):
    """Near copies of one text: no set goes to several strips, and sets near the centre go to none."""
    from pyspark.sql import functions as F

    from ruleloom.llm import ngram_join as N

    for n in (1500, 3000, 6000):
        reps = N.written(N.signatures(docs(near_copies(n, 1)), 0.8, 3).withColumn("copies", F.lit(1).cast("long")))
        near = reps.select(F.col("row").alias("node"), F.lit(0).cast("long").alias("component"))
        seen = []
        real, whole = N.shipped, N.differences
        try:
            N.shipped = lambda diffs: seen.append(real(diffs)) or seen[-1]
            N.differences = lambda blocks, *about: seen.append(blocks) or whole(blocks, *about)
            links = N.exact_links(docs(near_copies(n, 1)), reps, near, 0.8)
            assert [tuple(r) for r in links.groupBy("row").agg(F.sum("links").alias("l")).groupBy("l").count().collect()] == [(n - 1, n)]
        finally:
            N.shipped, N.differences = real, whole
        blocks, strips = seen
        assert blocks.count() == n and strips.count() == 0


@pytest.mark.parametrize("rows", [200_000, 50])
def test_components_with_hubs(spark, monkeypatch, rows):
    from ruleloom.llm import components as C

    monkeypatch.setattr(C, "TASK_ROWS", rows)
    edges = [(0, i) for i in range(1, 400)] + [(399, 1000)] + [(1000, i) for i in range(1001, 1300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 0 for i in range(1000, 1300)}


def test_runs_follow_the_recall():
    assert runs_for(0.999, 1) < runs_for(0.999, 3) and runs_for(0.9, 1) < runs_for(0.99, 1)


@pytest.mark.parametrize("n", [1, 50])
def test_components_of_chains(spark, monkeypatch, n):
    from ruleloom.llm import components as C

    monkeypatch.setattr(C, "TASK_ROWS", 10)
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (7000, 7001), (7001, 7000)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {7000: 7000, 7001: 7000}
