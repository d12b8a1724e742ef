import hashlib
import itertools
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import edges as E
from ruleloom.operators import labels as S
from ruleloom.operators import partition as P


def test_mirrors_and_dedup(spark):
    e = spark.createDataFrame([("a", "b", "r", None, "out"), ("b", "a", "r", None, "out"), ("a", "c", "r", "s", "none")], "src string, dst string, relation string, subtype string, direction string")
    both = E.mirrored(e)
    assert E.asymmetric(both, ["relation", "subtype"]).count() == 0
    assert E.asymmetric(e, ["relation", "subtype"]).count() == 3
    kept = E.deduplicated(both.selectExpr("*", "case when rank = 0 then src else dst end as by"), ["src", "dst", "relation", "subtype"], ["by", "rank"])
    assert {(r.src, r.dst): r.direction for r in kept.collect()} == {("a", "b"): "out", ("b", "a"): "in", ("a", "c"): "none", ("c", "a"): "none"}


def test_bad_terms(spark):
    e = spark.createDataFrame([("thematic", "tightens", "out"), ("cross_reference", "tightens", "in"), ("x", None, "out"), ("thematic", None, "none"), ("same_section", None, "up")], "relation string, subtype string, direction string")
    assert sorted(r.problem for r in E.bad_terms(e).collect()) == ["direction", "relation", "subtype", "subtype"]


def test_components_of_a_long_chain_and_isolated_nodes(spark):
    n = 200
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:04d}",) for i in range(n + 1)] + [("alone",)], "node string")
    assert {r.node: r.component for r in P.components(nodes, edges).collect()} == {f"n{i:04d}": "n0000" for i in range(n + 1)} | {"alone": "alone"}


def test_merge_order_cap_and_floor():
    units = {"comp:01": (3, {"a", "b", "c"}), "comp:02": (2, {"a", "d"}), "comp:03": (1, {"e"})}
    bridges = {"comp:03": {"comp:02": 5}, "comp:02": {"comp:03": 5}}
    assert list(P.merges(units, bridges, cap=4, floor=2)) == [("comp:03", "comp:02", 5)]
    # the rule in common counts twice; then nothing fits under the cap
    assert list(P.merges(units, {}, cap=5, floor=3)) == [("comp:03", "comp:02", 0)]
    assert list(P.merges(units, {}, cap=6, floor=4)) == [("comp:03", "comp:02", 0), ("comp:01", "comp:02", 2)]
    assert list(P.merges(units, {}, cap=3, floor=3)) == [("comp:03", "comp:02", 0)]
    # without affinity: the smallest other unit, of equals the last by label
    assert list(P.merges({"a": (1, {"x"}), "b": (2, {"y"}), "c": (2, {"z"}), "d": (9, {"u"})}, {}, cap=20, floor=2)) == [("a", "c", 0)]


def plain_merges(units, bridges, cap, floor):
    """The rule said once more, over all pairs in every step."""
    now, out = {u: (n, set(r)) for u, (n, r) in units.items()}, []
    while len(now) > 1:
        n, small = min((n, u) for u, (n, _) in now.items())
        fits = [(2 * len(now[u][1] & now[small][1]) + bridges.get(small, {}).get(u, 0), -now[u][0], u) for u in now if u != small and now[u][0] + n <= cap]
        if n >= floor or not fits:
            return out
        w, _, into = max(fits)
        now[into] = (now[into][0] + n, now[into][1] | now.pop(small)[1])
        out.append((small, into, w))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_merges_match_the_rule(seed):
    r = random.Random(seed)
    units = {f"comp:{i:02d}": (n := r.randrange(1, 9), {f"r{r.randrange(25)}" for _ in range(n)}) for i in range(r.randrange(2, 20))}
    bridges: dict = {}
    for _ in range(r.randrange(15)):
        a, b = r.choice(list(units)), r.choice(list(units))
        if a != b:
            n = r.randrange(1, 5)
            bridges.setdefault(a, {})[b] = bridges.setdefault(b, {})[a] = n
    cap, floor = r.randrange(4, 16), r.randrange(2, 10)
    assert list(P.merges(units, bridges, cap, floor)) == plain_merges(units, bridges, cap, floor)


def plain_parts(members, links, cap):
    """Joining by the heaviest pair that fits, all pairs looked at in every step; then the small ones."""
    parts = {i: {m} for i, m in enumerate(members)}

    def weight(i, j, kinds):
        return sum(1 for a, b, s in links if s in kinds and ((a in parts[i] and b in parts[j]) or (a in parts[j] and b in parts[i])))

    while True:
        fits = [(-weight(i, j, (True,)), len(parts[i] | parts[j]), i, j) for i, j in combinations(parts, 2) if len(parts[i] | parts[j]) <= cap]
        if not fits or not min(fits)[0]:
            break
        _, _, i, j = min(fits)
        parts[i] |= parts.pop(j)
    for i in sorted(i for i, p in parts.items() if len(p) < 4):
        fits = [(weight(i, j, (True, False)), -len(p), j) for j, p in parts.items() if j != i and len(p | parts[i]) <= cap]
        if fits:
            parts[max(fits)[2]] |= parts.pop(i)
    return [sorted(parts[i]) for i in sorted(parts, key=lambda i: (-len(parts[i]), i))]


@pytest.mark.parametrize("seed", range(20))
def test_subdivision_matches_the_rule(seed):
    r = random.Random(seed)
    members = [f"m{i:02d}" for i in range(r.randrange(2, 18))]
    links = sorted({(a, b, r.random() < 0.6) for a, b in combinations(members, 2) if r.random() < 0.3}, key=lambda x: x[:2])
    cap = r.randrange(2, 9)
    parts = P.subdivided(members, links, cap)
    assert parts == plain_parts(members, links, cap)
    assert sorted(x for p in parts for x in p) == members and all(len(p) <= cap for p in parts)


def test_dominant_label_takes_the_first_met(spark):
    m = spark.createDataFrame([("u", "a@y", "y"), ("u", "a@x", "x"), ("u", "b", "y"), ("u", "c", "x")], "unit string, copy string, context string")
    assert P.dominant_labels(m).first().label == "x"


def plain_packing(sizes, packets):
    load, want = [0] * packets, {}
    for path, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        j = load.index(min(load))
        load[j] += n
        want[path] = f"job{j + 1:02d}"
    return want


def test_packing_matches_a_loop(spark):
    rng = random.Random(4)
    for packets, sizes in ((4, [(f"s{i:02d}", (i * 7) % 11 + 1) for i in range(30)]), (12, [(f"s{i:04d}", rng.choice([1, 1, 1, 2, 3, 50, 900])) for i in range(900)]), (3, [("a", 5)]), (3, [])):
        got = {r.path: r.job for r in P.packed(spark.createDataFrame(sizes, "path string, n int").repartition(5), packets).collect()}
        assert got == plain_packing(sizes, packets)


def test_runs_of_a_size_equal_dealing_one_by_one():
    rng = random.Random(9)
    for _ in range(300):
        packets = rng.randrange(1, 9)
        sizes = sorted({rng.choice([0, 1, 2, 3, 7, 10, 64, 1000]) for _ in range(5)}, reverse=True)
        classes = [(n, rng.randrange(1, 60)) for n in sizes]
        runs = list(P.deals(classes, packets))
        got = [turn[i % len(turn)] for _, _, many, turn in runs for i in range(many)]
        load, want = [0] * packets, []
        for n, many in classes:
            for _ in range(many):
                j = load.index(min(load))
                load[j] += n
                want.append(j)
        assert got == want
        assert all(sum(n == m for n, *_ in runs) <= 2 * packets for m, _ in classes)


def test_kappa_edges(spark):
    one = lambda rows: spark.createDataFrame(rows, "a boolean, b boolean").agg(S.kappa(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "ab")).alias("k")).first().k
    assert one([(True, True), (True, True)]) == 1.0
    assert one([(True, False), (True, False)]) == pytest.approx(0.0)
    assert one([(True, True), (False, False), (True, False), (False, True)]) == pytest.approx(0.0)


def test_permutation_counts_are_seeded(spark):
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "id string, label string")
    linked = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    x, y = S.permutation_p(labels, linked, 60).first(), S.permutation_p(labels, linked, 60).first()
    assert x == y and x.observed == 2 and 0.1 < x.p < 0.7
    parts = [S.permutation_p_within(labels.selectExpr("*", "1 AS g"), linked.selectExpr("*", "1 AS g"), "g", 61, 0, n).first() for n in (1, 3, 61)]
    assert parts[0] == parts[1] == parts[2]


def test_permutations_are_named_by_seed_number_and_id():
    ids = ["a", "b", "c", "d"]
    got = [x.tolist() for x in S.drawn(ids, 5, 6, 3)]
    key = lambda k, i: hashlib.md5(f"3:{k // 4}:{ids[i]}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8]
    assert got == [sorted(range(4), key=lambda i: (key(k, i), i)) for k in range(5, 11)]


def test_permutations_within_groups(spark):
    labels = spark.createDataFrame([(g, f"{g}{i}", f"l{l}") for g in (1, 2) for i, l in enumerate([0, 0, 1, 1, 70])] + [(1, "1x", None)] + [(3, f"3{i}", f"m{i}") for i in range(70)], "spec long, id string, label string")
    linked = spark.createDataFrame([(g, f"{g}{a}", f"{g}{b}") for g in (1, 2) for a, b in ((0, 1), (2, 3), (0, 4))] + [(1, "10", "gone"), (3, "30", "31")], "spec long, a string, b string")
    x, y = (S.permutation_p_within(labels.repartition(n), linked.repartition(n), "spec").first() for n in (1, 5))
    assert x == y and x.observed == 4 and x.p == (x.at_least + 1) / 1001
    # all hits of both: 2 of 15 pairings in the group of 6 ids (one without a label), 2 of 15 in that of 5, within wide bounds
    exact = [0, 0]
    for k, n in enumerate((6, 5)):
        every = list(itertools.permutations([0, 0, 1, 1, 70, None][:n]))
        exact[k] = sum((p[0] == p[1] is not None) + (p[2] == p[3] is not None) + (p[0] == p[4] is not None) == 2 for p in every) / len(every)
    assert abs(x.at_least / 1000 - exact[0] * exact[1]) < 0.02
    none = S.permutation_p_within(labels, linked.where("false"), "spec").first()
    assert (none.observed, none.p) == (0, 1.0)


def test_permutation_query_reads_the_documents(spark, tmp_path):
    from ruleloom.plans.catalogue import QUERIES

    text = "\n".join(f"line {i}" for i in range(40))
    got = []
    for n in (1, 3):
        spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got.append(QUERIES["permutation_p"](spark, f"{tmp_path}/{n}").first())
    assert 0 < got[0].observed < got[1].observed and all(r.p == round((r.at_least + 1) / 1001, 9) for r in got)


def test_nesting_and_registry(spark):
    labels = spark.createDataFrame([("1", "a"), ("2", "a"), ("1", "b"), ("2", "b"), ("1", "c")], "id string, label string")
    assert sorted(map(tuple, S.nesting(labels).collect())) == [("a", "b", "duplicate"), ("c", "a", "nested"), ("c", "b", "nested")]


def test_an_updated_graph_equals_a_rebuilt_one_and_leaves_other_files(spark, tmp_path):
    import os

    from ruleloom.operators import maintain as M

    rng = random.Random(11)
    make = lambda rows: spark.createDataFrame(sorted(rows), "spec int, key string, id string")
    keys = ["spec", "key"]
    rows = {(rng.randrange(3), f"g{rng.randrange(12)}", f"r{rng.randrange(30):02d}") for _ in range(160)}
    path = str(tmp_path / "graph")
    M.write_graph(make(rows), path, keys, 8)
    files = lambda: {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    for changes in (6, 1, 0, 40):
        gone = set(rng.sample(sorted(rows), changes))
        new = rows - gone | {(rng.randrange(3), f"g{rng.randrange(14)}", f"r{rng.randrange(30):02d}") for _ in range(changes)}
        before = files()
        touched = M.update_graph(path, make(rows), make(new), keys, 8)
        kept = {f for f in before if int(f.split("/")[0].removeprefix("part=")) not in touched}
        assert kept <= files() and (bool(touched) == bool(rows ^ new))
        want = sorted((s, k, a, b) for s, k, a in new for t, m, b in new if (s, k) == (t, m) and a != b)
        assert sorted((r.spec, r.key, r.src, r.dst) for r in spark.read.parquet(path).collect()) == want
        rows = new
    gone = {r for r in rows if r[0] != 1}
    M.update_graph(path, make(rows), make(rows - gone), keys, 8)
    assert {r.spec for r in spark.read.parquet(path).select("spec").distinct().collect()} == {1}


def test_a_graph_has_few_files_and_is_updated_without_a_copy(spark, tmp_path, monkeypatch):
    """Files a part don't grow with the tasks, and the edges that are overwritten are written once; by groups sent to all tasks and by a shuffle."""
    import os

    from ruleloom.operators import maintain as M

    keys, path = ["spec", "key"], str(tmp_path / "graph")
    make = lambda rows: spark.createDataFrame(sorted(rows), "spec int, key string, id string")
    rows = {(s, f"g{g}", f"r{i:02d}") for s in range(4) for g in range(4) for i in range(12)}
    files = lambda: [sum(f.endswith(".parquet") for f in names) for d, _, names in os.walk(path) if "part=" in d]
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        M.write_graph(make(rows), path, keys, 16)
    finally:
        spark.conf.unset(coalesced)
    assert sum(files()) == len(files()) > 4
    cut, real = [], type(make(rows)).checkpoint
    monkeypatch.setattr(type(make(rows)), "checkpoint", lambda df, *a: cut.append(df.columns) or real(df, *a))
    for most, gone in ((100, "r00"), (0, "r01")):
        monkeypatch.setattr(M, "FEW_GROUPS", most, raising=False)
        new = {r for r in rows if r[0] != 1 or r[2] != gone}
        M.update_graph(path, make(rows), make(new), keys, 16)
        want = sorted((s, k, a, b) for s, k, a in new for t, m, b in new if (s, k) == (t, m) and a != b)
        assert sorted((r.spec, r.key, r.src, r.dst) for r in spark.read.parquet(path).collect()) == want
        assert sum(files()) == len(files())
        rows = new
    assert len(cut) == 2 and all("src" not in c for c in cut)


def test_small_groups_are_dealt_to_several_tasks(spark):
    comps = spark.createDataFrame([(f"a{i:02d}", "comp:01", [f"a{i:02d}:{k}" for k in range(9)]) for i in range(40)], "authority string, label string, members array<string>")
    edges = spark.createDataFrame([(f"a{i:02d}", f"a{i:02d}:{k}", f"a{i:02d}:{(k + 1) % 9}", "thematic") for i in range(40) for k in range(9)], "authority string, a string, b string, relation string")
    got = P.subdivisions(comps, edges, 4).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 4 and sorted(m for r in got for m in r.members) == sorted(f"a{i:02d}:{k}" for i in range(40) for k in range(9))
    assert all(len({m[:3] for m in r.members}) == 1 and len(r.members) <= 4 for r in got)
    seen = P.by_group(edges, ["authority"], lambda a, rows: [(a, len(list(rows)))], "authority string, n long").collect()
    assert sorted(map(tuple, seen)) == [(f"a{i:02d}", 9) for i in range(40)]


@pytest.mark.parametrize("seed", range(12))
def test_subdivision_by_groups_is_that_by_pairs(seed):
    """Pairs inside groups give the same parts whether they are listed or told by the groups."""
    rnd = random.Random(seed)
    members = [f"m{i:02d}" for i in range(rnd.randrange(5, 40))]
    groups = {m: f"g{rnd.randrange(4)}" for m in members if rnd.random() < 0.9}
    some = {tuple(sorted(rnd.sample(members, 2))): rnd.random() < 0.7 for _ in range(rnd.randrange(2 * len(members)))}
    inside = {(a, b): False for a, b in combinations(members, 2) if a in groups and groups[a] == groups.get(b)}
    links = lambda pairs: sorted((a, b, s) for (a, b), s in pairs.items())
    cap = rnd.randrange(3, 12)
    assert P.subdivided(members, links(some), cap, groups=groups) == P.subdivided(members, links(inside | some), cap)


def test_components_of_groups_are_those_of_their_pairs(spark):
    from ruleloom.plans import shim

    shim.shared_folder(spark)
    nodes = spark.createDataFrame([(s, f"{s}:{g}{i}", g) for s in (1, 2) for g in "abcd" for i in range(4)], "spec long, node string, group string")
    made = lambda rows: spark.createDataFrame(rows, "spec long, a string, b string")
    for edges in (made([]), made([(1, "1:a0", "1:a1")]), made([(1, "1:b3", "1:d0"), (1, "1:d2", "1:c1"), (2, "2:a1", "2:b0"), (2, "2:c0", "2:c1")])):
        pairs = nodes.alias("x").join(nodes.alias("y"), ["spec", "group"]).where("x.node < y.node").selectExpr("x.node as a", "y.node as b")
        want = {(r.node, r.component) for r in P.components(nodes, pairs.unionByName(edges.select("a", "b"))).collect()}
        assert {(r.node, r.component) for r in P.components_of_groups(nodes, edges, ["spec"]).collect()} == want


def test_units_make_no_pairs_of_a_label(spark, monkeypatch):
    """Pairs of rules of one label grow with the square of a document; their groups do not."""
    from ruleloom.plans import graph

    def never(*_):
        raise AssertionError("pairs of a label were made")

    monkeypatch.setattr(graph.E, "shared_labels", never)
    for query in (graph.unit_subdivision, graph.unit_merge):
        got = query(spark, "/root/testdata/sf0.001")
        assert got.count() > 0 and dict(got.dtypes)["authority"] == "string"
