from pyspark.sql import functions as F

from ruleloom.operators import assembly as A
from ruleloom.operators import checks as K
from ruleloom.operators import lexing as L
from ruleloom.sources.lines import lines_of

DOC = "# One {#one}\nGuard text.\n\n## Two {#two}\nFirst [^aa11] and [^bb22] see [x](#three). Second [^cc33].\n## Three {#three}\nA [^dd44]\nwrapped line with [back](#two).\n## Four {#four}\nNo marker here cites [y](#two)."


def lines(spark):
    return L.fences(lines_of(spark.createDataFrame([("s", DOC)], "spec string, text string"), "spec", "text"))


def test_mechanical_graph(spark):
    rules = spark.createDataFrame([("s", "aa11", ["eg001"]), ("s", "bb22", []), ("s", "cc33", ["eg001"]), ("s", "dd44", [])], "spec string, rule string, examples array<string>")
    edges, refs = A.mechanical_graph(lines(spark), rules)
    got = {}
    for r in edges.collect():
        got.setdefault(r.relation, set()).add((r.src, r.dst))
    assert got["same_sentence"] == {("aa11", "bb22"), ("bb22", "aa11")}
    assert len(got["same_section"]) == 6 and got["shares_example"] == {("aa11", "cc33"), ("cc33", "aa11")}
    assert got["cross_reference"] == {("aa11", "dd44"), ("bb22", "dd44"), ("dd44", "aa11"), ("dd44", "bb22"), ("dd44", "cc33")}
    assert refs.count() == 0  # section four owns no rule, so its citation is no one's


def test_ancestor_guards(spark):
    ls = lines(spark)
    tree = L.sections(ls)
    got = A.ancestor_guards(tree, L.paragraphs(L.innermost(ls, tree))).collect()
    assert {(r.slug, r.anchor, r.quote) for r in got} == {(s, "#one", "Guard text.") for s in ("two", "three", "four")}


def test_text_rewrites(spark):
    row = spark.range(1).select(A.blinded(F.lit("a [b](#c)[^ab12] [^eg001]")), A.substituted(F.lit("Acme's ACME acme Acmes"), [("Acme", "New$Co")]), A.verdict_note(F.lit("BAD"), F.lit("x"), F.lit(None)), A.original(F.lit("r@k"))).first()
    assert tuple(row) == ("a b ", "New$Co's NEW$CO new$co Acmes", "BAD[#x]", "r")


def test_taxonomy_says_pass_fail_skip(spark):
    one = spark.range(1)
    assert {tuple(r) for r in A.taxonomy({"a": one, "b": one.limit(0), "c": None}).collect()} == {("a", "FAIL", 1), ("b", "PASS", 0), ("c", "SKIP", 0)}


def plain_pair_problems(rules, labels, edges):
    from collections import Counter

    held = {}
    for i, label in labels:
        held.setdefault(i, set()).add(label)
    ids = [r for r, _ in rules]
    via = lambda a, b: sorted(held.get(a, set()) & held.get(b, set()))
    want = {
        "same_section": Counter((a, b) for a, p in rules for b, q in rules if a != b and p == q),
        "shares_dimension": Counter((a, b) for a in ids for b in ids if a != b and via(a, b)),
    }
    out = []
    for name, w in want.items():
        have = Counter((a, b) for a, b, r, v in edges if r == name and (name == "same_section" or (v and v == via(a, b))))
        bad = Counter((a, b) for a, b, r, v in edges if r == name and name == "shares_dimension" and not (v and v == via(a, b)))
        out += [(name, f"{a}>{b}", "missing") for a, b in (w - have).elements()] + [(name, f"{a}>{b}", "extra") for a, b in ((have - w) + bad).elements()]
    return sorted(out)


def test_fingerprints_find_every_pair_that_is_wrong(spark):
    import random

    rng = random.Random(3)
    for round_ in range(3):
        rules = [(f"r{i:02d}", rng.choice(["a", "a/b", "c"])) for i in range(24)]
        labels = sorted({(r, f"k{rng.randrange(5)}") for r, _ in rules for _ in range(rng.randrange(4))})
        held = {r: {x for i, x in labels if i == r} for r, _ in rules}
        edges = [(a, b, "same_section", None) for a, p in rules for b, q in rules if a != b and p == q]
        edges += [(a, b, "shares_dimension", sorted(held[a] & held[b])) for a, _ in rules for b, _ in rules if a != b and held[a] & held[b]]
        if round_:
            edges = [e for e in edges if rng.random() > 0.02 or (e[0] > "r12" and round_ == 1)]
            edges += rng.sample(edges, 3) + [("r00", "r00", "same_section", None), ("r01", "gone", "same_section", None), ("r01", "gone", "shares_dimension", ["k1"]), ("r03", "r04", "shares_dimension", ["k9"]), ("r03", "r04", "shares_dimension", None)]
        df = spark.createDataFrame([(*e, "none") for e in edges], "src string, dst string, relation string, via array<string>, direction string").withColumn("subtype", F.lit(None).cast("string"))
        r = spark.createDataFrame([(i, p.split("/")) for i, p in rules], "rule string, sections array<string>")
        b = spark.createDataFrame(labels, "id string, label string")
        groups = spark.createDataFrame([], "gid string, members array<string>")
        want = plain_pair_problems(rules, labels, edges)
        assert (len(want) > 5) == bool(round_)
        for checker in (K.grouped, K.grouped_again):
            found = checker(r, df, b, b.select(F.col("label").alias("key")).distinct(), groups, r).where("check in ('same_section', 'shares_dimension')")
            assert sorted(map(tuple, found.collect())) == want, checker


def test_reruns_are_compared_by_digests(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i}", float(i)) for i in range(300)]
    make = lambda r: spark.createDataFrame(r, "id long, text string, x double")
    first, same, other = make(rows), make(rows[::-1]), make([*rows[1:], rows[5], (9, "t9", -9.0)])
    assert K.rerun_difference(first, same.select("x", "id", "text")).collect() == []
    got = sorted(map(tuple, K.rerun_difference(first, other).collect()), key=repr)
    assert got == sorted([(*rows[0], "first"), (*rows[5], "second"), (9, "t9", -9.0, "second")], key=repr)
    # with written digests that agree the tables aren't read
    digests = K.row_digests(first)
    unread = first.withColumn("text", F.raise_error(F.lit("read")))
    assert digests.count() <= K.BUCKETS * K.WITHIN and K.rerun_difference(unread, unread, (digests, K.row_digests(same))).collect() == []
    swapped = make([(1, None, 2.0), (2, "a", None)])
    assert K.rerun_difference(swapped, make([(1, None, 2.0), (2, None, None)])).count() == 2
