"""Tables that are dealt out by document stay so through the operators, and give the same rows as tables that aren't."""

from pyspark.sql import functions as F

from ruleloom.operators import packets as K
from ruleloom.operators.dealing import cut
from ruleloom.plans import shim


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_cut_tables_meet_without_a_shuffle(spark):
    shim.shared_folder(spark)
    shim.by_document(spark)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    df = cut(spark.range(200).select((F.col("id") % 7).alias("spec"), "id").repartition("spec"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == was
    n = df.groupBy("spec", "id").agg(F.count("*").alias("n"))
    met = df.hint("merge").join(n, ["spec", "id"])
    assert exchanges(met) == 0 and met.count() == 200


def _packets(spark, own):
    """Packets of two units; with `own`, the tables name the unit of their rows."""
    at = lambda rows, names, kinds: spark.createDataFrame([r if own else r[1:] for r in rows], ", ".join(f"{n} {k}" for n, k in list(zip(names, kinds))[0 if own else 1 :]))
    units = spark.createDataFrame([(1, "user", "c1", "whole", ["a", "b"]), (2, "user", "c2", "whole", ["c"])], "unit long, authority string, cid string, provenance string, members array<string>")
    nodes = at([(1, "a", "a", "k1"), (1, "b", "b", "k1"), (2, "c", "c", "k2")], ["unit", "copy", "rule", "context"], ["long", "string", "string", "string"])
    records = at([(u, r, "must", {"age": "applies"}, None) for u, r in ((1, "a"), (1, "b"), (2, "c"))], ["unit", "rule", "modality", "facets", "facet_specifics"], ["long", "string", "string", "map<string,string>", "map<string,string>"])
    contexts = at([(1, "a", "p1", True), (1, "a", "p2", False), (1, "b", "p2", True), (2, "c", "p3", True)], ["unit", "rule", "passage", "own"], ["long", "string", "string", "boolean"])
    passages = at([(1, "p1", "one", False, 1, 1), (1, "p2", "one", False, 2, 2), (2, "p3", "two", False, 1, 1)], ["unit", "passage", "text", "commentary", "first", "last"], ["long", "string", "string", "boolean", "int", "int"])
    edges = spark.createDataFrame([("a", "b", "thematic", "x", "s", None, None, "n")], "src string, dst string, relation string, subtype string, source string, via string, evidence string, note string")
    none = spark.createDataFrame([], "rule string, example string"), spark.createDataFrame([], "example string, text string")
    return sorted(map(str, K.unit_packets(units, nodes, records, contexts, none[0], passages, none[1], edges).collect()))


def test_packets_of_tables_with_their_unit(spark):
    shim.shared_folder(spark)
    got = _packets(spark, True)
    assert len(got) == 2 and got == _packets(spark, False)


def test_no_quotes_read_no_text(spark, monkeypatch):
    """Without quotes the whole texts aren't put together nor searched."""
    shim.shared_folder(spark)
    from ruleloom.operators import context as C
    from ruleloom.plans import assembled

    def never(*_):
        raise AssertionError("texts were searched")

    monkeypatch.setattr(C, "searchable", never)
    assert assembled.rule_contexts(spark, "/root/testdata/sf0.001").count() > 0


def test_quotes_are_streamed_and_large_documents_go_in_groups(spark, monkeypatch):
    from ruleloom.operators import context as C

    texts = spark.createDataFrame([(1, "one two three two"), (2, "two"), (3, None)], "spec long, text string")
    quotes = spark.createDataFrame([(1, q) for q in ("one", "two", "three", "four", "two", "", None)] + [(2, "one"), (2, "two"), (3, "two"), (4, "two")], "spec long, quote string")
    want = {(1, "one", 0), (1, "two", 4), (1, "two", 14), (1, "three", 8), (2, "two", 0)}
    for most in (C.QUOTES, 2):
        monkeypatch.setattr(C, "QUOTES", most)
        found = C.occurrences(quotes, texts)
        assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
        assert {tuple(r) for r in C.held_quotes(quotes, texts).collect()} == {w[:2] for w in want}


def test_lines_in_blocks_and_places_are_cut_once(spark):
    from ruleloom.operators import lexing as L

    lines = L.fences(spark.createDataFrame([(1, 1, "One. Two [^ab12]"), (1, 2, "more. [^cd34] Three."), (1, 3, "# H [^ef56]")], "spec long, ln int, line string"))
    cuts = []
    found = L.at_sentence(L.markers(lines), lines, lambda df: cuts.append(df) or df)
    assert len(cuts) == 2
    assert sorted(map(str, found.collect())) == sorted(map(str, L.at_sentence(L.markers(lines), lines).collect())) and found.count() == 3


def test_checked_rules_are_lexed_once(spark, monkeypatch):
    from ruleloom.plans import artifacts, graph

    calls, real = [], shim.marked_lines
    monkeypatch.setattr(shim, "marked_lines", lambda *a: calls.append(a) or real(*a))
    graph._checked(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    own, plain = [], shim.plain_lines
    monkeypatch.setattr(shim, "plain_lines", lambda *a: own.append(a) or plain(*a))
    artifacts.rule_record_check(spark, "/root/testdata/sf0.001")
    assert len(own) == 1


def test_rules_are_lexed_once_and_meet_no_tree_in_a_join(spark):
    from ruleloom.operators import lexing as L
    from ruleloom.sources.lines import lines_of

    plan = shim.rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    text = "none\n# A {#a authority=user}\nx\n### C\ny\n~~~\n# fenced\n~~~\n## B {#b tags=t}\n\n#### D {#d authority=root}\nz\n# E\nlast"
    lines = L.fences(lines_of(spark.createDataFrame([(1, text), (2, "a\n## B\nb"), (3, "no heading"), (4, None)], "spec long, text string"), "spec", "text"))
    tree = L.sections(lines)
    met = L.innermost(lines, tree).join(tree.select("spec", F.col("index").alias("section"), "header_line", "path", "authority"), ["spec", "section"], "left")
    columns = ["spec", "ln", "line", "section", "header_line", "path", "authority"]
    got = sorted(map(str, L.placed(lines).select(*columns).collect()))
    assert got == sorted(map(str, met.select(*columns).collect())) and len(got) == 18


def test_lines_end_as_in_python_whatever_ends_a_text_has(spark):
    from ruleloom.sources.lines import OTHER_ENDS, lines_of

    texts = [f"a{e}b\nc{e}" for e in ["\n", "\r\n", *OTHER_ENDS]] + ["", "\n", "x", "a\n\nb", "é\r\n\r\n~", None]
    got = {}
    for r in lines_of(spark.createDataFrame(list(enumerate(texts)), "spec long, text string"), "spec", "text").orderBy("spec", "ln").collect():
        got.setdefault(r.spec, []).append(r.line)
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t}
    plan = lines_of(spark.createDataFrame([(1, "a")], "spec long, text string"), "spec", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan


def test_section_payloads_read_the_documents_once(spark):
    from ruleloom.plans import assembled

    plan = assembled.section_payloads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # the rules are written once, and the packing and the payloads read them


def without_broadcasts(spark):
    names = [f"spark.sql.{x}" for x in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold")]
    for n in names:  # as if every table were too large for a broadcast
        spark.conf.set(n, "-1")
    return names


def test_stored_tables_meet_without_a_shuffle(spark):
    from ruleloom.operators.dealing import stored

    shim.shared_folder(spark)
    shim.by_document(spark)
    df = stored(spark.range(200).select((F.col("id") % 7).alias("spec"), "id", F.lit("x").alias("text")).repartition("spec"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]
    met = df.hint("merge").join(df.groupBy("spec", "id").agg(F.count("*").alias("n")), ["spec", "id"])
    assert exchanges(met) == 0 and met.count() == 200 and met.agg(F.sum("n")).first()[0] == 200


def test_records_and_contexts_meet_as_lines_are_dealt(spark, monkeypatch):
    """Lines are dealt out and written once; what is derived from them takes them as they are, but for the sentences, which are a union."""
    from ruleloom.plans import assembled

    calls, real = [], shim.marked_lines
    monkeypatch.setattr(shim, "marked_lines", lambda *a, **k: calls.append(a) or real(*a, **k))
    names = without_broadcasts(spark)
    try:
        of, records, contexts = assembled._records(spark, "/root/testdata/sf0.001")
        met = records.join(contexts, ["spec", "rule"]).join(of.select("spec", "rule", "path"), ["spec", "rule"])
        assert exchanges(met) <= 1 and len(calls) == 1
        assert met.count() == of.count() > 0
    finally:
        for n in names:
            spark.conf.unset(n)


def test_members_are_kept_once(spark):
    records = spark.createDataFrame([(1, "a", "t1"), (1, "b", "t2"), (2, "a", "t3")], "spec long, rule string, trigger string")
    labels = spark.createDataFrame([(1, "a", "k1"), (1, "b", "k1"), (2, "a", "k2"), (2, "a", "k9")], "spec long, id string, label string")
    registry = spark.createDataFrame([("k1", "One", "d1"), ("k2", "Two", "d2")], "key string, title string, definition string")
    kept = []
    got = K.dimension_members(records, labels, registry, keep=lambda df: kept.append(df) or df).collect()
    assert len(kept) == 1 and {"key", "spec", "rule", "trigger"} == set(kept[0].columns) and kept[0].count() == 3
    assert sorted((r.key, r.member_count, r.spec, r.rule, r.trigger) for r in got) == [("k1", 2, 1, "a", "t1"), ("k1", 2, 1, "b", "t2")]
