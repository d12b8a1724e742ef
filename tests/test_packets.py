from pyspark.sql import functions as F

from ruleloom.operators import lexing as L
from ruleloom.operators import packets as K
from ruleloom.sources.lines import lines_of

TEXT = """# Top {#top authority=root}
Top prose with a rule. Tell the truth.[^aa11]

## Left {#left}
A first guard of the left part.

Left rule one.[^bb22] It cites more.

!!! meta "Commentary"
    Why the left part is there.

### Deep {#deep authority=user}
- Deep item rule.[^cc33]

**Example[^eg001]**: Asking
~~~text
a question that is quoted
~~~
<!-- GOOD[#top]: fine -->

## Right {#right}
Right prose that
runs over lines.[^dd44] See example[^eg002].

**Example[^eg002]**: Other
~~~
x
~~~
"""


def made(df):
    """The rows alone, so that plans over them stay small."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def parts(spark):
    lines = made(L.fences(lines_of(spark.createDataFrame([(1, TEXT)], "doc long, text string"), "doc", "text")))
    tree = made(L.sections(lines))
    bodies = made(K.placed_bodies(lines, tree))
    return lines, tree, bodies, made(L.passages(lines, made(L.example_bodies(lines)), tree))


def test_contexts_from_sections_references_and_quotes(spark):
    lines, tree, bodies, passages = parts(spark)
    rules = spark.createDataFrame([(1, "aa11", ["top"], []), (1, "bb22", ["top", "left"], ["eg001"]), (1, "cc33", ["top", "left", "deep"], []), (1, "zz99", [], [])], "spec long, rule string, sections array<string>, examples array<string>")
    anchors = spark.createDataFrame([(1, "aa11", "#nowhere")], "spec long, rule string, anchor string")
    refs = spark.createDataFrame([(1, "aa11", "dd44"), (1, "cc33", "eg001"), (1, "cc33", "q000")], "spec long, rule string, ref string")
    quotes = spark.createDataFrame([(1, "bb22", "Right prose that runs over [...] lost"), (1, "bb22", "question that is quoted"), (1, "bb22", "first guard of the left"), (1, "cc33", "said nowhere at all")], "spec long, rule string, quote string")
    got, shown, problems = map(made, K.derived_contexts(tree, passages, bodies, rules, anchors, refs, quotes))
    text = {r.passage: r.text.split("\n")[0][:12] for r in passages.collect()}
    of = {}
    for r in got.collect():
        of.setdefault(r.rule, {})[text[r.passage]] = r.own
    assert of["aa11"] == {"Top prose wi": True, "Right prose ": False}
    assert {k for k in of["bb22"]} == {"Top prose wi", "A first guar", "Left rule on", '!!! meta "Co', "Right prose "} and of["bb22"]["Left rule on"]
    assert set(of["cc33"]) >= {"Top prose wi", "A first guar", "- Deep item "} and "Right prose " not in of["cc33"]
    assert sorted((r.rule, r.example) for r in shown.collect()) == [("aa11", "eg002"), ("bb22", "eg001"), ("bb22", "eg002"), ("cc33", "eg001")]
    assert sorted((r.rule, r.problem, r.detail) for r in problems.collect()) == [("aa11", "unknown section", "nowhere"), ("cc33", "ungrounded quote", "said nowhere at all"), ("cc33", "unknown reference", "q000"), ("zz99", "no marker", None)]


def test_records_payloads_and_packets(spark):
    lines, tree, bodies, passages = parts(spark)
    context = made(K.mechanical_context(lines))
    by = {r.rule: r for r in context.collect()}
    assert by["cc33"].section_anchor == "deep" and [g.where for g in by["cc33"].ancestor_guards] == ["#top", "#left", "#left"]
    assert by["cc33"].section_examples[0].id == "eg001" and by["bb22"].commentary[0].quote == "Why the left part is there."
    rules = context.select("spec", "rule", F.lit("user").alias("authority"), F.array().cast("array<string>").alias("system_flags"), "sections", F.lit("t").alias("text"), F.lit("w").alias("trigger"), F.lit("d").alias("behavior"), F.lit("must").alias("modality"), F.array(F.lit("eg001")).alias("examples"), F.lit("section_header").alias("authority_provenance"))
    rules = made(rules)
    kinds = "spec long, rule string, dimensions array<string>, definitions array<string>, meta_resolution array<string>, exceptions array<string>, facets map<string,string>, facet_specifics map<string,string>, facet_evidence array<string>, external_examples array<struct<id:string,housed_in:string,why:string,verdict_notes:array<string>>>, coverage_notes string"
    enriched = spark.createDataFrame([(1, "cc33", ["k1"], None, None, ["x"], {"age": "applies"}, {"age": "young"}, None, [("eg009", "#right", "why", None)], "n")], kinds)
    edges = spark.createDataFrame([(1, "cc33", "dd44", "thematic", "tightens", "out", "s", None, None, "b"), (1, "cc33", "aa11", "thematic", "tightens", "in", "s", None, None, "a"), (1, "cc33", "bb22", "cross_reference", None, "out", "s", None, None, "c")], "spec long, src string, dst string, relation string, subtype string, direction string, source string, via array<string>, evidence struct<where:string,quote:string>, note string")
    groups = spark.createDataFrame([(1, "cc33", ["sec:b", "dim:k1"])], "spec long, rule string, groups array<string>")
    references = spark.createDataFrame([(1, "cc33", "right", "section", "q")], "spec long, rule string, anchor string, scope string, quote string")
    record = {r.rule: r for r in K.grouped_records(rules, context, enriched, groups, edges, references).collect()}
    c, a = record["cc33"], record["aa11"]
    assert [n.id for n in c.neighbor] == ["bb22", "aa11", "dd44"] and c.groups == ["dim:k1", "sec:b"] and c.sections == ["top", "left", "deep"]
    assert len(c.related_context) == 15 and c.related_context.facets == {"age": "applies"} and c.related_context.section_references[0].anchor == "#right"
    assert [(e.id, e.origin, e.housed_in) for e in c.related_context.examples] == [("eg001", "inventory", "#deep"), ("eg009", "external", "#right")] and c.related_context.examples[0].verdict_notes == ["GOOD[#top]: fine"]
    assert a.related_context.facets["state"] is None and a.related_context.facets["age"] == "unconditional_or_unspecified" and a.dimensions == [] and a.related_context.definitions == []
    jobs = spark.createDataFrame([(1, "top", "job01"), (1, "top/left", "job01"), (1, "top/left/deep", "job02"), (1, "top/right", "job01"), (2, "top", "job02")], "spec long, path string, job string")
    spans = spark.createDataFrame([(1, "top", 1, 9), (1, "top/left", 4, 8), (1, "top/right", None, None)], "spec long, path string, start_line int, end_line int")
    x = edges.where("relation = 'cross_reference'").select("spec", "src", "dst", F.lit("left").alias("anchor"), F.lit("said").alias("quote"))
    got = {r.job_id: r for r in K.section_jobs(rules, context, x, jobs, spans).collect()}
    assert [s.section_path for s in got["job01"].sections] == ["top/right", "top", "top/left"] and got["job01"].rule_count == 3
    assert got["job02"].sections[0].rules[0].cross_reference_edges[0].target_id == "bb22" and got["job02"].sections[0].marker_ids == ["cc33"]
    labels = spark.createDataFrame([(1, "aa11", "k1"), (1, "cc33", "k1"), (1, "aa11", "k2")], "spec long, id string, label string")
    registry = spark.createDataFrame([("k1", "One", "d1"), ("k2", "Two", "d2")], "key string, title string, definition string")
    dims = K.dimension_jobs(rules.drop("sections").join(context, ["spec", "rule"]), labels, registry).collect()
    assert [(d.key, d.definition, d.member_count, [m.line for m in d.members]) for d in dims] == [("k1", "d1", 2, [2, 13])]
    units = spark.createDataFrame([("u1", "user", "unit:01", "p", ["aa11@k1", "aa11@k2", "cc33"])], "unit string, authority string, cid string, provenance string, members array<string>")
    nodes = spark.createDataFrame([("aa11@k1", "aa11", "k1"), ("aa11@k2", "aa11", "k2"), ("cc33", "cc33", "k1")], "copy string, rule string, context string")
    contexts, shown, _ = map(made, K.derived_contexts(tree, passages, bodies, rules.where("rule in ('aa11', 'cc33')").withColumn("examples", F.array().cast("array<string>")), spark.createDataFrame([], "spec long, rule string, anchor string"), spark.createDataFrame([], "spec long, rule string, ref string"), spark.createDataFrame([], "spec long, rule string, quote string")))
    records = made(rules).select(*rules.columns)
    records = records.select("rule", "authority", "modality", "trigger", "behavior", "sections", F.create_map(F.lit("age"), F.lit("applies")).alias("facets"), F.lit(None).cast("map<string,string>").alias("facet_specifics"))
    p = K.unit_packets(units, nodes, records, contexts, shown, passages, bodies, edges).collect()[0]
    assert p.group_key == "user/unit:01" and [r.rule for r in p.rules] == ["aa11", "cc33"] and p.rules[0].dimension_roles_in_group == ["k1", "k2"]
    assert [(r.a, r.b) for r in p.relations] == [("aa11", "cc33")] and [e.example for e in p.examples] == ["eg001"]
    assert p.rules[1].source_text_refs[0] in [x.passage for x in p.context] and set(p.rules[0].context_refs) < set(p.rules[1].context_refs)
    assert p.rules[0].extracted_scope_hints.facets == {"age": "applies"}


def test_members_of_dimensions_are_rows(spark):
    kinds = "spec long, rule string, trigger string"
    records = spark.createDataFrame([(s, f"r{r}", f"t{r}") for s in range(9) for r in range(3)], kinds)
    labels = spark.createDataFrame([(s, f"r{r}", f"k{(s + r) % 4}") for s in range(9) for r in range(3)] * 2 + [(1, "gone", "k1"), (1, "r0", "k9"), (2, "r0", "k8"), (3, "r0", "k8")], "spec long, id string, label string")
    registry = spark.createDataFrame([(k, k.upper(), f"about {k}") for k in ("k0", "k1", "k3", "k5", "k8", "k9")], "key string, title string, definition string")
    rows = K.dimension_members(records, labels, registry)
    whole = {d.key: d for d in K.dimension_jobs(records, labels, registry).collect()}
    assert set(whole) == {"k0", "k1", "k3", "k8"} == {r.key for r in rows.select("key").distinct().collect()}
    for key, d in whole.items():
        mine = rows.where(F.col("key") == key).orderBy("spec", "rule").collect()
        assert [(m.rule, m.trigger) for m in mine] == [(m.rule, m.trigger) for m in d.members]
        assert {(m.title, m.definition, m.member_count) for m in mine} == {(d.title, d.definition, d.member_count)} and d.member_count == len(mine)


def test_documents_are_joined_as_they_are_dealt(spark):
    import re

    from ruleloom.plans import assembled, lexical, shim

    names = [f"spark.sql.{x}" for x in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold")]
    for n in names:  # as if every table were too large for a broadcast
        spark.conf.set(n, "-1")
    try:
        plan = lexical.source_passages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for n in names:
            spark.conf.unset(n)
    assert "SortMergeJoin" in plan and not re.search(r"hashpartitioning\(spec#\d+L?, ln#", plan)
    texts = shim.plain_lines(spark, "/root/testdata/sf0.001").select("spec", "ln", F.concat(F.lit("p "), "line").alias("want"))
    told = assembled._records(spark, "/root/testdata/sf0.001")[1].join(shim.rules(spark, "/root/testdata/sf0.001").select("spec", "ln", F.concat(F.lit("t"), "ln").alias("trigger")), ["spec", "trigger"])
    assert told.count() > 0 and told.join(texts, ["spec", "ln"]).where("not text <=> want").count() == 0


def test_packets_of_sections_are_rows_and_put_together_from_ranges(spark, monkeypatch):
    """No row holds a packet's entries; its text is the same whatever the ranges of documents."""
    from ruleloom.plans import assembled

    def never(*_):
        raise AssertionError("a packet's entries were put into one row")

    monkeypatch.setattr(K, "section_jobs", never)
    got = []
    for documents in (1 << 30, 7):
        monkeypatch.setattr(assembled, "DOCUMENTS", documents)
        got.append(sorted(map(tuple, assembled.section_job_payloads(spark, "/root/testdata/sf0.001").collect())))
    assert len(got[0]) == 12 and got[0] == got[1] and sum(r[2] for r in got[0]) == sum(len(r[3].split("/")) for r in got[0])


def test_section_members_are_the_sections_of_jobs(spark):
    records = spark.createDataFrame([(s, f"r{r}", "x", f"t{r}") for s in (1, 2) for r in range(4)], "spec long, rule string, sections string, trigger string")
    contexts = spark.createDataFrame([(s, f"r{r}", ["a", f"b{r % 2}"] if r else []) for s in (1, 2) for r in range(4)], "spec long, rule string, sections array<string>")
    jobs = spark.createDataFrame([(1, "a/b0", "job01"), (1, "a/b1", "job01"), (2, "a/b0", "job02"), (2, "a/b1", "job01")], "spec long, path string, job string")
    spans = spark.createDataFrame([(1, "a/b0", 9, 12), (1, "a/b1", 5, 8), (2, "a/b1", 2, 3)], "spec long, path string, start_line int, end_line int")
    edges = spark.createDataFrame([(1, "r1", "r3", "b1", "said")], "spec long, src string, dst string, anchor string, quote string")
    rows = K.section_members(records, contexts, edges, jobs, spans).collect()
    of = {j.job_id: j for j in K.section_jobs(records, contexts, edges, jobs, spans).collect()}
    assert len(rows) == 4 and set(of) == {"job01", "job02"}
    for job, j in of.items():
        mine = sorted((r for r in rows if r.job_id == job), key=lambda r: (r.spec, r.start_line, r.section_path))
        assert [r.asDict(True) | {"job_id": None} for r in mine] == [s.asDict(True) | {"job_id": None} for s in j.sections]
        assert (j.rule_count, j.section_count) == (sum(len(r.rules) for r in mine), len(mine))
    assert of["job01"].sections[0].rules[0].cross_reference_edges[0].target_id == "r3" and of["job02"].sections[0].start_line == 0
