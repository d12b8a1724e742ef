from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.operators import lexing as L
from ruleloom.operators import rules as R
from ruleloom.sources.lines import lines_of


def lines(spark, *texts):
    return L.fences(lines_of(spark.createDataFrame(list(enumerate(texts)), "spec int, text string"), "spec", "text"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fences_nest_tilde_around_backtick(spark):
    got = rows(lines(spark, "a\n~~~\n```\nx\n~~~\nb\n```\ny\n~~~\n```\nc").select("ln", "fenced"), "ln")
    # a tilde line toggles even inside backticks
    assert [f for _, f in got] == [False, True, True, True, True, False, True, True, True, True, True]


def test_simple_fences_know_only_tildes(spark):
    got = rows(L.simple_fences(lines(spark, "a\n```\nb\n~~~\nc\n~~~\nd").drop("fenced")).select("ln", "fenced"), "ln")
    assert [f for _, f in got] == [False, False, False, True, True, True, False]


def test_section_tree_with_level_jumps_and_inheritance(spark):
    doc = "# A {#a authority=root tags=x,y}\ntext\n### B {#b}\n## C C! \n~~~\n# not a heading\n~~~\n# D {authority=user}\nend"
    tree = L.sections(lines(spark, doc))
    got = rows(tree.select("index", "level", "slug", F.array_join("path", "/"), "authority", "tags", "parent", "header_line", "end_line", "child_start"), "index")
    assert got == [
        (0, 1, "a", "a", "root", "x,y", None, 1, 7, 3),
        (1, 3, "b", "a/b", "root", "x,y", 0, 3, 3, None),
        (2, 2, "c_c", "a/c_c", "root", "x,y", 0, 4, 7, None),
        (3, 1, "d", "d", "user", None, None, 8, 9, None),
    ]
    owner = rows(L.innermost(lines(spark, doc), tree).select("ln", "section"), "ln")
    assert [s for _, s in owner] == [0, 0, 1, 2, 2, 2, 2, 3, 3]


def test_markers_blocks_and_sentences(spark):
    doc = "One [^ab12] goes\non here. Two [^cd34] is e.g. this. Three\n- item [^eg12]\n- more [^ef56]\n\n~~~\n[^zz99]\n~~~"
    ls = lines(spark, doc)
    assert rows(L.markers(ls).select("ln", "col", "rule"), "ln") == [(1, 4, "ab12"), (2, 13, "cd34"), (4, 7, "ef56")]
    whole, places = L.blocks(ls)
    assert [r.text for r in whole.orderBy("block").collect()] == ["One [^ab12] goes on here. Two [^cd34] is e.g. this. Three", "- item [^eg12]", "- more [^ef56]"]
    got = {r.rule: (r.sentence, r.sentence_text) for r in L.at_sentence(L.markers(ls), ls).collect()}
    assert got == {"ab12": (0, "One [^ab12] goes on here."), "cd34": (1, "Two [^cd34] is e.g. this."), "ef56": (0, "- more [^ef56]")}
    assert rows(places.select("ln", "offset"), "ln") == [(1, 0), (2, 17), (3, 0), (4, 0)]


def test_examples_verdicts_and_bodies(spark):
    doc = "**Example[^eg001]**: A title\n~~~xml\n<!-- GOOD: fine --> <!-- BAD[#why]: no -->\n~~~\n**Example[^eg002]**: B\ntext\n<!-- OK -->"
    ls = lines(spark, doc)
    got = {r.example: [tuple(v) for v in r.verdicts] for r in L.example_records(ls).collect()}
    assert got == {"eg001": [("GOOD", None, "fine"), ("BAD", "why", "no")], "eg002": [("OK", None, None)]}
    bodies = {r.example: (r.first, r.last, r.problem) for r in L.example_bodies(ls).collect()}
    assert bodies == {"eg001": (1, 4, None), "eg002": (5, None, "no fenced body")}


def test_commentary_paragraphs_and_passages(spark):
    doc = '# H {#h}\npara one\nstill one\n\n!!! meta "Commentary"\n\n    inside a\n    inside b\nafter\n~~~\nfenced\n~~~\nafter too'
    ls = lines(spark, doc)
    tree = L.sections(ls)
    assert rows(L.commentary(ls).select("ln", "text"), "ln") == [(5, "inside a inside b")]
    assert [r.text for r in L.paragraphs(L.innermost(ls, tree)).orderBy("first").collect()] == ["para one still one", "inside a inside b after after too"]  # here a blank line ends commentary
    got = rows(L.passages(ls, L.example_bodies(ls), tree).select("passage", "last", "commentary"), "passage")
    assert got == [("ctx00002", 3, False), ("ctx00005", 5, True), ("ctx00007", 13, True)]


def test_stem_and_framing(spark):
    ls = lines(spark, "# H\nFraming here.\n\nLead-in:\n\nStem:\n- one\n- two [^ab12]")
    assert rows(L.stems(ls, L.markers(ls)).select("ln", "stem", "framing"), "ln") == [(8, "Stem:", "Framing here.")]


def test_text_functions(spark):
    df = spark.range(1).select(
        T.slug(F.lit("  Hello, World! ")), T.clip(F.lit("a b  c d"), 2), T.bare(F.lit("x[^ab12]y[^eg001]")),
        T.attribute(F.lit("#a k=1 k=2}"), "k"), T.normalize(F.lit("“ﬁne”—x…  [^ab12]")), T.without_trailing_commas(F.lit('[{"a": "x, ]",}, ]')), T.without_trailing_commas(F.lit("[,]")),
    )
    assert tuple(df.first()) == ("hello_world", "a b [...]", "xy", "2", '"fine"-x...', '[{"a": "x, ]"} ]', "[,]")


def test_additions_only(spark):
    frame = lambda *t: spark.createDataFrame(list(enumerate(t)), "spec int, text string")
    before, after = frame("a b[^ab12] c", "a b", "a b", "[^ab12] a"), frame("a[^cd34] b[^ab12] [^ef56] c", "a x b", "a", "[^ab12] a [^zz11]")
    got = rows(R.additions_only(before, after).select("spec", "ok", "place", "word"), "spec")
    assert got == [(0, True, None, None), (1, False, 2, "x"), (2, False, 2, "b"), (3, True, None, None)]


def test_links_resolve(spark):
    ls = spark.createDataFrame([(0, 1, "see [?](#a) and [?](#b), [?](#a)")], "spec int, ln int, line string")
    titles = spark.createDataFrame([(0, "a", "The A")], "spec int, slug string, title string")
    assert tuple(R.resolved_links(ls, titles).first()) == (0, 1, "see [The A](#a) and [?](#b), [The A](#a)", 2, 1)


def test_empty_input(spark):
    ls = lines(spark)
    tree = L.sections(ls)
    assert tree.count() == L.blocks(ls)[0].count() == L.markers(ls).count() == L.passages(ls, L.example_bodies(ls), tree).count() == 0


# --- large documents ----------------------------------------------------------------------------------------------------


def random_documents(seed, n=6):
    import random

    rng = random.Random(seed)
    some = ["", " ", "text here.", "- item", "1. item", "~~~", "  ~~~", "```", "```python", "# One {#a authority=user}", "## Two", "### Three {#c tags=x}", "# Four", "###### Six", '!!! meta "Commentary"', "    body", "more text"]
    return ["\n".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_chunks_of_any_size_give_the_same_rows(spark):
    plain = lines_of(spark.createDataFrame(list(enumerate(random_documents(1))), "spec int, text string"), "spec", "text").cache()

    def found(chunk):
        fenced = L.fences(plain, chunk)
        tree = L.sections(fenced, chunk)
        inner = L.innermost(fenced, tree, chunk)
        whole, places = L.blocks(fenced, chunk)
        return [sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) for df in (fenced, tree, inner, whole, places)]

    want = found(None)
    assert sum(map(len, want)) > 300
    for chunk in (1, 3, 16, 1000):
        assert found(chunk) == want, chunk


def test_a_huge_document_is_dealt_to_many_tasks(spark):
    df = spark.range(1, 200_001).select(F.lit(1).alias("spec"), F.col("id").alias("ln"), F.when(F.col("id") % 1000 == 1, "# H").when(F.col("id") % 777 == 0, "~~~").otherwise("text").alias("line"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(was, ("false", "16"), strict=True):
        spark.conf.set(k, v)
    try:
        tasks = L.fences(df, 4096).groupBy(F.spark_partition_id()).count().collect()
        tree = L.sections(L.fences(df, 4096), 64)
        assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 60_000
        assert tree.count() == L.sections(L.fences(df)).count() > 90
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


# --- files --------------------------------------------------------------------------------------------------------------


def test_lines_of_split_files_equal_splitlines(spark, tmp_path):
    from ruleloom.sources.lines import lines_from_files

    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = {"a": "".join(f"é{i}ü{ends[i % 11]}" for i in range(60)), "b": "one\r\n\r\ntwo", "c": "x\x0b", "d": "x\x0b\n", "e": "x\r", "f": "\n\n", "g": "", "h": "\r\r\n\n\r", "i": "€ €", "j": "\x0b\x0b", "k": "no end é"}
    for name, text in texts.items():
        (tmp_path / f"{name}.md").write_bytes(text.encode())
    want = sorted((f"{name}.md", i, line) for name, text in texts.items() for i, line in enumerate(text.splitlines(), 1))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1", "2", "3", "7", "64", was):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, lines_from_files(spark, str(tmp_path)).collect())) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    rows_ = spark.createDataFrame([(n, t) for n, t in texts.items()] + [("z", None)], "spec string, text string")
    assert sorted((f"{r.spec}.md", r.ln, r.line) for r in lines_of(rows_, "spec", "text").collect()) == want


# --- forms in all scripts -----------------------------------------------------------------------------------------------


def test_forms_take_letters_and_blanks_of_all_scripts(spark):
    doc = '# Über {#résumé authority=user}\nsee [x](#été) and [^ñ123]\n1. item\n !!! meta "Commentary"\n    note'
    df = lines(spark, doc)
    assert [(r.slug, r.title) for r in L.headings(df).collect()] == [("résumé", "Über")]
    assert [r.anchor for r in L.links(df).collect()] == ["été"] and [r.rule for r in L.markers(df).collect()] == ["ñ123"]
    assert [r.text for r in L.commentary(df).collect()] == ["note"]
    assert df.where(F.col("line").rlike(T.LIST_ITEM)).count() == 1


def plain_difference(was, now):
    """The first place of `was`, from 1, where `now` has another word."""
    import re

    tag = re.compile(r"\[\^(?:\w{4}|eg\d{3})\]")
    same = lambda a, b: a == b or (tag.sub("", a) == tag.sub("", b) and all(tag.findall(b).count(t) >= tag.findall(a).count(t) for t in tag.findall(a)))
    left = iter(now.split())
    for k, w in enumerate(was.split(), 1):
        met = next((x for x in left if same(w, x) or not tag.fullmatch(x)), None)
        if met is None or not same(w, met):
            return k, w if met is None else met
    more = next((x for x in left if not tag.fullmatch(x)), None)
    return (None, None) if more is None else (len(was.split()) + 1, more)


def test_added_tags_equal_a_plain_walk_on_random_texts(spark):
    import random

    rng = random.Random(6)
    some = ["a", "b.", "[^ab12]", "a[^ab12]", "b.[^eg001]", "[^ab12][^cd34]", "[^é123]", "[^ab12]x"]
    pairs = []
    for i in range(400):
        was = [rng.choice(some) for _ in range(rng.randrange(12))]
        now = []
        for w in was:
            r = rng.random()
            now += [w] if r < 0.7 else [w + "[^zz99]"] if r < 0.8 else ["[^zz99]", w] if r < 0.95 else [rng.choice(some)] if r < 0.98 else []
        blank = lambda: rng.choice([" ", "\n", " ", "\x1c", "  \t"])
        pairs.append((i, "".join(w + blank() for w in was), "".join(w + blank() for w in now) + rng.choice(["", "", "[^qq11]", " more"])))
    before = spark.createDataFrame([(i, a) for i, a, _ in pairs] + [(1000, "only before"), (1002, None)], "spec int, text string")
    after = spark.createDataFrame([(i, b) for i, _, b in pairs] + [(1001, "only after"), (1002, "")], "spec int, text string")
    want = [(i, *plain_difference(a, b)) for i, a, b in pairs] + [(1000, 1, "only"), (1001, 1, "only"), (1002, None, None)]
    got = rows(R.additions_only(before, after).select("spec", "place", "word", "ok"), "spec")
    assert [g[:3] for g in got] == want and all(g[3] == (g[1] is None) for g in got)
    assert 50 < sum(p is None for _, p, _ in want) < 350
