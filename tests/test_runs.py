import json

import pytest
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.operators import context as C
from ruleloom.operators import runs as V
from ruleloom.sources import artifacts as A
from ruleloom.streaming import findings as live

GOOD = {"rule_ids": ["a", "b"], "witness": "w", "unsat_reason": "u", "context_resolution": "c"}
CASES = {
    "[]": None,
    json.dumps([GOOD]): None,
    json.dumps([GOOD])[:-1] + ",]": None,
    json.dumps([GOOD])[:-1]: "not a complete JSON array",
    json.dumps(GOOD): "not an array",
    json.dumps([GOOD | {"x": 1}]): "not exactly the four fields",
    json.dumps([{k: v for k, v in GOOD.items() if k != "witness"}]): "not exactly the four fields",
    json.dumps([GOOD | {"witness": 5}]): "not exactly the four fields",
    json.dumps([GOOD | {"rule_ids": ["a", "a"]}]): "not two different rules of the group",
    json.dumps([GOOD | {"rule_ids": ["a", "z"]}]): "not two different rules of the group",
    json.dumps([GOOD | {"rule_ids": ["a", "b", "c"]}]): "not two different rules of the group",
    json.dumps([GOOD | {"witness": " \n"}]): "an empty text",
}


def test_parsing(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = V.parsed(F.col("t"), F.array(*map(F.lit, "abc")))
    assert {r.t: r.error for r in df.select("t", got["error"].alias("error")).collect()} == CASES
    assert df.select(got["repaired"].alias("n")).agg(F.sum("n")).first()[0] == 1


def _raw(spark, path, rows):
    path.mkdir(exist_ok=True)
    (path / "raw.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def result(i, text, kind="succeeded", stop="end_turn"):
    return {"custom_id": i, "result": {"type": kind, "message": {"stop_reason": stop, "content": [{"type": "text", "text": text}], "usage": {"output_tokens": 3}}}, "received": "2024-01-01T00:00:00"}


def test_outcomes_and_stream(spark, tmp_path):
    rows = [result("r1", json.dumps([GOOD, GOOD])), result("r2", "[]", stop="max_tokens"), result("r3", "[]", kind="expired")]
    path = _raw(spark, tmp_path / "in", rows)
    groups = spark.createDataFrame([(f"r{i}", ["a", "b"]) for i in range(1, 5)], "custom_id string, rule_ids array<string>")
    out = {r.custom_id: (r.status, r.error) for r in V.outcomes(groups, A.read_lines(spark, path, schema.RAW_RESULT)).collect()}
    assert out == {"r1": ("succeeded", None), "r2": ("failed", "not finished: max_tokens"), "r3": ("failed", "expired"), "r4": ("failed", "missing")}
    q = live.arriving_findings(live.arriving_results(spark, path), groups).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.custom_id, r.pair) for r in spark.table("found").collect()] == [("r1", "a|b")]


def test_new_by_pass(spark):
    f = spark.createDataFrame([("g", 1, "p", "x"), ("g", 2, "p", "y"), ("g", 2, "p", "x"), ("g", 3, "q", "x"), ("h", 1, "p", "x")], "group_key string, pass int, pair string, variant string")
    assert sorted(map(tuple, V.new_by_pass(f).collect())) == [("g", 1, 1, 1, 1), ("g", 2, 2, 0, 1), ("g", 3, 1, 1, 1), ("h", 1, 1, 1, 1)]


def test_quotes_across_passages(spark):
    p = spark.createDataFrame([("s", "ctx1", "first part"), ("s", "ctx2", "second part"), ("s", "ctx3", "first part")], "spec string, passage string, text string")
    texts, spans = C.searchable(p)
    q = spark.createDataFrame([("s", "part second"), ("s", "first part"), ("s", "absent")], "spec string, quote string")
    got = sorted((r.quote, r.passage) for r in C.quote_passages(q, texts, spans).collect())
    assert got == [("first part", "ctx1"), ("first part", "ctx3"), ("part second", "ctx1"), ("part second", "ctx2")]


def test_template_needs_every_slot():
    with pytest.raises(ValueError):
        C.filled("a $b", {})


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string")
    assert json.loads(A.pretty(df).first().value) == {"a": "é", "b": None}
    A.publish(df, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        A.publish(df, str(tmp_path / "out"))
    assert A.claim(spark, str(tmp_path / "ledger"), "x") and not A.claim(spark, str(tmp_path / "ledger"), "y")
    assert A.read_optional(spark, str(tmp_path / "none.json"), "a string").count() == 0
    with pytest.raises(ValueError):
        A.inside("/runs/1", "../2/x")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/b.json").write_text(json.dumps({"fragments": [{"records": [{"id": "r1", "trigger": "late"}]}]}))
    (tmp_path / "f/a.json").write_text(json.dumps({"records": [{"id": "r1", "trigger": "t"}, {"id": "r2"}]}))
    assert sorted((r.file, r.id) for r in A.read_fragments(spark, str(tmp_path / "f")).collect()) == [("a.json", "r1"), ("a.json", "r2"), ("b.json", "r1")]
    assert A.content_hashes(spark, str(tmp_path / "f")).count() == 2


def test_overlapping_quotes_are_all_found_and_texts_read_once(spark, monkeypatch):
    from ruleloom.operators import context as C

    texts = spark.createDataFrame([("a", "ababab aba"), ("a", "xaba"), ("b", "aba"), ("c", None), ("d", "")], "spec string, text string")
    quotes = spark.createDataFrame([("a", "aba"), ("a", "ab"), ("a", "aba"), ("a", ""), ("a", None), ("b", "b"), ("b", "nowhere"), ("c", "x"), (None, "aba")], "spec string, quote string")

    def plain():
        out = []
        for s, t in [tuple(r) for r in texts.collect()]:
            for q in {q for s2, q in map(tuple, quotes.collect()) if s2 == s and q}:
                out += [(s, q, i) for i in range(len(t or "")) if (t or "").startswith(q, i)]
        return sorted(out)

    for size in (C.QUOTES, 1):
        monkeypatch.setattr(C, "QUOTES", size)
        assert sorted(map(tuple, C.occurrences(quotes, texts).collect())) == plain() and len(plain()) > 8
    named = texts.withColumn("name", F.concat("spec", F.lit("!")))
    assert sorted(map(tuple, C.held_quotes(quotes, named, "name").collect())) == [("a", "ab", "a!"), ("a", "aba", "a!"), ("b", "b", "b!")]


def test_evidence_of_another_document_is_no_evidence(spark):
    from ruleloom.operators import assembly as A

    items = spark.createDataFrame([(1, "x", "#only_in_2", "a quote long enough"), (2, "y", "#only_in_2", "a quote long enough"), (1, "z", "[^aa22]", "a quote long enough"), (1, "w", "[^aa11]", "short"), (1, "v", "[^aa11]", "a quote [...] long ﬁ")], "spec int, subject string, where string, quote string")
    anchors = spark.createDataFrame([(2, "only_in_2")], "spec int, slug string")
    rules = spark.createDataFrame([(1, "aa11"), (2, "aa22")], "spec int, rule string")
    documents = spark.createDataFrame([(1, "this is a quote long enough and a quote long fi"), (2, "a quote long enough")], "spec int, text string")
    good, bad = A.kept_items(items, anchors, rules, documents)
    assert sorted(r.subject for r in good.collect()) == ["v", "y"]
    assert sorted((r.subject, r.reason) for r in bad.collect()) == [("w", "quote"), ("x", "where"), ("z", "where")]


def test_repeated_tags_name_their_document(spark):
    from ruleloom.operators import checks as K

    before = spark.createDataFrame([(1, "a b"), (2, "a b")], "spec int, text string")
    after = spark.createDataFrame([(1, "a[^ab12] b[^ab12]"), (2, "a[^ab12] b[^eg001][^eg001]")], "spec int, text string")
    assert sorted(map(tuple, K.annotation(before, after).collect())) == [("repeated example", "2", "eg001"), ("repeated rule", "1", "ab12")]


def test_json_documents_share_files_and_keep_every_text(spark, tmp_path):
    texts = ["a", "", "two\nlines\r\n", "\x1e in a text \x1e\n{", "\u2028 \x85 é 😀", '"quoted" \\ }', " "] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    A.write_documents(docs.select(F.to_json(F.struct("doc_id", "text"), {"pretty": "true"}).alias("value")), str(tmp_path / "d"))
    assert len(list((tmp_path / "d").glob("part-*"))) <= 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = A.read_documents(spark, str(tmp_path / "d"), "doc_id long, text string")
        assert got.rdd.getNumPartitions() > 3 and sorted(map(tuple, got.collect())) == list(enumerate(texts))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "one" / "s").mkdir(parents=True)
    docs.where("doc_id < 50").write.parquet(str(tmp_path / "one" / "s" / "documents.parquet"))
    from ruleloom.plans import artifacts as plans

    read = plans.json_documents(spark, str(tmp_path / "one" / "s"))
    assert read.count() == 50 and len({r.f for r in read.select(F.input_file_name().alias("f")).collect()}) <= 3
