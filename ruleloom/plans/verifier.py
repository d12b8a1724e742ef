"""Queries over packets, requests, results and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import checks as K
from ruleloom.operators import context as C
from ruleloom.operators import lexing as L
from ruleloom.operators import runs as V

from . import shim
from .lexical import big

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, shimmed: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (shim.SQL if shimmed else "") + sql
        return f

    return add


@query("SELECT doc_id AS spec, slug AS anchor, count(*)::BIGINT AS n FROM (SELECT DISTINCT t.doc_id, t.slug, p.first FROM T t JOIN T u ON u.doc_id = t.doc_id AND list_contains(string_split(t.path, '/'), u.slug) JOIN (SELECT doc_id, owner, min(ln) AS first FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM (SELECT r.*, (coalesce(lag(ln) OVER (PARTITION BY doc_id ORDER BY ln), -1) <> ln - 1)::INT AS new FROM R r)) GROUP BY doc_id, run, owner) p ON p.doc_id = u.doc_id AND p.owner = u.ln) GROUP BY ALL")
def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shim.marked_lines(spark, sf_dir)
    tree = L.sections(lines)
    found = C.passages_of_sections(L.passages(lines, L.example_bodies(lines), tree), tree)
    return found.groupBy("spec", "anchor").agg(F.count("*").alias("n"))


@query("SELECT l.doc_id AS spec, 'e' || l.doc_id || '-' || l.ln || 'x b' || l.doc_id || '-' || (l.ln + 1) || 'x' AS quote, p.ln::BIGINT AS passage FROM L l JOIN E e USING (doc_id) JOIN L p ON p.doc_id = l.doc_id AND p.ln IN (l.ln, l.ln + 1) WHERE l.ln < e.last")
def quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a passage; a quote that runs over the end of one into the next is in both."""
    name = lambda letter, by: F.concat(F.lit(letter), "spec", F.lit("-"), F.col("ln") + by, F.lit("x"))
    lines = shim.plain_lines(spark, sf_dir)
    passages = lines.select("spec", F.lpad(F.col("ln").cast("string"), 9, "0").alias("passage"), F.concat(name("b", 0), F.lit(" "), "line", F.lit(" "), name("e", 0)).alias("text"))
    texts, spans = C.searchable(passages)
    quotes = lines.select("spec", F.concat(name("e", 0), F.lit(" "), name("b", 1)).alias("quote"))
    return C.quote_passages(quotes, texts, spans).select("spec", "quote", F.col("passage").cast("long").alias("passage"))


@query("SELECT (doc_id % 50)::BIGINT AS unit, min('ctx' || doc_id || '-' || ln) AS passage, count(*)::BIGINT AS places FROM L WHERE line <> '' GROUP BY doc_id % 50, line")
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shim.plain_lines(spark, sf_dir).where("line <> ''").select((F.col("spec") % 50).alias("unit"), F.concat(F.lit("ctx"), "spec", F.lit("-"), "ln").alias("passage"), F.col("ln").alias("first"), F.col("ln").alias("last"), F.col("line").alias("text"), F.lit(False).alias("commentary"))
    kept, _ = C.canonical_passages(p.select("unit", F.lit("r").alias("rule"), "passage"), p.drop("unit"))
    return kept.select("unit", "passage", F.size("sources").cast("long").alias("places"))


@query("SELECT u.doc_id AS unit, u.label AS passage, u.uses, u.uses = r.n AS common FROM (SELECT doc_id, label, count(DISTINCT id)::BIGINT AS uses FROM B GROUP BY ALL) u JOIN (SELECT doc_id, count(DISTINCT id)::BIGINT AS n FROM B GROUP BY ALL) r ON r.doc_id = u.doc_id")
def common_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = shim.labels(spark, sf_dir).select(F.col("spec").alias("unit"), F.col("id").alias("rule"), F.col("label").alias("passage"))
    split = C.common_and_own(refs).groupBy("unit", "passage").agg(F.count_if(F.col("rule").isNotNull()).alias("own"), F.count_if(F.col("rule").isNull()).alias("all"))
    total = refs.groupBy("unit").agg(F.countDistinct("rule").alias("rules"))
    return split.join(total, "unit").select("unit", "passage", F.when(F.col("all") > 0, F.col("rules")).otherwise(F.col("own")).alias("uses"), (F.col("all") > 0).alias("common"))


@query("SELECT doc_id AS unit, count(*)::BIGINT AS relations, sum(notes)::BIGINT AS notes FROM (SELECT doc_id, least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT CASE WHEN ln % 2 = 0 THEN 'n' || ln % 3 END) AS notes FROM X GROUP BY ALL) GROUP BY doc_id")
def relation_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = shim.citation_edges(spark, sf_dir)
    note = F.when(F.col("ln") % 2 == 0, F.concat(F.lit("n"), F.col("ln") % 3)).otherwise(F.lit(C.PLAIN_NOTES[0]))
    none = F.lit(None).cast("string")
    e = x.select(F.col("spec").alias("unit"), "src", "dst", F.lit("cross_reference").alias("relation"), none.alias("subtype"), none.alias("source"), none.alias("via"), none.alias("evidence"), note.alias("note"))
    return C.collapsed_relations(e).groupBy("unit").agg(F.count("*").alias("relations"), F.sum(F.size("notes")).cast("long").alias("notes"))


@query("SELECT doc_id AS unit, 'Rules of ' || doc_id || ':' || chr(10) || string_agg('- ' || id, chr(10) ORDER BY ln) || chr(10) || 'Context: None.' AS prompt FROM R GROUP BY doc_id")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "id"))), lambda x: F.concat(F.lit("- "), x["id"])), "\n")
    units = shim.rules(spark, sf_dir).groupBy("spec").agg(listed.alias("rules"))
    slots = {"unit": F.col("spec").cast("string"), "rules": F.col("rules"), "context": C.shared_context(F.lit(""))}
    return units.select(F.col("spec").alias("unit"), C.filled("Rules of $unit:\n$rules\nContext: $context", slots).alias("prompt"))


@query("SELECT doc_id AS unit, string_agg(CASE WHEN new AND path IS NOT NULL THEN 'Section: ' || replace(path, '/', ' / ') || chr(10) ELSE '' END || '[' || pid || '] p ' || line || '.', chr(10) || chr(10) ORDER BY pid) AS text FROM (SELECT *, lpad(ln::VARCHAR, 6, '0') AS pid, lag(path) OVER (PARTITION BY doc_id ORDER BY ln) IS DISTINCT FROM path OR lag(ln) OVER (PARTITION BY doc_id ORDER BY ln) IS NULL AS new FROM R) GROUP BY doc_id")
def passage_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.rules(spark, sf_dir).select(F.col("spec").alias("unit"), F.lpad(F.col("ln").cast("string"), 6, "0").alias("passage"), F.col("sections").alias("path"), "ln")
    text = shim.plain_lines(spark, sf_dir).select(F.col("spec").alias("unit"), "ln", F.concat(F.lit("p "), "line", F.lit(".")).alias("text"))
    return C.rendered_passages(r.join(text, ["unit", "ln"]).drop("ln"))


@query("SELECT doc_id || '-pass-' || lpad(p::VARCHAR, 3, '0') AS custom_id, p::BIGINT AS pass FROM documents, range(1, 6) s(p)", shimmed=False)
def repeat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shim.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("custom_id"))
    return V.repeated(base).select("custom_id", *big("pass"))


@query("SELECT doc_id::VARCHAR AS custom_id, h AS headroom, c - i - o - h AS remaining, coalesce(o > 0 AND o <= m AND c - i - o - h >= 0, false) AS fits FROM (SELECT *, greatest(2048, (i + 99) // 100)::BIGINT AS h FROM (SELECT doc_id, (n_chars * 40)::BIGINT AS i, (doc_id % 4 * 1000)::BIGINT AS o, CASE doc_id % 3 WHEN 0 THEN 200000 WHEN 1 THEN 150000 END::BIGINT AS c, CASE doc_id % 3 WHEN 0 THEN 2500 WHEN 1 THEN 9000 END::BIGINT AS m FROM documents))", shimmed=False)
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shim.table(spark, sf_dir, "documents")
    requests = docs.select(F.col("doc_id").cast("string").alias("custom_id"), F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"), (F.col("n_chars") * 40).alias("input_tokens"), (F.col("doc_id") % 4 * 1000).alias("output_tokens"))
    limits = spark.createDataFrame([("m0", 200000, 2500)], "model string, context long, most_output long")
    fallback = spark.createDataFrame([("m0", 1, 1), ("m1", 150000, 9000)], "model string, context long, most_output long")
    return V.capacity(requests, limits, fallback).select("custom_id", "headroom", "remaining", "fits")


@query("SELECT count(DISTINCT source || '|' || lang)::BIGINT AS payloads, count(*)::BIGINT AS requests FROM documents", shimmed=False)
def payload_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shim.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("custom_id"), F.struct("source", "lang").alias("params"))
    return V.distinct_payloads(docs).agg(F.count("*").alias("payloads"), F.sum(F.size("requests")).cast("long").alias("requests"))


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A request for each document, and results of ten kinds by doc_id % 10; kind 9 has none."""
    docs = shim.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("k"))
    one = '{{"rule_ids": ["a", "{b}"], "witness": " w  {n}", "unsat_reason": "u", "context_resolution": "{c}"{more}}}'
    text = {0: "[]", 1: "[" + one.format(b="b", n="1", c="c", more="") + "]", 2: "[" + one.format(b="b", n="x, ]", c="c", more=",") + " , ]", 3: "[" + one.format(b="b", n="1", c="c", more=""), 4: "[" + one.format(b="b", n="1", c="c", more=', "x": 1') + "]", 5: "[" + one.format(b="a", n="1", c="c", more="") + "]", 6: "[" + one.format(b="z", n="1", c="c", more="") + "]", 7: "[" + one.format(b="b", n="1", c=" ", more="") + "]", 8: "[" + one.format(b="b", n="1", c="c", more="") + "]"}
    said = F.lit(None).cast("string")
    for k, v in text.items():
        said = F.when(F.col("k") == k, v).otherwise(said)
    stop = F.when(F.col("k") == 8, "max_tokens").otherwise("end_turn")
    content = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), said.alias("text")))
    usage = F.map_from_arrays(F.array(F.lit("output_tokens")), F.array(F.lit(1).cast("long")))
    message = F.struct(stop.alias("stop_reason"), content.alias("content"), usage.alias("usage"))
    raw = docs.where("k <> 9").select(F.col("doc_id").cast("string").alias("custom_id"), F.struct(F.when(F.col("doc_id") % 70 == 0, "errored").otherwise("succeeded").alias("type"), message.alias("message")).alias("result"))
    groups = docs.select(F.col("doc_id").cast("string").alias("custom_id"), (F.col("doc_id") % 7).alias("group_key"), F.array(F.lit("a"), F.lit("b")).alias("rule_ids"))
    return groups, raw


@query("""SELECT CASE WHEN k = 9 THEN 'missing' WHEN doc_id % 70 = 0 THEN 'errored' WHEN k = 8 THEN 'not finished: max_tokens' WHEN k = 3 THEN 'not a complete JSON array' WHEN k = 4 THEN 'not exactly the four fields' WHEN k IN (5, 6) THEN 'not two different rules of the group' WHEN k = 7 THEN 'an empty text' END AS error,
count(*)::BIGINT AS n, sum(CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END)::BIGINT AS findings, sum(CASE WHEN k = 2 THEN 2 ELSE 0 END)::BIGINT AS repaired FROM (SELECT doc_id, doc_id % 10 AS k FROM documents) GROUP BY ALL""", shimmed=False)
def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.outcomes(*_raw(spark, sf_dir))
    return out.groupBy("error").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("findings"), F.lit(0))).cast("long").alias("findings"), F.sum("repaired").alias("repaired"))


@query("SELECT doc_id % 7 AS group_key, 'a|b' AS pair, CASE WHEN doc_id % 10 = 1 THEN 'w 1' ELSE 'w x, ]' END AS witness, 'u' AS unsat_reason, 'c' AS context_resolution, count(*)::BIGINT AS n FROM documents WHERE doc_id % 10 IN (1, 2) GROUP BY ALL", shimmed=False)
def findings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.outcomes(*_raw(spark, sf_dir)).select("group_key", F.explode("findings").alias("f")).select("group_key", V.finding_key(F.col("f")).alias("key"))
    by = ["group_key", F.array_join("key.pair", "|").alias("pair"), "key.witness", "key.unsat_reason", "key.context_resolution"]
    return out.groupBy(*by).agg(F.count("*").alias("n"))


@query("SELECT problem, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'repeated' ELSE 'unexpected' END AS problem FROM documents WHERE doc_id % 10 <> 9 AND (doc_id % 3 = 0 OR doc_id % 2 = 0)) GROUP BY ALL", shimmed=False)
def unexpected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, raw = _raw(spark, sf_dir)
    raw = raw.unionByName(raw.where("custom_id % 3 = 0"))
    return V.unexpected(groups.where("custom_id % 3 = 0 or custom_id % 2 <> 0"), raw).groupBy("problem").agg(F.count("*").alias("n"))


_FOUND = "(SELECT conv_id % 7 AS group_key, turn AS pass, length(text) % 50 AS pair, text AS variant FROM conversations)"


@query(f"SELECT group_key, pass, count(*)::BIGINT AS returned, count(DISTINCT CASE WHEN fp = pass THEN pair END)::BIGINT AS new_pairs, count(DISTINCT CASE WHEN fv = pass THEN pair || '|' || variant END)::BIGINT AS new_variants FROM (SELECT *, min(pass) OVER (PARTITION BY group_key, pair) AS fp, min(pass) OVER (PARTITION BY group_key, pair, variant) AS fv FROM {_FOUND}) GROUP BY ALL", shimmed=False)
def new_pairs_by_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shim.table(spark, sf_dir, "conversations")
    found = c.select((F.col("conv_id") % 7).alias("group_key"), F.col("turn").alias("pass"), (F.length("text") % 50).alias("pair"), F.col("text").alias("variant"))
    return V.new_by_pass(found)


@query(f"SELECT count(*)::BIGINT AS attempted, sum((turn % 5 <> 0)::INT)::BIGINT AS succeeded, sum((turn % 5 = 0)::INT)::BIGINT AS failed, (SELECT sum(n) FROM (SELECT count(DISTINCT pair) AS n FROM {_FOUND} GROUP BY group_key))::BIGINT AS pairs, (SELECT count(*) FROM (SELECT DISTINCT group_key, pair, variant FROM {_FOUND}))::BIGINT AS variants FROM conversations", shimmed=False)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shim.table(spark, sf_dir, "conversations")
    found = c.select((F.col("conv_id") % 7).alias("group_key"), (F.length("text") % 50).alias("pair"), F.col("text").alias("variant"))
    return V.run_totals(c.select(F.when(F.col("turn") % 5 == 0, "failed").otherwise("succeeded").alias("status")), found)


@query("SELECT conv_id AS group_key, array_to_string(list_sort(list(turn)), ',') AS passes FROM conversations GROUP BY conv_id HAVING list_sort(list(turn::BIGINT)) <> [1, 2, 3]", shimmed=False)
def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shim.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_key"), F.col("turn").cast("int").alias("pass"))
    return V.incomplete_groups(c, 3).select("group_key", F.array_join("passes", ",").alias("passes"))


@query("SELECT value, CASE WHEN value IN ('applies', 'not_applicable', 'unconditional_or_unspecified') THEN value WHEN length(value) <= 40 THEN 'applies' ELSE 'unconditional_or_unspecified' END AS facet, CASE WHEN value NOT IN ('applies', 'not_applicable', 'unconditional_or_unspecified') AND length(value) <= 40 THEN value END AS specific FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'applies' WHEN 1 THEN p_name || repeat('x', p_size) WHEN 2 THEN 'not_applicable' END AS value FROM part)", shimmed=False)
def facet_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("p_size") % 4
    v = shim.table(spark, sf_dir, "part").select(F.when(r == 0, "applies").when(r == 1, F.concat("p_name", F.repeat(F.lit("x"), F.col("p_size")))).when(r == 2, "not_applicable").alias("value"))
    value, specific = C.facet(F.col("value"), "age")
    return v.select("value", value.alias("facet"), specific.alias("specific"))


@query("SELECT problem, count(*)::BIGINT AS n FROM (SELECT CASE doc_id % 6 WHEN 1 THEN 'missing' WHEN 2 THEN 'changed' WHEN 3 THEN 'unlisted' END AS problem FROM documents) WHERE problem IS NOT NULL GROUP BY problem", shimmed=False)
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shim.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 6).alias("r"), F.sha2("text", 256).alias("sha256"))
    files = d.where("r <> 1").select("name", F.when(F.col("r") == 2, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256")).alias("sha256"))
    return K.hash_problems(d.where("r <> 3").select("name", "sha256"), files).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT problem, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'repeated' WHEN doc_id % 5 = 1 THEN 'too long' WHEN doc_id % 5 = 2 THEN 'unsafe' END AS problem FROM documents) WHERE problem IS NOT NULL GROUP BY problem", shimmed=False)
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 5
    d = shim.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), "doc_id", F.when(r == 1, F.repeat(F.lit("x"), F.lit(64))).when(r == 2, " y").otherwise(F.lit(""))).alias("custom_id"))
    return V.request_problems(d.unionByName(d.where("doc_id % 5 = 0"))).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT c.coder::BIGINT AS coder, n_name AS chapter, ((n_nationkey - c.coder + 25) % 25)::BIGINT AS place FROM nation, range(0, 4) c(coder)", shimmed=False)
def chapter_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = shim.table(spark, sf_dir, "nation").select(F.col("n_name").alias("chapter"), F.col("n_nationkey").alias("n"))
    return C.rotated(chapters, 4).select(*big("coder"), "chapter", *big("place"))


@query("SELECT doc_id, md5(text || CASE WHEN k = 'second' THEN '!' ELSE '' END) AS digest, k AS only_in FROM documents, (VALUES ('first'), ('second')) s(k) WHERE doc_id % 50 = 7 AND text IS NOT NULL UNION ALL SELECT doc_id, md5(text), 'second' FROM documents WHERE doc_id % 50 = 8 AND text IS NOT NULL", shimmed=False)
def rerun_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over all documents with other texts for some and some documents twice."""
    t = shim.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "lang")
    other = t.withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    found = K.rerun_difference(t, other.unionByName(t.where("doc_id % 50 = 8")))
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "only_in")
