"""Queries for large inputs: files read in byte ranges, documents by chunks of lines, many quotes at once, forms in all scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.operators import context as C
from ruleloom.operators import labels as S
from ruleloom.operators import lexing as L
from ruleloom.operators import maintain as M
from ruleloom.operators import rules as R
from ruleloom.operators.dealing import cut
from ruleloom.sources import artifacts as IO
from ruleloom.sources.lines import lines_from_files

from . import shim
from .lexical import ORACLES as LEXICAL
from .lexical import big

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Lines of a chunk in the queries; real documents would take tens of thousands.
CHUNK = 16


def query(sql: str | None = None, shimmed: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (shim.SQL if shimmed else "") + sql
        return f

    return add


#: A document's line feeds become one of these line ends, by its id. Fixed values.
ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
_ENDS = ", ".join(f"chr({ord(e)})" if len(e) == 1 else "chr(13) || chr(10)" for e in ENDS)


@query(
    f"""SELECT b AS file, row_number() OVER (PARTITION BY b ORDER BY doc_id, i)::BIGINT AS ln, md5(line) AS line FROM
(SELECT doc_id, doc_id % 20 AS b, unnest(a) AS line, generate_subscripts(a, 1) AS i, len(a) AS n FROM (SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), list_extract([{_ENDS}], (doc_id % {len(ENDS)} + 1)::INT)) || chr(10),
'\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) AS a FROM documents WHERE text IS NOT NULL)) WHERE i < n""",
    shimmed=False,
)
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as twenty files, a document's line ends of one kind, read in byte ranges and numbered."""
    path = IO.inside(shim.fresh_folder(spark), "texts")
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % len(ENDS) + 1).cast("int"))
    docs = shim.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 20).alias("b"), F.replace(F.regexp_replace("text", r"\r\n?", "\n"), F.lit("\n"), end).alias("value"))
    IO.write_text(docs.repartition(20, "b").sortWithinPartitions("b", "doc_id"), path, by="b")
    lines = lines_from_files(spark, path, "file_path")
    return lines.select(F.regexp_extract("spec", r"b=(\d+)", 1).cast("long").alias("file"), "ln", F.md5(F.col("line").cast("binary")).alias("line"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("ln") % 11 == 3, "  ~~~ ").when(F.col("ln") % 7 == 2, "\t```text ").otherwise("p "), "line")
    return shim.plain_lines(spark, sf_dir).withColumn("line", line)


@query(LEXICAL["nested_fences"].removeprefix(shim.SQL))
def chunked_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As nested_fences, by chunks of lines."""
    shim.shared_folder(spark)
    return L.fences(_nested(spark, sf_dir), CHUNK).where("fenced").groupBy("spec").agg(F.count("*").alias("fenced"))


@query("""SELECT t.doc_id AS spec, t.ln::BIGINT AS header_line, t.path, t.authority,
coalesce((SELECT min(n.ln) - 1 FROM H n WHERE n.doc_id = t.doc_id AND n.ln > t.ln AND n.level <= t.level), e.last)::BIGINT AS end_line,
(SELECT count(*) FROM L l WHERE l.doc_id = t.doc_id AND l.ln >= t.ln AND NOT EXISTS (SELECT 1 FROM H h WHERE h.doc_id = l.doc_id AND h.ln > t.ln AND h.ln <= l.ln))::BIGINT AS own_lines FROM T t JOIN E e ON e.doc_id = t.doc_id""")
def chunked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with paths and inheritance, and each section's own lines, by chunks of lines."""
    shim.shared_folder(spark)
    lines = shim.marked_lines(spark, sf_dir)
    tree = L.sections(lines, CHUNK)
    own = L.innermost(lines, tree, CHUNK).groupBy("spec", F.col("section").alias("index")).agg(F.count("*").alias("own_lines"))
    return tree.join(own, ["spec", "index"]).select("spec", *big("header_line"), F.array_join("path", "/").alias("path"), "authority", *big("end_line"), "own_lines")


@query(LEXICAL["blocks_islands"].removeprefix(shim.SQL))
def chunked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As blocks_islands, by chunks of lines."""
    shim.shared_folder(spark)
    return L.blocks(shim.marked_lines(spark, sf_dir), CHUNK)[0].select("spec", *big("first", "last"), F.length("text").cast("long").alias("characters"))


@query(
    r"""WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS a, generate_subscripts(string_split(lower(text), ''), 1) AS i FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, i, unnest([a || b, a || b || c, a || b || c || d]) AS quote FROM g)
SELECT doc_id AS spec, quote, count(*)::BIGINT AS n, sum(i)::BIGINT AS places FROM q WHERE quote IN ('the', 'he', 'ere', 'anan', 'er', 'ch', 'nen', 'ee') GROUP BY ALL""",
    shimmed=False,
)
def quote_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of short strings, some of which overlap, in the whole texts."""
    texts = shim.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("spec"), F.lower("text").alias("text"))
    some = texts.select("spec", F.explode(F.array(*map(F.lit, ("the", "he", "ere", "anan", "er", "ch", "nen", "ee")))).alias("quote"))
    return C.occurrences(some, texts).groupBy("spec", "quote").agg(F.count("*").alias("n"), F.sum(F.col("start") + 1).alias("places"))


@query("""SELECT doc_id AS spec, ln::BIGINT AS ln, kind, value FROM (SELECT doc_id, ln, CASE ln % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'anchor' WHEN 2 THEN 'link' WHEN 3 THEN 'item' WHEN 4 THEN 'commentary' ELSE 'marker' END AS kind,
CASE ln % 6 WHEN 0 THEN 't' || ln WHEN 1 THEN 'résumé' || ln WHEN 2 THEN 'été' || ln WHEN 3 THEN 'item' WHEN 4 THEN 'head' ELSE 'ñ' || lpad((ln % 1000)::VARCHAR, 3, '0') END AS value FROM L)""")
def forms_of_all_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents behind a form with a letter or a blank beyond ASCII."""
    k, ln = F.col("ln") % 6, F.col("ln").cast("string")
    blank = F.lit(" ")
    form = (
        F.when(k == 0, F.concat(F.lit("#"), blank, F.lit("t"), ln, blank)).when(k == 1, F.concat(F.lit("## x {#résumé"), ln, F.lit("}"))).when(k == 2, F.concat(F.lit("[x](#été"), ln, F.lit(") "), "line"))
        .when(k == 3, F.concat(F.lit("1."), blank, "line")).when(k == 4, F.concat(blank, F.lit('!!! meta "Commentary" '), "line")).otherwise(F.concat(F.lit("[^ñ"), F.lpad((F.col("ln") % 1000).cast("string"), 3, "0"), F.lit("]")))
    )
    lines = shim.plain_lines(spark, sf_dir).withColumn("line", form).withColumn("fenced", F.lit(False))
    heads = L.headings(lines).select("spec", "ln", F.when(k == 0, "heading").otherwise("anchor").alias("kind"), F.col("slug").alias("value"))
    kind = lambda df, name, value: df.select("spec", "ln", F.lit(name).alias("kind"), value.alias("value"))
    found = [kind(L.links(lines).where(k == 2), "link", F.col("anchor")), kind(L.markers(lines).where(k == 5), "marker", F.col("rule"))]
    found += [kind(lines.where((k == 3) & F.col("line").rlike(T.LIST_ITEM)), "item", F.lit("item")), kind(lines.where(F.col("line").rlike(T.COMMENTARY)), "commentary", F.lit("head"))]
    for df in found:
        heads = heads.unionByName(df)
    return heads.select("spec", *big("ln"), "kind", "value")


@query("""SELECT id AS rule, problem FROM (SELECT id, authority, ln % 5 AS k, CASE WHEN ln % 5 = 1 THEN 'unknown rule' WHEN authority IS NOT NULL THEN 'redundant' WHEN ln % 5 = 2 THEN 'unknown authority' WHEN ln % 5 = 3 THEN 'no reason' END AS problem FROM
(SELECT CASE WHEN ln % 5 = 1 THEN 'no:' || id ELSE id END AS id, ln, CASE WHEN ln % 5 = 1 THEN NULL ELSE authority END AS authority FROM R)) WHERE problem IS NOT NULL""")
def override_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override for every rule, some of rules that aren't there, some of no known authority, some without a reason."""
    r, k = shim.rules(spark, sf_dir).select("ln", F.col("id").alias("rule"), "authority"), F.col("ln") % 5
    overrides = r.select(F.when(k == 1, F.concat(F.lit("no:"), "rule")).otherwise(F.col("rule")).alias("rule"), F.when(k == 2, "king").otherwise("user").alias("authority"), F.when(k == 3, " ").otherwise("said so").alias("reason"))
    return R.override_problems(r.select("rule", "authority"), overrides)


@query("SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM B WHERE ln % 3 <> 0 UNION SELECT id, label FROM B WHERE ln % 3 <> 1 OR label = 'k0') GROUP BY id")
def united_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellers' labels of all rules, united and committed."""
    b = shim.labels(spark, sf_dir)
    both = S.united(b.where("ln % 3 <> 0"), b.where("ln % 3 <> 1 OR label = 'k0'"))
    return both.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


@query("SELECT count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS characters, 'second' AS state FROM documents", shimmed=False)
def json_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's state as one document, replaced in place by a later one; the folder holds that alone."""
    folder = shim.fresh_folder(spark)
    totals = shim.table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum(F.length("text")).cast("long").alias("characters"))
    for state in ("first", "second"):
        IO.replace_json(totals.withColumn("state", F.lit(state)), f"{folder}/state.json")
    return IO.read_json(spark, folder, "documents long, characters long, state string")


@query("""SELECT doc_id AS spec, 'm' || lpad(((doc_id * 31 + ln * 7) % 1000)::VARCHAR, 3, '0') AS rule, ln::BIGINT AS ln, authority, path FROM R""")
def rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each marker with the authority and sections that the text gives it."""
    lines = shim.marked_lines(spark, sf_dir)
    index = R.rule_index(L.markers(lines), lines, L.sections(lines))
    return index.select("spec", "rule", *big("ln"), "authority", F.when(F.size("sections") > 0, F.array_join("sections", "/")).alias("path"))


@query("""SELECT spec, relation, key, count(*) * (count(*) - 1) AS n FROM (SELECT doc_id AS spec, 'same_section' AS relation, CASE WHEN doc_id % 5 = 2 AND ln % 4 = 1 THEN 'moved' ELSE path END AS key, id FROM R WHERE path IS NOT NULL AND NOT (doc_id % 5 = 0 AND ln % 3 = 0)
UNION ALL SELECT doc_id, 'shares_dimension', label, id FROM B WHERE NOT (doc_id % 5 = 0 AND ln % 3 = 0)) GROUP BY ALL HAVING count(*) > 1""")
def maintained_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one section or label in all documents, written, and then brought up to date after rules of some documents went or moved."""
    shim.shared_folder(spark)
    r = cut(shim.rules(spark, sf_dir).select("spec", "ln", "id", "path"))
    sections = r.where("path <> ''").select("spec", "ln", "id", F.lit("same_section").alias("relation"), F.col("path").alias("key"))
    old = sections.unionByName(shim.labels_of(r).select("spec", "ln", "id", F.lit("shares_dimension").alias("relation"), F.col("label").alias("key")))
    moved = (F.col("relation") == "same_section") & (F.col("spec") % 5 == 2) & (F.col("ln") % 4 == 1)
    new = old.where(~((F.col("spec") % 5 == 0) & (F.col("ln") % 3 == 0))).withColumn("key", F.when(moved, "moved").otherwise(F.col("key")))
    path, keys = shim.fresh_folder(spark), ["spec", "relation", "key"]
    M.write_graph(old, path, keys)
    M.update_graph(path, old, new, keys)
    return spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("n"))
