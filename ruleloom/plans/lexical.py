"""Queries over lines, sections, blocks, markers and rule records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import text as T
from ruleloom.operators import checks as K
from ruleloom.operators import lexing as L
from ruleloom.operators import rules as R

from . import shim

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, shimmed: bool = True):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (shim.SQL if shimmed else "") + sql
        return f

    return add


#: A rule's Markdown line in SQL.
_MARKED = "'p ' || line || ' [^m' || lpad(((doc_id * 31 + ln * 7) % 1000)::VARCHAR, 3, '0') || ']'"


def big(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


@query("SELECT doc_id AS spec, count(*)::BIGINT AS n, sum(length(line))::BIGINT AS characters FROM L GROUP BY doc_id")
def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shim.plain_lines(spark, sf_dir).groupBy("spec").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("characters"))


@query("SELECT doc_id AS spec, ln::BIGINT AS ln, level::BIGINT AS level, slug, 'T' || ln AS title, own AS own_authority FROM H")
def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.headings(shim.marked_lines(spark, sf_dir)).select("spec", *big("ln", "level"), "slug", "title", "own_authority")


@query("SELECT path, authority, count(*)::BIGINT AS n FROM T GROUP BY path, authority")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sections(shim.marked_lines(spark, sf_dir)).groupBy(F.array_join("path", "/").alias("path"), "authority").agg(F.count("*").alias("n"))


@query("""SELECT t.doc_id AS spec, t.ln::BIGINT AS header_line, t.parent::BIGINT AS parent_line,
coalesce((SELECT min(n.ln) - 1 FROM H n WHERE n.doc_id = t.doc_id AND n.ln > t.ln AND n.level <= t.level), e.last)::BIGINT AS end_line,
(SELECT min(c.ln) FROM T c WHERE c.doc_id = t.doc_id AND c.parent = t.ln)::BIGINT AS child_start FROM T t JOIN E e ON e.doc_id = t.doc_id""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = L.sections(shim.marked_lines(spark, sf_dir))
    up = tree.select("spec", F.col("index").alias("parent"), F.col("header_line").alias("parent_line"))
    return tree.join(up, ["spec", "parent"], "left").select("spec", *big("header_line", "parent_line", "end_line", "child_start"))


@query("""SELECT t.doc_id AS spec, t.ln::BIGINT AS header_line, (t.ln + 1)::BIGINT AS first,
coalesce((SELECT min(c.ln) - 1 FROM T c WHERE c.doc_id = t.doc_id AND c.parent = t.ln), (SELECT min(n.ln) - 1 FROM H n WHERE n.doc_id = t.doc_id AND n.ln > t.ln AND n.level <= t.level), e.last)::BIGINT AS last
FROM T t JOIN E e ON e.doc_id = t.doc_id""")
def section_preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.preambles(L.sections(shim.marked_lines(spark, sf_dir))).select("spec", *big("header_line", "first", "last"))


@query("SELECT doc_id AS spec, t0.slug AS top, count(*)::BIGINT AS n FROM (SELECT t.doc_id, (SELECT max(c.ln) FROM T c WHERE c.doc_id = t.doc_id AND c.ln <= t.ln AND c.level = (SELECT min(level) FROM T m WHERE m.doc_id = t.doc_id)) AS top FROM T t) q LEFT JOIN T t0 USING (doc_id) WHERE (t0.ln = q.top OR (q.top IS NULL AND t0.ln = (SELECT min(ln) FROM T z WHERE z.doc_id = q.doc_id))) AND q.top IS NOT NULL GROUP BY ALL")
def chapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chapters(L.sections(shim.marked_lines(spark, sf_dir))).where("chapter is not null").groupBy("spec", F.col("chapter").alias("top")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS spec, ln::BIGINT AS ln, owner::BIGINT AS owner FROM R")
def innermost_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shim.rules(spark, sf_dir).select("spec", *big("ln", "owner"))


@query("SELECT doc_id AS spec, count(*)::BIGINT AS fenced FROM (SELECT doc_id, ln % 9 = 0 OR sum((ln % 9 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS f FROM L) WHERE f GROUP BY doc_id")
def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("ln") % 9 == 0, "\t ~~~ ").otherwise("p "), "line")
    return L.simple_fences(shim.plain_lines(spark, sf_dir).withColumn("line", line)).where("fenced").groupBy("spec").agg(F.count("*").alias("fenced"))


@query("""SELECT doc_id AS spec, count(*)::BIGINT AS fenced FROM (SELECT *, t OR odd OR (k AND NOT odd) OR sum((k AND NOT odd AND NOT t)::INT) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS f
FROM (SELECT doc_id, ln, ln % 11 = 3 AS t, ln % 7 = 2 AND ln % 11 <> 3 AS k, sum((ln % 11 = 3)::INT) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS odd FROM L)) WHERE f GROUP BY doc_id""")
def nested_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("ln") % 11 == 3, "  ~~~ ").when(F.col("ln") % 7 == 2, "\t```text ").otherwise("p "), "line")
    return L.fences(shim.plain_lines(spark, sf_dir).withColumn("line", line)).where("fenced").groupBy("spec").agg(F.count("*").alias("fenced"))


@query("""SELECT doc_id AS spec, min(ln)::BIGINT AS first, max(ln)::BIGINT AS last, (sum(length(line) + 2 + 8) + count(*) - 1)::BIGINT AS characters
FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM (SELECT *, (lag(stop, 1, true) OVER (PARTITION BY doc_id ORDER BY ln))::INT AS new FROM (SELECT *, (doc_id + ln) % 4 = 0 OR line = '' AS stop FROM L)) WHERE NOT stop) GROUP BY doc_id, block""")
def blocks_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocks(shim.marked_lines(spark, sf_dir))[0].select("spec", *big("first", "last"), F.length("text").cast("long").alias("characters"))


#: Blocks of the Markdown lines (BL), and their sentences (SE): boundaries are marked first and taken back after abbreviations.
_SENTENCES = r""", M0 AS (SELECT doc_id, ln, (doc_id + ln) % 4 = 0 OR line = '' AS stop, 'p ' || line || ' [^m' || lpad(((doc_id * 31 + ln * 7) % 1000)::VARCHAR, 3, '0') || ']'{more} AS piece, length(line) + 3 AS col FROM L),
M1 AS (SELECT *, lag(stop, 1, true) OVER (PARTITION BY doc_id ORDER BY ln) AS new FROM M0),
M2 AS (SELECT *, sum((new AND NOT stop)::INT) OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS block FROM M1),
BL AS (SELECT doc_id, block, string_agg(piece, ' ' ORDER BY ln) AS text FROM M2 WHERE NOT stop GROUP BY ALL),
S0 AS (SELECT doc_id, block, string_split(regexp_replace(regexp_replace(text, '([.!?]["'')\]]*\s+)([A-Z(\["''*`])', '\1' || chr(1) || '\2', 'g'),
  '(\b(?:e\.g\.|i\.e\.|etc\.|vs\.|cf\.|al\.|Dr\.|Mr\.|Ms\.|St\.|No\.|U\.S\.|approx\.)["'')\]]*\s+)' || chr(1), '\1', 'g'), chr(1)) AS p FROM BL),
S1 AS (SELECT doc_id, block, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM S0),
S2 AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id, block ORDER BY i)::BIGINT AS stop FROM S1),
SE AS (SELECT doc_id, block, stop - length(t) AS start, stop, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) - 1 AS sentence FROM S2 WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
PL_ AS (SELECT m.doc_id, m.ln, m.block, m.doc_id || ':' || m.ln AS id, coalesce(sum(length(piece) + 1) OVER (PARTITION BY m.doc_id, m.block ORDER BY m.ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin, m.piece, m.col FROM M2 m WHERE NOT stop),
IS_ AS (SELECT a.doc_id, a.ln, a.id, a.block, s.sentence FROM PL_ a JOIN SE s ON s.doc_id = a.doc_id AND s.block = a.block AND a.begin + a.col >= s.start AND a.begin + a.col < s.stop)
"""
SENTENCES = _SENTENCES.replace("{more}", "")
#: The same with a link at the end of every third line, and the places and targets of the links (LK).
LINKED = _SENTENCES.replace("{more}", " || CASE WHEN ln % 3 = 0 THEN '. See [it](#s' || ((doc_id + ln * 5) % 40 + 1) || ')' ELSE '' END") + """, LK AS (SELECT a.doc_id, a.ln, a.block, s.sentence, h.ln AS target FROM PL_ a JOIN SE s ON s.doc_id = a.doc_id AND s.block = a.block AND a.begin + strpos(a.piece, '[it](#s') - 1 >= s.start AND a.begin + strpos(a.piece, '[it](#s') - 1 < s.stop
  JOIN H h ON h.doc_id = a.doc_id AND h.ln = (a.doc_id + a.ln * 5) % 40 + 1 JOIN R r ON r.doc_id = a.doc_id AND r.ln = a.ln AND r.owner IS NOT NULL WHERE a.ln % 3 = 0)
"""


def linked_lines(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    """The Markdown lines with a link at the end of every third rule; unique as marked_lines() has it."""
    link = F.concat(F.lit(". See [it](#s"), (F.col("spec") + F.col("ln") * 5) % 40 + 1, F.lit(")"))
    return shim.marked_lines(spark, sf_dir, unique).withColumn("line", F.when((F.col("ln") % 3 == 0) & F.col("line").startswith("p "), F.concat("line", link)).otherwise(F.col("line")))


@query(SENTENCES + "SELECT doc_id AS spec, block::BIGINT AS block, sentence::BIGINT AS sentence, start::BIGINT AS start, stop::BIGINT AS \"end\" FROM SE")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = L.blocks(shim.marked_lines(spark, sf_dir))[0]
    found = whole.select("spec", "block", F.explode(T.sentences(F.col("text"))).alias("s"))
    return found.select("spec", *big("block"), *(F.col(f"s.{c}").cast("long").alias(c) for c in ("sentence", "start", "end")))


@query("SELECT doc_id AS spec, 'm' || lpad(((doc_id * 31 + ln * 7) % 1000)::VARCHAR, 3, '0') AS rule, count(*)::BIGINT AS n FROM R GROUP BY ALL HAVING count(*) > 1")
def marker_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.marker_repeats(L.markers(shim.marked_lines(spark, sf_dir)))


@query("SELECT doc_id AS spec, ln::BIGINT AS ln, (length(line) + 3)::BIGINT AS col FROM R")
def marker_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.markers(shim.marked_lines(spark, sf_dir)).select("spec", *big("ln", "col"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("**Example[^eg"), F.lpad((F.col("ln") % 1000).cast("string"), 3, "0"), F.lit("]**: title "), "ln", F.lit(" "), "line", F.lit("."))
    verdict = F.concat(F.lit("x "), "line", F.lit(" <!-- GOOD: fine -->"), F.when(F.col("ln") % 3 == 0, F.lit(" <!-- BAD[#a1]: why -->")).otherwise(F.lit("")))
    line = F.when(F.col("ln") % 5 == 1, head).when(F.col("ln") % 2 == 0, verdict).otherwise(F.concat(F.lit("text "), "line"))
    return L.fences(shim.plain_lines(spark, sf_dir).withColumn("line", line))


@query("""SELECT doc_id AS spec, eg AS example, verdict, cause, note, count(*)::BIGINT AS n FROM (SELECT doc_id, ln, 'eg' || lpad((eg % 1000)::VARCHAR, 3, '0') AS eg, unnest(v) AS w FROM (
  SELECT doc_id, ln, max(CASE WHEN ln % 5 = 1 THEN ln END) OVER (PARTITION BY doc_id ORDER BY ln) AS eg, CASE WHEN ln % 3 = 0 THEN ['GOOD', 'BAD'] ELSE ['GOOD'] END AS v FROM L) WHERE ln % 5 <> 1 AND ln % 2 = 0 AND eg IS NOT NULL) s,
  LATERAL (SELECT w AS verdict, CASE WHEN w = 'BAD' THEN 'a1' END AS cause, CASE WHEN w = 'BAD' THEN 'why' ELSE 'fine' END AS note) GROUP BY ALL""")
def example_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.verdicts(_examples(spark, sf_dir)).groupBy("spec", "example", "verdict", "cause", "note").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS spec, 'eg' || lpad((ln % 1000)::VARCHAR, 3, '0') AS example, ln::BIGINT AS ln, 'title ' || ln || ' ' || line || '.' AS title FROM L WHERE ln % 5 = 1")
def example_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.examples(_examples(spark, sf_dir)).select("spec", "example", *big("ln"), "title")


@query("""SELECT doc_id AS spec, eg AS example, first::BIGINT AS first, CASE WHEN ok THEN (first + 3)::BIGINT END AS last, CASE WHEN ok THEN NULL WHEN first + 1 <= e.last THEN 'not closed' ELSE 'no fenced body' END AS problem,
CASE WHEN ok THEN '**Example[^' || eg || ']**: t ' || one || '.' || chr(10) || '~~~text' || chr(10) || 'body ' || three || chr(10) || '~~~~' END AS text
FROM (SELECT l.doc_id, 'eg' || lpad((l.ln % 1000)::VARCHAR, 3, '0') AS eg, l.ln AS first, l.ln + 3 <= e.last AS ok, l.line AS one, (SELECT t.line FROM L t WHERE t.doc_id = l.doc_id AND t.ln = l.ln + 2) AS three FROM L l JOIN E e USING (doc_id) WHERE l.ln % 5 = 1) q JOIN E e USING (doc_id)""")
def example_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ln") % 5
    head = F.concat(F.lit("**Example[^eg"), F.lpad((F.col("ln") % 1000).cast("string"), 3, "0"), F.lit("]**: t "), "line", F.lit("."))
    line = F.when(r == 1, head).when(r == 2, "~~~text").when(r == 4, "~~~~").otherwise(F.concat(F.lit("body "), "line"))
    found = L.example_bodies(L.fences(shim.plain_lines(spark, sf_dir).withColumn("line", line)))
    return found.select("spec", "example", *big("first", "last"), "problem", "text")


@query("""SELECT doc_id AS spec, head::BIGINT AS ln, string_agg('c' || ln || ' ' || line || '.', ' ' ORDER BY ln) AS text FROM (SELECT doc_id, ln, line, max(CASE WHEN ln % 6 = 1 THEN ln END) OVER (PARTITION BY doc_id ORDER BY ln) AS head FROM L) WHERE ln % 6 IN (2, 4) AND head IS NOT NULL GROUP BY ALL""")
def commentary_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("ln") % 6
    line = F.when(r == 1, '!!! meta "Commentary"').when((r == 2) | (r == 4), F.concat(F.lit("    c"), "ln", F.lit(" "), "line", F.lit("."))).when(r == 3, "").otherwise(F.concat(F.lit("prose "), "line"))
    return L.commentary(L.fences(shim.plain_lines(spark, sf_dir).withColumn("line", line))).select("spec", *big("ln"), "text")


@query(f"""SELECT spec, owner, row_number() OVER (PARTITION BY spec, owner ORDER BY first)::BIGINT AS paragraph, first, last, text FROM (SELECT doc_id AS spec, owner::BIGINT AS owner, min(ln)::BIGINT AS first, max(ln)::BIGINT AS last, string_agg({_MARKED}, ' ' ORDER BY ln) AS text
FROM (SELECT r.doc_id, r.ln, r.line, r.owner, r.ln - row_number() OVER (PARTITION BY r.doc_id, r.owner ORDER BY r.ln) AS run FROM R r) GROUP BY doc_id, owner, run)""")
def paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shim.marked_lines(spark, sf_dir)
    tree = L.sections(lines)
    found = L.paragraphs(L.innermost(lines, tree)).join(tree.select("spec", F.col("index").alias("section"), F.col("header_line").alias("owner")), ["spec", "section"], "left")
    return found.select("spec", *big("owner", "paragraph", "first", "last"), "text")


@query(f"""SELECT doc_id AS spec, 'ctx' || lpad(min(ln)::VARCHAR, 5, '0') AS passage, max(ln)::BIGINT AS last, (SELECT max(h.ln) FROM H h WHERE h.doc_id = q.doc_id AND h.ln <= min(q.ln))::BIGINT AS owner, false AS commentary, string_agg({_MARKED}, chr(10) ORDER BY ln) AS text FROM (SELECT *, sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM (SELECT *, (doc_id + ln) % 4 = 0 OR line = '' AS stop FROM L)) q WHERE NOT stop GROUP BY doc_id, run""")
def source_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shim.marked_lines(spark, sf_dir)
    tree = L.sections(lines)
    owner = tree.select("spec", F.col("index").alias("section"), F.col("header_line").alias("owner"))
    return L.passages(lines, L.example_bodies(lines), tree).join(owner, ["spec", "section"], "left").select("spec", "passage", *big("last", "owner"), "commentary", "text")


#: The first 40 words of a text in SQL.
_CLIP = "CASE WHEN len(w) <= 40 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:40], ' ') || ' [...]' END"


@query(f"""SELECT spec, ln, (SELECT {_CLIP} FROM (SELECT string_split_regex(trim(stem), '\\s+') AS w)) AS stem, (SELECT {_CLIP} FROM (SELECT string_split_regex(trim(framing), '\\s+') AS w)) AS framing
FROM (SELECT l.doc_id AS spec, l.ln::BIGINT AS ln, 's ' || s.line || ' a' AS stem, CASE WHEN l.ln // 16 % 2 = 0 THEN 'f ' || f.line || '.' ELSE 'g ' || g.line || ' b' END AS framing
FROM L l JOIN L s ON s.doc_id = l.doc_id AND s.ln = l.ln - l.ln % 16 + 5 JOIN L g ON g.doc_id = l.doc_id AND g.ln = s.ln - 2 JOIN L f ON f.doc_id = l.doc_id AND f.ln = s.ln - 4 WHERE l.ln % 16 IN (6, 7))""")
def list_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 16 lines each: a heading, three paragraphs, of which the second may end with a colon, two items, and prose."""
    r, text = F.col("ln") % 16, lambda a, b: F.concat(F.lit(a), "line", F.lit(b))
    second = F.when(F.floor(F.col("ln") / 16) % 2 == 0, text("g ", ":")).otherwise(text("g ", " b"))
    line = F.when(r == 0, text("# H ", "")).when(r == 1, text("f ", ".")).when(r.isin(2, 4), "").when(r == 3, second).when(r == 5, text("s ", " a")).when(r.isin(6, 7), text("- item ", "")).otherwise(text("tail ", ""))
    lines = L.fences(shim.plain_lines(spark, sf_dir).withColumn("line", line))
    return L.stems(lines, lines.where(r.isin(6, 7))).select("spec", *big("ln"), "stem", "framing")


@query("SELECT spec, path, n, rules, row_number() OVER (PARTITION BY spec ORDER BY n DESC, path) AS place FROM (SELECT doc_id AS spec, path, count(*)::BIGINT AS n, string_agg(id, ',' ORDER BY ln) AS rules FROM R WHERE path IS NOT NULL GROUP BY ALL)")
def section_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their members in order of place, and their own order within each document."""
    from pyspark.sql import Window

    index = shim.rules(spark, sf_dir).where("path <> ''").withColumnRenamed("id", "rule")
    jobs = R.section_jobs(index).select("spec", F.array_join("sections", "/").alias("path"), *big("n"), F.array_join("rules", ",").alias("rules"))
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("spec").orderBy(F.desc("n"), "path")).cast("long"))


@query("""SELECT coalesce(authority, CASE WHEN (doc_id + ln) % 2 = 0 THEN 'user' END) AS authority, CASE WHEN authority IS NULL AND (doc_id + ln) % 2 = 0 THEN 'why' ELSE 'section_header' END AS provenance, count(*)::BIGINT AS n FROM R GROUP BY ALL""")
def override_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = shim.rules(spark, sf_dir).withColumnRenamed("id", "rule")
    over = index.where("authority is null and (spec + ln) % 2 = 0").select("rule", F.lit("user").alias("authority"), F.lit("why").alias("reason"))
    return R.resolved_authority(index, over).groupBy("authority", "provenance").agg(F.count("*").alias("n"))


@query("SELECT side, count(*)::BIGINT AS n FROM (SELECT 'missing' AS side FROM R WHERE (doc_id + ln) % 11 = 0 UNION ALL SELECT 'extra' FROM R WHERE (doc_id + ln) % 13 = 0) GROUP BY side")
def merge_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = shim.rules(spark, sf_dir).select("spec", "ln", F.col("id").alias("rule"))
    found = index.where("(spec + ln) % 11 <> 0").select("rule").unionByName(index.where("(spec + ln) % 13 = 0").select(F.concat("rule", F.lit("x")).alias("rule")))
    return R.missing_and_extra(index, found, "rule").groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT id AS rule, CASE WHEN ln % 3 = 0 THEN 'must' WHEN ln % 3 = 1 THEN 'should' END AS modality, 'a' || ln AS trigger FROM R WHERE (doc_id + ln) % 3 <> 0")
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = shim.rules(spark, sf_dir).select("spec", "ln", F.col("id").alias("rule"), "sections", "authority")
    one = index.where("(spec + ln) % 3 <> 0").select(F.col("rule").alias("id"), F.lit("a.json").alias("file"), F.lit(0).alias("pos"), F.concat(F.lit("a"), "ln").alias("trigger"), F.expr("case ln % 3 when 0 then 'must' when 1 then 'should' else 'may' end").alias("modality"))
    two = one.withColumn("file", F.lit("b.json")).withColumn("trigger", F.lit("late"))
    return R.merged_rules(index, one.unionByName(two)).select("rule", "modality", "trigger")


@query("SELECT id AS rule, 'f' || (ln % 4) AS kept FROM R")
def last_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = shim.rules(spark, sf_dir).select(F.col("id").alias("rule"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ln").cast("long") % 4)).alias("order"))
    return R.last_wins(many.withColumn("kept", F.concat(F.lit("f"), "order")), ["rule"], F.col("order")).select("rule", "kept")


@query("SELECT doc_id AS spec, doc_id % 5 <> 0 AS ok FROM documents WHERE length(trim(text)) > 0", shimmed=False)
def additions_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shim.table(spark, sf_dir, "documents").where("length(trim(text)) > 0").select(F.col("doc_id").alias("spec"), "text")
    after = F.concat(F.replace("text", F.lit(". "), F.lit(".[^z001] [^z002] ")), F.when(F.col("spec") % 5 == 0, F.lit(" more")).otherwise(F.lit("")))
    return R.additions_only(docs, docs.withColumn("text", after)).select("spec", "ok")


@query("SELECT 'changed without a brand' AS \"check\", doc_id || ':' || ln AS subject FROM L WHERE ln % 17 = 0 AND ln % 5 <> 0")
def brand_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shim.plain_lines(spark, sf_dir)
    raw = lines.withColumn("line", F.when(F.col("ln") % 5 == 0, F.concat(F.lit("an Acme "), "line")).otherwise(F.col("line")))
    other = lines.withColumn("line", F.when(F.col("ln") % 5 == 0, F.concat(F.lit("a "), "line")).when(F.col("ln") % 17 == 0, F.concat("line", F.lit(" changed"))).otherwise(F.col("line")))
    return K.anonymization(raw, other, ["acme"]).select("check", "subject")


@query("SELECT l.doc_id AS spec, sum((h.ln IS NOT NULL)::INT)::BIGINT AS n, sum((h.ln IS NULL)::INT)::BIGINT AS unknown, sum(length(l.line) + 1 + CASE WHEN h.ln IS NOT NULL THEN length('see [T' || h.ln || '](#s' || h.ln || ')') ELSE length('see [?](#s' || ((l.doc_id + l.ln * 5) % e.last + 1) || ')') END)::BIGINT AS characters FROM L l JOIN E e USING (doc_id) LEFT JOIN H h ON h.doc_id = l.doc_id AND h.ln = (l.doc_id + l.ln * 5) % e.last + 1 GROUP BY l.doc_id")
def crossref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = shim.plain_lines(spark, sf_dir)
    last = plain.groupBy("spec").agg(F.max("ln").alias("last"))
    lines = plain.join(last, "spec").select("spec", "ln", F.concat("line", F.lit(" see [?](#s"), (F.col("spec") + F.col("ln") * 5) % F.col("last") + 1, F.lit(")")).alias("line"))
    titles = L.headings(shim.marked_lines(spark, sf_dir)).select("spec", "slug", "title")
    return R.resolved_links(lines, titles).groupBy("spec").agg(F.sum("n").cast("long").alias("n"), F.sum("unknown").cast("long").alias("unknown"), F.sum(F.length("line")).alias("characters"))


@query("SELECT doc_id AS spec, ln::BIGINT AS ln, CASE WHEN ln % 4 = 1 THEN 'eg' ELSE 'z' END || repeat('0', greatest(0, 3 - length(n::VARCHAR))) || n AS rule FROM (SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id, ln % 4 ORDER BY ln) + coalesce((SELECT max(ln % 100) FROM R q WHERE q.doc_id = r.doc_id AND q.ln % 2 = 0 AND r.ln % 4 = 3), 0) AS n FROM R r WHERE ln % 2 = 1)")
def new_marker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.rules(spark, sf_dir).select("spec", "ln", F.lit(0).alias("col"))
    tagged = r.where("ln % 2 = 0").withColumn("rule", F.concat(F.lit("z"), F.lpad((F.col("ln") % 100).cast("string"), 3, "0")))
    kind = F.when(F.col("ln") % 4 == 1, "example").otherwise("rule")
    return R.new_ids(r.where("ln % 2 = 1").withColumn("kind", kind), tagged).select("spec", *big("ln"), "rule")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, CASE WHEN len(string_split_regex(trim(p_name), '\\s+')) <= 2 THEN trim(p_name) ELSE array_to_string(string_split_regex(trim(p_name), '\\s+')[1:2], ' ') || ' [...]' END AS clipped FROM part", shimmed=False)
def slugs_and_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = shim.table(spark, sf_dir, "part")
    return part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" "), "p_brand", F.lit("!"))).alias("slug"), T.clip(F.col("p_name"), 2).alias("clipped"))


@query("SELECT p_partkey, 'a' || p_size AS anchor, p_type AS kind FROM (SELECT p_partkey, p_size, replace(p_type, ' ', '-') AS p_type FROM part)", shimmed=False)
def attribute_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("#a"), "p_size", F.lit(" kind=old #b kind="), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("}"))
    return shim.table(spark, sf_dir, "part").select("p_partkey", T.anchor(block).alias("anchor"), T.attribute(block, "kind").alias("kind"))


@query("SELECT p_partkey, p_name || ' \"x\" - y...' AS folded, p_size % 2 = 0 AS kept FROM part", shimmed=False)
def quote_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("  [^ab12]“x” —- y… "))
    before, after = F.lit("[^ab12] [^ab12]"), F.when(F.col("p_size") % 2 == 0, "[^ab12] t [^ab12]").otherwise("[^ab12] [^cd34]")
    return shim.table(spark, sf_dir, "part").select("p_partkey", T.normalize(raw).alias("folded"), T.keeps_tags(before, after).alias("kept"))
