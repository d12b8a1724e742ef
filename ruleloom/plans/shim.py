"""A structured corpus from any documents table, by arithmetic on (doc_id, ln), the same in Spark and in SQL.

Lines of `documents` become Markdown: every fourth line a heading with an anchor and at times an authority, every other
line that isn't blank a rule with a marker. Labels, examples and citations follow from residues."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import lexing as L
from ruleloom.sources.lines import lines_of

AUTHORITY = "CASE (doc_id + ln) % 7 WHEN 0 THEN 'root' WHEN 1 THEN 'system' WHEN 2 THEN 'developer' WHEN 3 THEN 'user' WHEN 4 THEN 'guideline' END"

#: L: lines; H: headings; T: section tree with path and authority; R: rules; B: labels of rules.
SQL = f"""WITH RECURSIVE A AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|[\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) AS a FROM documents),
L0 AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS ln, len(a) AS n FROM A),
L AS (SELECT doc_id, ln, line FROM L0 WHERE NOT (ln = n AND line = '')),
E AS (SELECT doc_id, max(ln) AS last FROM L GROUP BY doc_id),
H AS (SELECT doc_id, ln, 1 + (doc_id + ln // 4) % 4 AS level, 's' || ln AS slug, {AUTHORITY} AS own FROM L WHERE (doc_id + ln) % 4 = 0),
PA AS (SELECT c.*, (SELECT max(p.ln) FROM H p WHERE p.doc_id = c.doc_id AND p.ln < c.ln AND p.level < c.level) AS parent FROM H c),
T AS (SELECT doc_id, ln, level, slug, parent, slug AS path, own AS authority FROM PA WHERE parent IS NULL
  UNION ALL SELECT c.doc_id, c.ln, c.level, c.slug, c.parent, t.path || '/' || c.slug, coalesce(c.own, t.authority) FROM PA c JOIN T t ON c.doc_id = t.doc_id AND c.parent = t.ln),
R0 AS (SELECT l.doc_id, l.ln, l.doc_id || ':' || l.ln AS id, l.line, (SELECT max(h.ln) FROM H h WHERE h.doc_id = l.doc_id AND h.ln <= l.ln) AS owner FROM L l WHERE (l.doc_id + l.ln) % 4 <> 0 AND l.line <> ''),
R AS (SELECT r.*, t.path, t.authority FROM R0 r LEFT JOIN T t ON t.doc_id = r.doc_id AND t.ln = r.owner),
B AS (SELECT doc_id, ln, id, 'k' || k AS label FROM R, range(0, 6) s(k) WHERE (doc_id + ln * (k + 1)) % 5 = 0),
C AS (SELECT r.doc_id, r.ln, r.id AS src, h.ln AS target FROM R r JOIN E e ON e.doc_id = r.doc_id JOIN H h ON h.doc_id = r.doc_id AND h.ln = (r.doc_id + r.ln * 5) % e.last + 1),
X AS (SELECT c.doc_id, c.src, o.id AS dst, min(c.ln) AS ln FROM C c JOIN R o ON o.doc_id = c.doc_id AND o.owner = c.target AND o.id <> c.src GROUP BY ALL)
"""


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, set for checkpoint() too; one of our own only where the session names none and all runs
    in one process. Raises on a cluster without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """A table that several branches of a query read, written once."""
    folder = fresh_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_lines(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", together)


def by_document(spark: SparkSession) -> None:
    """Lets joins on (spec, ...) use tables that are dealt out by spec as they are. Spark would deal both sides of such a join anew by all of its
    keys, once smaller tables are too large to be broadcast; windows take them as they are in any case. Results don't depend on it."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Three digits recur after so many lines.
_RECUR = 1000
#: The first of the ideographs that stand in the place of m from there on, and their number.
_FIRST, _MOST = 0x4E00, 20_992


def marker(unique: bool) -> Column:
    """The marker of a rule (spec, ln): m and three digits, which recur after 1,000 lines. unique: an ideograph for each further 1,000 lines
    stands in the place of m then, so that no two rules of a document have one marker; lines of one section have the same letter, so that they are in the
    order of their digits. SQL knows rules by their lines and names them by the digits alone: named() gives that name."""
    digits = F.lpad(((F.col("spec") * 31 + F.col("ln") * 7) % _RECUR).cast("string"), 3, "0")
    if not unique:
        return F.concat(F.lit("m"), digits)
    k = F.expr(f"(ln + pmod(spec, 4)) div {_RECUR}").cast("int")
    letter = F.decode(F.unhex(F.hex(F.lit(_FIRST - 1) + k)), "UTF-16BE")
    letter = F.when(k == 0, "m").when(k <= _MOST, letter).otherwise(F.raise_error(F.lit("a document has more lines than there are markers")).cast("string"))
    return F.concat(letter, digits)


def named(rule: Column) -> Column:
    """The name that SQL gives a rule, of its unique marker."""
    return F.concat(F.lit("m"), F.substring(rule, 2, 3))


def marked_lines(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    """The Markdown lines with `fenced`, dealt out by document; unique: as marker() has it, for operators that know rules by their markers."""
    by_document(spark)
    authority = F.expr(AUTHORITY.replace("doc_id", "spec"))
    level = F.expr("1 + (spec + ln div 4) % 4").cast("int")
    head = F.concat(F.repeat(F.lit("#"), level), F.lit(" T"), "ln", F.lit(" {#s"), "ln", F.coalesce(F.concat(F.lit(" authority="), authority), F.lit("")), F.lit("}"))
    mark = F.concat(F.lit(" [^"), marker(unique), F.lit("]"))
    is_head = (F.col("spec") + F.col("ln")) % 4 == 0
    line = F.when(is_head, head).when(F.col("line") == "", "").otherwise(F.concat(F.lit("p "), "line", mark))
    return L.fences(plain_lines(spark, sf_dir, True).withColumn("line", line))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec, ln, id, section, owner, sections, path, authority of the rules; lexed from the Markdown, one scan."""
    return rules_of(marked_lines(spark, sf_dir)).drop("text")


def rules_of(lines: DataFrame) -> DataFrame:
    """rules() of marked lines that are there already, with `text`, a rule's line without its marker."""
    return rules_in(L.placed(lines))


def rules_in(placed: DataFrame) -> DataFrame:
    """rules_of() of lines that have their section already, as lexing.placed() gives it."""
    df = placed.where(F.col("line").startswith("p "))
    text = F.regexp_replace("line", r" \[\^.\d{3}\]$", "").alias("text")
    return df.select("spec", "ln", F.concat_ws(":", "spec", "ln").alias("id"), "section", F.col("header_line").alias("owner"), F.coalesce("path", F.array().cast("array<string>")).alias("sections"), F.array_join("path", "/").alias("path"), "authority", text)


def labels(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """spec, ln, id, label."""
    return labels_of(plain_lines(spark, sf_dir, together).where(((F.col("spec") + F.col("ln")) % 4 != 0) & (F.col("line") != "")))


def labels_of(own: DataFrame, *more: str) -> DataFrame:
    """labels() of lines (spec, ln) that are known to be rules, with more of their columns."""
    df = own.select("spec", "ln", *more, F.concat_ws(":", "spec", "ln").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return df.where((F.col("spec") + F.col("ln") * (F.col("k") + 1)) % 5 == 0).select("spec", "ln", *more, "id", F.concat(F.lit("k"), "k").alias("label"))


def citation_edges(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """spec, src, dst, ln: a rule cites the rules of the section whose heading its residue names. known: rules() where they are written already."""
    r = kept(rules(spark, sf_dir).select("spec", "ln", "id", "owner")) if known is None else known.select("spec", "ln", "id", "owner")
    last = plain_lines(spark, sf_dir).groupBy("spec").agg(F.max("ln").alias("last"))
    cites = r.join(last, "spec").select("spec", "ln", F.col("id").alias("src"), ((F.col("spec") + F.col("ln") * 5) % F.col("last") + 1).alias("owner"))
    met = cites.join(r.select("spec", "owner", F.col("id").alias("dst")), ["spec", "owner"]).where("src <> dst")
    return met.groupBy("spec", "src", "dst").agg(F.min("ln").alias("ln"))
