"""Queries over the typed graph, its labels and its partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.operators import checks as K
from ruleloom.operators import edges as E
from ruleloom.operators import labels as S
from ruleloom.operators import lexing as L
from ruleloom.operators import partition as P
from ruleloom.operators.dealing import cut

from . import shim
from .lexical import SENTENCES, big

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, shimmed: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (shim.SQL if shimmed else "") + sql
        return f

    return add


@query("SELECT authority, count(*)::BIGINT AS n FROM R a JOIN R b ON a.doc_id = b.doc_id AND a.path = b.path AND a.id <> b.id GROUP BY authority".replace("SELECT authority", "SELECT a.authority").replace("GROUP BY authority", "GROUP BY a.authority"))
def same_section_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.kept(shim.rules(spark, sf_dir).where("path <> ''").select("spec", "id", "path", "authority"))
    met = E.pairs(r, "id", ["spec", "path"])
    return met.join(r.select("spec", F.col("id").alias("src"), "authority"), ["spec", "src"]).groupBy("authority").agg(F.count("*").alias("n"))


@query("SELECT a.doc_id AS spec, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM (SELECT *, (lag(stop, 1, true) OVER (PARTITION BY doc_id ORDER BY ln))::INT AS new FROM (SELECT *, (doc_id + ln) % 4 = 0 OR line = '' AS stop FROM L)) WHERE NOT stop) a JOIN (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM (SELECT *, (lag(stop, 1, true) OVER (PARTITION BY doc_id ORDER BY ln))::INT AS new FROM (SELECT *, (doc_id + ln) % 4 = 0 OR line = '' AS stop FROM L)) WHERE NOT stop) b ON a.doc_id = b.doc_id AND a.block = b.block AND a.ln <> b.ln GROUP BY a.doc_id")
def same_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = L.blocks(shim.marked_lines(spark, sf_dir))[1]
    return E.pairs(places, "ln", ["spec", "block"]).groupBy("spec").agg(F.count("*").alias("n"))


@query(SENTENCES + "SELECT a.doc_id AS spec, count(*)::BIGINT AS n FROM IS_ a JOIN IS_ b ON a.doc_id = b.doc_id AND a.block = b.block AND a.sentence = b.sentence AND a.ln <> b.ln GROUP BY a.doc_id")
def same_sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the sentences that lookbehinds bound; SQL marks boundaries and takes them back."""
    lines = shim.marked_lines(spark, sf_dir)
    at = L.at_sentence(L.markers(lines), lines).withColumn("id", F.concat_ws(":", "spec", "ln"))
    return E.pairs(at, "id", ["spec", "block", "sentence"]).groupBy("spec").agg(F.count("*").alias("n"))


@query("SELECT a.doc_id AS spec, count(*)::BIGINT AS n FROM R a JOIN R b ON a.doc_id = b.doc_id AND (a.doc_id * 3 + a.ln) % 5 = (b.doc_id * 3 + b.ln) % 5 AND a.id <> b.id WHERE (a.doc_id * 3 + a.ln) % 2 = 0 AND (b.doc_id * 3 + b.ln) % 2 = 0 GROUP BY a.doc_id")
def shares_example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.rules(spark, sf_dir).withColumn("m", F.col("spec") * 3 + F.col("ln")).where("m % 2 = 0").withColumn("example", F.col("m") % 5)
    return E.pairs(r, "id", ["spec", "example"]).groupBy("spec").agg(F.count("*").alias("n"))


@query("SELECT shared AS via, count(*)::BIGINT AS n FROM (SELECT a.id, b.id AS other, string_agg(a.label, ',' ORDER BY a.label) AS shared FROM B a JOIN B b ON a.doc_id = b.doc_id AND a.label = b.label AND a.id < b.id GROUP BY ALL) GROUP BY shared")
def shares_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shared_labels(shim.labels(spark, sf_dir), ["spec"]).groupBy(F.array_join("via", ",").alias("via")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS spec, count(*)::BIGINT AS n, count(DISTINCT src)::BIGINT AS citing FROM X GROUP BY doc_id")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shim.citation_edges(spark, sf_dir).groupBy("spec").agg(F.count("*").alias("n"), F.countDistinct("src").alias("citing"))


@query("""SELECT relation, scope, count(*)::BIGINT AS n FROM (
SELECT 'cross_reference' AS relation, 'sentence' AS scope FROM (SELECT DISTINCT c.src, o.id FROM C c JOIN R o ON o.doc_id = c.doc_id AND o.owner = c.target AND o.id <> c.src)
UNION ALL SELECT 'reference', 'sentence' FROM C c WHERE NOT EXISTS (SELECT 1 FROM R o WHERE o.doc_id = c.doc_id AND o.owner = c.target)) GROUP BY ALL""")
def citations_and_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the rules' own lines, each line a sentence of its own, through the whole citation operator."""
    r = shim.rules(spark, sf_dir)
    tree = L.sections(shim.marked_lines(spark, sf_dir))
    last = shim.plain_lines(spark, sf_dir).groupBy("spec").agg(F.max("ln").alias("last"))
    own = r.select("spec", F.col("id").alias("rule"), F.col("ln").alias("block"), F.lit(0).alias("sentence"), "sections")
    links = r.join(last, "spec").select("spec", "ln", F.lit(0).alias("col"), F.concat(F.lit("s"), (F.col("spec") + F.col("ln") * 5) % F.col("last") + 1).alias("anchor"), F.col("ln").alias("block"), F.lit(0).alias("sentence"), F.lit("cites").alias("sentence_text"), F.col("path").alias("section_path"))
    edges, refs = E.citations(links, own, L.slugs(tree), E.direct_owners(own))
    both = edges.select("relation", "scope").unionByName(refs.select(F.lit("reference").alias("relation"), "scope"))
    return both.groupBy("relation", "scope").agg(F.count("*").alias("n"))


def _directed(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    x = shim.citation_edges(spark, sf_dir, known)
    return x.select("src", "dst", F.lit("cross_reference").alias("relation"), F.lit(None).cast("string").alias("subtype"), F.lit("out").alias("direction"))


@query("SELECT direction, count(*)::BIGINT AS n FROM (SELECT src, dst, CASE WHEN bool_or(o AND src < dst) THEN 'out' WHEN bool_or(NOT o AND dst < src) THEN 'in' WHEN bool_or(o) THEN 'out' ELSE 'in' END AS direction FROM (SELECT src, dst, true AS o FROM X UNION ALL SELECT dst, src, false FROM X) GROUP BY src, dst) GROUP BY direction")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two rules that cite each other the smaller keeps `out`, the other `in`: rows are put in by citing rule."""
    both = E.mirrored(_directed(spark, sf_dir)).withColumn("by", F.when(F.col("rank") == 0, F.col("src")).otherwise(F.col("dst")))
    return E.deduplicated(both, ["src", "dst", "relation", "subtype"], [F.col("by"), F.col("rank")]).groupBy("direction").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS edges, sum((NOT EXISTS (SELECT 1 FROM X y WHERE y.src = x.dst AND y.dst = x.src))::INT)::BIGINT AS lone FROM X x")
def mirror_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _directed(spark, sf_dir).withColumn("direction", F.lit("none"))
    lone = E.asymmetric(edges, ["relation", "subtype"]).agg(F.count("*").alias("lone"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(lone)


@query("SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM X)")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.undirected(_directed(spark, sf_dir), ["relation"]).agg(F.count("*").alias("n"))


@query("SELECT 'dim:' || label AS gid, count(DISTINCT id)::BIGINT AS n, min(id) AS first, max(id) AS last FROM B GROUP BY label")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.label_groups(shim.labels(spark, sf_dir))
    return g.select("gid", *big("n"), F.array_min("members").alias("first"), F.array_max("members").alias("last"))


@query("SELECT doc_id AS spec, 'sec:' || path AS gid, count(*)::BIGINT AS n, coalesce(string_agg(DISTINCT authority, ', ' ORDER BY authority), '') AS authorities FROM R WHERE path IS NOT NULL GROUP BY doc_id, path")
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.section_groups(shim.rules(spark, sf_dir).where("path <> ''").withColumnRenamed("id", "rule"))
    return g.select("spec", "gid", *big("n"), "authorities")


@query("SELECT id AS rule, string_agg(DISTINCT 'dim:' || label, ',' ORDER BY 'dim:' || label) AS groups FROM B GROUP BY id")
def groups_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.groups_of_rules(E.label_groups(shim.labels(spark, sf_dir))).select("rule", F.array_join("groups", ",").alias("groups"))


@query("SELECT a.authority, count(*)::BIGINT AS n FROM X JOIN R a ON a.id = X.src JOIN R b ON b.id = X.dst WHERE a.authority = b.authority GROUP BY a.authority")
def authority_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, x = shim.rules(spark, sf_dir), shim.citation_edges(spark, sf_dir)
    r, x = shim.kept(r.select("id", "authority")), shim.kept(x)
    views = [E.induced(x, r.where(F.col("authority") == a).select("id")).select(F.lit(a).alias("authority")) for a in schema.AUTHORITIES]
    return reduce(DataFrame.unionByName, views).groupBy("authority").agg(F.count("*").alias("n"))


@query("SELECT n AS labels, count(*)::BIGINT AS rules, (n * count(*))::BIGINT AS copies, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS marked FROM (SELECT id, count(*)::BIGINT AS n FROM B GROUP BY id) GROUP BY n")
def vertex_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.split_vertices(shim.labels(spark, sf_dir).select("id", "label"))
    per = nodes.groupBy("rule").agg(F.count("*").alias("labels"), F.count_if(F.contains("copy", F.lit("@"))).alias("m"))
    return per.groupBy("labels").agg(F.count("*").alias("rules"), F.sum("labels").alias("copies"), F.sum("m").alias("marked"))


@query("SELECT coalesce(label, 'bridge') AS context, count(*)::BIGINT AS n FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM X) p LEFT JOIN (SELECT x.id AS i, y.id AS j, x.label FROM B x JOIN B y ON x.doc_id = y.doc_id AND x.label = y.label) s ON s.i = p.a AND s.j = p.b GROUP BY ALL")
def edge_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = E.undirected(_directed(spark, sf_dir), ["relation", "subtype"]).withColumn("via", F.lit(None).cast("array<string>"))
    return P.contexts(u, shim.labels(spark, sf_dir).select("id", "label")).groupBy(F.coalesce("context", F.lit("bridge")).alias("context")).agg(F.count("*").alias("n"))


def _label_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Copies of the rules, and a chain of edges through each label of a document."""
    b = shim.labels(spark, sf_dir)
    nodes = shim.rules(spark, sf_dir).select(F.col("id").alias("node"))
    return nodes, E.shared_labels(b, ["spec"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("SELECT size, count(*)::BIGINT AS n FROM (SELECT c, count(*)::BIGINT AS size FROM (SELECT n.id, min(r.m) AS c FROM R n JOIN (SELECT id, m FROM reach) r ON r.id = n.id GROUP BY n.id) GROUP BY c) GROUP BY size".replace("(SELECT id, m FROM reach)", "reach"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    shim.shared_folder(spark)
    nodes, edges = _label_graph(spark, sf_dir)
    by = P.components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))
    return by.groupBy("size").agg(F.count("*").alias("n"))


ORACLES["components"] = shim.SQL.rstrip() + ", G AS (SELECT DISTINCT a.id AS a, b.id AS b FROM B a JOIN B b ON a.doc_id = b.doc_id AND a.label = b.label AND a.id <> b.id), reach AS (SELECT id, id AS m FROM R UNION SELECT g.b, r.m FROM reach r JOIN G g ON g.a = r.id) " + "SELECT size, count(*)::BIGINT AS n FROM (SELECT c, count(*)::BIGINT AS size FROM (SELECT id, min(m) AS c FROM reach GROUP BY id) GROUP BY c) GROUP BY size"


#: Sections by size (J), and each dealt to the packet with least so far: one step of the recursion for each section.
PACKED = """, J0 AS (SELECT doc_id, path, count(*)::BIGINT AS n FROM R WHERE path IS NOT NULL GROUP BY doc_id, path),
J AS (SELECT *, row_number() OVER (ORDER BY n DESC, doc_id, path) AS k FROM J0),
PK AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, NULL::VARCHAR AS path, list_transform(range(1, 13), lambda x: 0::BIGINT) AS load, 0::BIGINT AS job
  UNION ALL SELECT j.k, j.doc_id, j.path, list_transform(range(1, 13), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN j.n ELSE 0 END), list_position(load, list_min(load))::BIGINT FROM PK JOIN J j ON j.k = PK.k + 1)
"""


@query(PACKED + "SELECT doc_id AS spec, path, 'job' || lpad(job::VARCHAR, 2, '0') AS job FROM PK WHERE k > 0")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict order of choices over the sections of all documents."""
    shim.shared_folder(spark)
    jobs = shim.rules(spark, sf_dir).where("path <> ''").groupBy("spec", "path").agg(F.count("*").alias("n"))
    return P.packed(jobs, 12, ("spec", "path"))


def _units(spark: SparkSession, sf_dir: str, even: bool) -> DataFrame:
    """Every document is an authority of its own, so that the units spread over the cluster. What two rules share by a label is told by the
    copies of a document's label, a group, as its pairs grow with the square of the document. All tables are dealt out by document."""
    shim.shared_folder(spark)
    r = cut(shim.rules(spark, sf_dir).select("spec", "ln", "id", "owner"))
    b = shim.labels_of(r).select("spec", "id", "label")
    nodes = cut(P.split_vertices(b, ["spec"]))
    none = F.lit(None)
    x = shim.citation_edges(spark, sf_dir, r).withColumn("relation", F.lit("cross_reference")).withColumn("subtype", none.cast("string"))
    x = E.undirected(x, ["spec", "relation", "subtype"]).withColumn("via", none.cast("array<string>"))
    found = cut(P.contexts(x, b, ["spec"]))
    edges = cut(P.copy_edges(found, nodes, ["spec"]))
    own = nodes.select("spec", F.col("copy").alias("node"), F.col("context").alias("group"))
    comps = P.numbered_components(P.components_of_groups(own, edges, ["spec"]), ["spec"]).withColumnRenamed("spec", "authority")
    first = nodes.groupBy("spec", "rule").agg(F.min("copy").alias("copy"))
    ends = found.where("context is null").join(first.select("spec", F.col("rule").alias("a"), F.col("copy").alias("x")), ["spec", "a"]).join(first.select("spec", F.col("rule").alias("b"), F.col("copy").alias("y")), ["spec", "b"])
    bridges = ends.select(F.col("spec").alias("authority"), F.col("x").alias("a"), F.col("y").alias("b"))
    groups = own.select(F.col("spec").alias("authority"), F.col("node").alias("copy"), "group")
    got = P.units(comps, edges.withColumnRenamed("spec", "authority"), bridges, cap=28 if not even else 8, floor=12 if not even else 4, even=even, groups=groups)
    return got.withColumn("authority", F.col("authority").cast("string"))


@query()
def unit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, False).select("authority", "cid", "size", "provenance", F.array_join("members", ",").alias("members"))


@query()
def unit_subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, True).select("authority", "cid", "size", "provenance", F.array_join("members", ",").alias("members"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = shim.labels(spark, sf_dir)
    nodes = P.split_vertices(b.select("id", "label"))
    return nodes.select(F.split_part("rule", F.lit(":"), F.lit(1)).alias("unit"), "copy", "rule", "context")


@query("SELECT unit, label FROM (SELECT unit, label, row_number() OVER (PARTITION BY unit ORDER BY n DESC, f) AS k FROM (SELECT doc_id::VARCHAR AS unit, label, count(*) AS n, min(CASE WHEN m > 1 THEN id || '@' || label ELSE id END) AS f FROM (SELECT *, count(*) OVER (PARTITION BY id) AS m FROM B) GROUP BY ALL)) WHERE k = 1")
def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dominant_labels(_members(spark, sf_dir))


@query("SELECT count(DISTINCT id)::BIGINT AS rules, count(*)::BIGINT AS copies, (SELECT count(DISTINCT doc_id) FROM B)::BIGINT AS units, (SELECT min(n) FROM s)::BIGINT AS min, (SELECT floor(median(n)) FROM s)::BIGINT AS median, (SELECT max(n) FROM s)::BIGINT AS max, (SELECT string_agg(n, ',' ORDER BY n DESC) FROM s) AS sizes, round_even(count(*)::DOUBLE / count(DISTINCT id), 2) AS duplication FROM B".replace("FROM s)", "FROM (SELECT count(*) AS n FROM B GROUP BY doc_id))"))
def unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.balance(_members(spark, sf_dir)).select("rules", "copies", *big("units", "min", "median", "max"), F.array_join("sizes", ",").alias("sizes"), "duplication")


@query("SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM X) p JOIN R x ON x.id = p.a JOIN R y ON y.id = p.b WHERE x.ln % 2 <> y.ln % 2")
def cut_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = shim.rules(spark, sf_dir).select(F.col("id").alias("copy"), (F.col("ln") % 2).alias("unit"))
    return P.cut_edges(members, _directed(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation"))


@query("SELECT \"check\", count(*)::BIGINT AS n FROM (SELECT 'uncovered' AS \"check\" FROM R WHERE ln % 10 = 0 UNION ALL SELECT 'repeated' FROM R WHERE ln % 15 = 1 AND ln % 10 <> 0 UNION ALL SELECT 'size' FROM (SELECT DISTINCT doc_id FROM R WHERE ln % 10 <> 0 AND doc_id % 3 = 0)) GROUP BY ALL")
def partition_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.rules(spark, sf_dir).select("spec", "ln", F.col("id").alias("copy"))
    members = r.where("ln % 10 <> 0").select("copy", F.col("spec").alias("unit"), "ln")
    members = members.unionByName(members.where("ln % 15 = 1"))
    sizes = members.groupBy("unit").agg(F.count("*").alias("n")).select("unit", (F.col("n") + (F.col("unit") % 3 == 0).cast("int")).alias("size"))
    return P.partition_problems(r.select("copy"), members.select("copy", "unit"), sizes).groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM R)::BIGINT AS rules, (SELECT count(*) FROM R WHERE id NOT IN (SELECT id FROM B))::BIGINT AS unlabelled, (SELECT max(n) FROM (SELECT count(*) AS n FROM B GROUP BY id))::BIGINT AS most")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(shim.rules(spark, sf_dir), shim.labels(spark, sf_dir)).select(*big("rules", "unlabelled", "most"))


@query("SELECT id FROM R WHERE id NOT IN (SELECT id FROM B)")
def residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.residue(shim.rules(spark, sf_dir), shim.labels(spark, sf_dir))


@query("SELECT a, b, kind FROM (SELECT x.label AS a, y.label AS b, count(*) AS n, (SELECT count(*) FROM B z WHERE z.label = x.label) AS na, (SELECT count(*) FROM B z WHERE z.label = y.label) AS nb FROM B x JOIN B y ON x.id = y.id AND x.label <> y.label GROUP BY x.label, y.label), LATERAL (SELECT CASE WHEN n = na AND na = nb AND a < b THEN 'duplicate' WHEN n = na AND na < nb THEN 'nested' END AS kind) WHERE kind IS NOT NULL")
def leaf_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nesting(shim.labels(spark, sf_dir))


@query("SELECT label, count(*)::BIGINT AS n, label IN ('k1', 'k3') AS documented FROM B GROUP BY label HAVING count(*) > 30")
def oversize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spark.createDataFrame([("k1",), ("k3",)], "label string")
    return S.oversize(shim.labels(spark, sf_dir), kept).select("label", *big("n"), "documented")


@query("""SELECT round(sharing / (n * (n - 1) / 2.0), 9) AS base, round(hits / linked::DOUBLE, 6) AS observed FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT a.id, b.id FROM B a JOIN B b ON a.doc_id = b.doc_id AND a.label = b.label AND a.id < b.id)) AS sharing, (SELECT count(*) FROM R) AS n, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM X)) AS linked,
(SELECT count(*) FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM X) p WHERE EXISTS (SELECT 1 FROM B x JOIN B y ON x.label = y.label WHERE x.id = p.a AND y.id = p.b)) AS hits)""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each document are its own, as pairs over all documents would be quadratic."""
    b = shim.labels(spark, sf_dir).withColumn("label", F.concat_ws("/", "spec", "label"))
    linked = E.undirected(_directed(spark, sf_dir), [])
    return S.enrichment(b, shim.rules(spark, sf_dir), linked).select(F.round("base", 9).alias("base"), F.round("observed", 6).alias("observed"))


#: Rules with their labels as bits (PI), each permutation's orders by id and by digest (PO), and the labels that each rule is dealt (PD).
PERMUTED = """, PP AS (SELECT DISTINCT doc_id, least(src, dst) AS a, greatest(src, dst) AS b FROM X),
PI AS MATERIALIZED (SELECT R.doc_id, R.id, coalesce(b.bits, 0)::BIGINT AS bits FROM R LEFT JOIN (SELECT id, sum(1 << substr(label, 2)::INT)::BIGINT AS bits FROM (SELECT DISTINCT id, label FROM B) GROUP BY id) b ON b.id = R.id WHERE R.doc_id IN (SELECT doc_id FROM PP)),
PK_ AS (SELECT doc_id, id, bits, b * 4 + j AS perm, substr(h, (8 * j + 1)::INT, 8) AS key FROM (SELECT *, md5('0:' || b || ':' || id) AS h FROM PI, range(0, 250) s(b)), range(0, 4) t(j)),
PO AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, perm ORDER BY id) AS place, row_number() OVER (PARTITION BY doc_id, perm ORDER BY key, id) AS drawn FROM PK_),
PD AS MATERIALIZED (SELECT x.perm, x.id, y.bits FROM PO x JOIN PO y ON x.doc_id = y.doc_id AND x.perm = y.perm AND y.drawn = x.place),
PH AS (SELECT x.perm, count_if(x.bits & y.bits <> 0) AS hits FROM PP JOIN PD x ON x.id = PP.a JOIN PD y ON y.id = PP.b AND y.perm = x.perm GROUP BY x.perm),
PV AS (SELECT observed::BIGINT AS observed, at_least::BIGINT AS at_least, (at_least + 1)::DOUBLE / 1001 AS p FROM (SELECT (SELECT count_if(x.bits & y.bits <> 0) FROM PP JOIN PI x ON x.id = PP.a JOIN PI y ON y.id = PP.b) AS observed,
  (SELECT count_if(hits >= (SELECT count_if(x.bits & y.bits <> 0) FROM PP JOIN PI x ON x.id = PP.a JOIN PI y ON y.id = PP.b)) FROM PH) AS at_least))
"""


@query(PERMUTED + "SELECT observed, at_least, round(p, 9) AS p FROM PV")
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded draw over the rules, labels and undirected citations of all documents; labels are dealt within their document,
    whose own they are (as in `enrichment`)."""
    labels = shim.rules(spark, sf_dir).select("spec", "id", F.lit(None).cast("string").alias("label")).unionByName(shim.labels(spark, sf_dir).select("spec", "id", "label"))
    x = shim.citation_edges(spark, sf_dir)
    return S.permutation_p_within(labels, E.undirected(x, ["spec"]), "spec").select("observed", "at_least", F.round("p", 9).alias("p"))


@query("SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT po, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT avg((quality = toxic)::INT::DOUBLE) AS po, avg((quality = 1)::INT::DOUBLE) AS pa, avg((toxic = 1)::INT::DOUBLE) AS pb FROM labels))", shimmed=False)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shim.table(spark, sf_dir, "labels").agg(F.round(S.kappa(F.col("quality") == 1, F.col("toxic") == 1), 6).alias("kappa"))


@query("SELECT \"key\", round(coalesce(o.k, CASE WHEN pe = 1 THEN po ELSE (po - pe) / (1 - pe) END), 6) AS kappa FROM (SELECT 'q' || doc_id % 3 AS \"key\", avg((quality = toxic)::INT::DOUBLE) AS po, avg((quality = 1)::INT::DOUBLE) * avg((toxic = 1)::INT::DOUBLE) + (1 - avg((quality = 1)::INT::DOUBLE)) * (1 - avg((toxic = 1)::INT::DOUBLE)) AS pe FROM labels GROUP BY 1) LEFT JOIN (SELECT 'q1' AS \"key\", 0.75::DOUBLE AS k) o USING (\"key\")", shimmed=False)
def pilot_kappas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shim.table(spark, sf_dir, "labels").withColumn("key", F.concat(F.lit("q"), F.col("doc_id") % 3)).withColumnRenamed("doc_id", "id")
    later = spark.createDataFrame([("q1", 0.5, 1), ("q1", 0.75, 2)], "key string, kappa double, priority int")
    return S.pilot_kappas(t.select("key", "id", (F.col("quality") == 1).alias("applies")), t.select("key", "id", (F.col("toxic") == 1).alias("applies")), later).select("key", F.round("kappa", 6).alias("kappa"))


@query("SELECT \"check\", count(*)::BIGINT AS n FROM (SELECT 'lost' AS \"check\" FROM (SELECT DISTINCT id FROM B WHERE label = 'k0' EXCEPT SELECT id FROM B WHERE label IN ('k1', 'k5')) UNION ALL SELECT 'gained' FROM (SELECT DISTINCT label, id FROM B WHERE label IN ('k1', 'k5') AND id NOT IN (SELECT id FROM B WHERE label = 'k0')) UNION ALL SELECT 'not separated' FROM (VALUES ('k1', 'k5'), ('k5', 'k1')) v(a, b) WHERE NOT EXISTS (SELECT 1 FROM B x WHERE x.label = a AND x.id NOT IN (SELECT id FROM B y WHERE y.label = b))) GROUP BY ALL")
def refine_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("k0", None), ("k1", "k0"), ("k5", "k0")], "key string, parent string")
    return S.refinement_problems(registry, shim.labels(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT axis, count(DISTINCT coder)::BIGINT AS n, CASE WHEN count(DISTINCT coder) = 5 THEN 'unanimous' WHEN count(DISTINCT coder) * 2 > 5 THEN 'majority' WHEN count(DISTINCT coder) = 1 THEN 'singleton' ELSE 'minority' END AS status FROM (SELECT p_brand || '/' || p_size AS axis, p_partkey % 5 AS coder FROM part) GROUP BY axis", shimmed=False)
def axis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = shim.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("axis"), (F.col("p_partkey") % 5).alias("coder"))
    return S.axis_status(votes, 5).select("axis", *big("n"), "status")


@query("SELECT count(*)::BIGINT AS pairs, sum((ln % 2 = 0 OR ln % 3 = 0)::INT - (ln % 6 = 0)::INT)::BIGINT AS differ FROM B WHERE NOT (ln % 2 = 0 AND ln % 3 = 0)")
def labeller_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = shim.labels(spark, sf_dir)
    return S.disagreement(b.where("ln % 2 <> 0"), b.where("ln % 3 <> 0")).select("pairs", "differ")


@query("SELECT id, chapter FROM (SELECT id, coalesce(authority, 'none') AS chapter, row_number() OVER (PARTITION BY coalesce(authority, 'none') ORDER BY md5('0:' || id), id) AS k FROM R) ORDER BY k, chapter LIMIT 40")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_sample(shim.rules(spark, sf_dir).select("id", F.coalesce("authority", F.lit("none")).alias("chapter")))


#: A registry with a topic for each document (RG), and its problems (RP): keys and definitions of several, titles that lack, parents unknown or too deep.
REGISTRY = """RG AS (SELECT CASE WHEN doc_id % 11 = 1 THEN 'd' || (doc_id - 1) ELSE 'd' || doc_id END AS k, CASE WHEN doc_id % 11 = 2 THEN '' ELSE 'T' END AS t,
CASE WHEN doc_id % 11 = 5 THEN 'same' ELSE 'about ' || doc_id END AS def, CASE doc_id % 11 WHEN 3 THEN 'zz' || doc_id WHEN 4 THEN 'd' || (doc_id - 1) END AS p FROM documents),
RP AS (SELECT 'repeated key' AS "check", k AS subject FROM RG GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'repeated definition', def FROM RG GROUP BY def HAVING count(*) > 1 UNION ALL SELECT 'missing field', k FROM RG WHERE t = ''
UNION ALL SELECT 'unknown parent', k FROM RG WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM RG) UNION ALL SELECT 'depth', RG.k FROM RG JOIN RG h ON h.k = RG.p WHERE h.p IS NOT NULL
UNION ALL SELECT 'roots', n::VARCHAR FROM (SELECT count(*) AS n FROM RG WHERE p IS NULL) WHERE n NOT BETWEEN 12 AND 20)
"""


@query("WITH " + REGISTRY + 'SELECT "check", subject FROM RP', shimmed=False)
def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each document, with mistakes by its id."""
    i = F.col("doc_id")
    k, name = i % 11, lambda x: F.concat(F.lit("d"), x)
    registry = shim.table(spark, sf_dir, "documents").select(
        F.when(k == 1, name(i - 1)).otherwise(name(i)).alias("key"), F.when(k == 2, "").otherwise("T").alias("title"), F.when(k == 5, "same").otherwise(F.concat(F.lit("about "), i)).alias("definition"),
        F.array(F.lit("s1")).alias("seed_anchors"), F.when(k == 3, F.concat(F.lit("zz"), i)).when(k == 4, name(i - 1)).alias("parent"),
    )
    return S.registry_problems(registry)


@query("SELECT 'r' || p_size % 10 AS \"key\", count(DISTINCT p_type)::BIGINT AS chapters, count(DISTINCT p_type) >= 2 AS ok FROM part GROUP BY ALL", shimmed=False)
def span_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = shim.table(spark, sf_dir, "part")
    registry = part.groupBy(F.concat(F.lit("r"), F.col("p_size") % 10).alias("key")).agg(F.collect_set("p_name").alias("seed_anchors")).withColumn("parent", F.lit(None).cast("string"))
    chapters = part.select(F.col("p_name").alias("slug"), F.col("p_type").alias("chapter")).distinct()
    return S.span(registry, chapters).select("key", *big("chapters"), "ok")


ORACLES["span_check"] = "SELECT r.\"key\", count(DISTINCT c.p_type)::BIGINT AS chapters, count(DISTINCT c.p_type) >= 2 AS ok FROM (SELECT DISTINCT 'r' || p_size % 10 AS \"key\", p_name FROM part) r JOIN part c USING (p_name) GROUP BY r.\"key\""


@query("SELECT id, kind FROM (SELECT id, CASE WHEN ln % 20 = 3 THEN 'removed' WHEN ln % 20 = 5 THEN 'changed' END AS kind FROM R) WHERE kind IS NOT NULL")
def changed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.rules(spark, sf_dir).select("id", "ln", F.lit("t").alias("text"), "sections")
    after = r.where("ln % 20 <> 3").withColumn("text", F.when(F.col("ln") % 20 == 5, "u").otherwise(F.col("text")))
    return E.changed_rules(r, after)


@query("SELECT id FROM R WHERE ln % 20 = 5 UNION SELECT X.dst FROM X JOIN R ON R.id = X.src WHERE R.ln % 20 IN (3, 5)")
def affected_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shim.rules(spark, sf_dir)
    changed = r.where("ln % 20 in (3, 5)").select("id", F.when(F.col("ln") % 20 == 3, "removed").otherwise("changed").alias("kind"))
    return E.affected(changed, _directed(spark, sf_dir).withColumn("relation", F.lit("thematic")))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A graph of citations alone, without mirrors, pairs or one registered label."""
    spec = lambda c: F.concat_ws("/", "spec", c)
    r = shim.kept(shim.rules(spark, sf_dir).withColumn("rule", F.col("id")))
    rules = r.select("rule", F.when(F.size("sections") > 0, F.concat(F.array(F.col("spec").cast("string")), "sections")).otherwise(F.array(F.concat(F.lit("-"), "id"))).alias("sections"))
    b = shim.kept(shim.labels(spark, sf_dir).select("id", spec("label").alias("label")))
    x = shim.kept(_directed(spark, sf_dir, r).withColumn("direction", F.lit("none")).withColumn("via", F.lit(None).cast("array<string>")))
    registry = b.select(F.col("label").alias("key")).distinct().where(~F.col("key").endswith("k5"))
    wanted = E.label_groups(b).select("gid", "members").unionByName(E.section_groups(rules.withColumn("authority", F.lit(None).cast("string"))).select("gid", "members"))
    return rules, x, b, registry, wanted, rules


@query("SELECT \"check\", count(*)::BIGINT AS n FROM (SELECT 'no label' AS \"check\" FROM R WHERE id NOT IN (SELECT id FROM B) UNION ALL SELECT 'no mirror' FROM X x WHERE NOT EXISTS (SELECT 1 FROM X y WHERE y.src = x.dst AND y.dst = x.src) UNION ALL SELECT 'same_section' FROM R a JOIN R b ON a.doc_id = b.doc_id AND a.path = b.path AND a.id <> b.id UNION ALL SELECT 'shares_dimension' FROM (SELECT DISTINCT a.id, b.id AS j FROM B a JOIN B b ON a.doc_id = b.doc_id AND a.label = b.label AND a.id <> b.id) UNION ALL SELECT 'unknown label' FROM B WHERE label = 'k5') GROUP BY ALL")
def checks_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the builder's own checks find."""
    return K.grouped(*_checked(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT \"check\", count(*)::BIGINT AS n FROM (SELECT 'no label' AS \"check\" FROM R WHERE id NOT IN (SELECT id FROM B) UNION ALL SELECT 'no mirror' FROM X x WHERE NOT EXISTS (SELECT 1 FROM X y WHERE y.src = x.dst AND y.dst = x.src) UNION ALL SELECT 'same_section' FROM R a JOIN R b ON a.doc_id = b.doc_id AND a.path = b.path AND a.id <> b.id UNION ALL SELECT 'shares_dimension' FROM (SELECT DISTINCT a.id, b.id AS j FROM B a JOIN B b ON a.doc_id = b.doc_id AND a.label = b.label AND a.id <> b.id) UNION ALL SELECT 'unknown label' FROM B WHERE label = 'k5') GROUP BY ALL")
def checks_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What checks that don't share its code find."""
    return K.grouped_again(*_checked(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("n"))
