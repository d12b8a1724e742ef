"""The typed graph of rules: pair joins, citations, mirrors, dedup, groups and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.functions import text as T

from .rules import first_wins

#: direction seen from the other end
INVERSE = {"out": "in", "in": "out", "none": "none"}


def inverse(direction: Column) -> Column:
    return F.when(direction == "out", "in").when(direction == "in", "out").otherwise("none")


def pairs(df: DataFrame, id_: str, keys: list[str]) -> DataFrame:
    """Ordered pairs src <> dst of one key: an equi-join, so that hot keys are split by AQE. What is repeated goes before the join
    and not among its pairs."""
    once = df.select(*keys, F.col(id_).alias("src")).distinct()
    return once.join(once.withColumnRenamed("src", "dst"), keys).where("src <> dst").select("src", "dst", *keys)


def shared_labels(labels: DataFrame, within: list[str] | None = None) -> DataFrame:
    """src < dst and via, the sorted labels that both have: an intersection join as an equi-join on the label.

    labels is long form (id, label, and the columns of `within`, which both must share)."""
    keys = [*(within or []), "label"]
    a = labels.select(*keys, F.col("id").alias("src"))
    met = a.join(labels.select(*keys, F.col("id").alias("dst")), keys).where("src < dst")
    return met.groupBy(*(within or []), "src", "dst").agg(F.array_sort(F.collect_set("label")).alias("via"))


def direct_owners(rules: DataFrame) -> DataFrame:
    """spec, anchor, rule: rules by the last section of their path."""
    return rules.where(F.size("sections") > 0).select("spec", F.element_at("sections", -1).alias("anchor"), "rule")


def citations(links: DataFrame, rules: DataFrame, slugs: DataFrame, owners: DataFrame, words: int = 40) -> tuple[DataFrame, DataFrame]:
    """Edges and section references of links (spec, ln, col, anchor, block, sentence, sentence_text, section_path).

    A link in a rule's own sentence to a section that owns rules is an edge of that rule to each of them; any other link
    is a reference of the sentence's rules or, without any, of the section's. rules: spec, rule, block, sentence, sections."""
    known = links.join(slugs.select("spec", F.col("slug").alias("anchor")), ["spec", "anchor"], "left_semi")
    known = known.withColumn("quote", T.clip(F.col("sentence_text"), words))
    own = known.join(rules.select("spec", "block", "sentence", F.col("rule").alias("src")), ["spec", "block", "sentence"], "left")
    targets = owners.groupBy("spec", "anchor").agg(F.array_sort(F.collect_set("rule")).alias("targets"))
    own = own.join(targets, ["spec", "anchor"], "left")
    edge = own.where("src is not null and targets is not null").select("spec", "src", F.explode("targets").alias("dst"), "anchor", "quote", "ln", "col").where("src <> dst")
    edge = first_wins(edge, ["spec", "src", "dst"], [F.col("ln"), F.col("col")]).withColumn("relation", F.lit("cross_reference")).withColumn("scope", F.lit("sentence"))
    inside = own.where("src is not null and targets is null").select("spec", F.col("src").alias("rule"), "anchor", F.lit("sentence").alias("scope"), "quote", "ln")
    members = rules.select("spec", F.array_join("sections", "/").alias("section_path"), "rule")
    around = own.where("src is null").join(members, ["spec", "section_path"]).select("spec", "rule", "anchor", F.lit("section").alias("scope"), "quote", "ln")
    return edge.drop("col"), inside.unionByName(around)


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, direction, ...) and their mirrors with the direction seen from there; rank 0 and 1."""
    back = edges.withColumn("__s", F.col("dst")).withColumn("dst", F.col("src")).withColumn("src", F.col("__s")).drop("__s").withColumn("direction", inverse(F.col("direction")))
    return edges.withColumn("rank", F.lit(0)).unionByName(back.withColumn("rank", F.lit(1)))


def deduplicated(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first edge of a key; null keys are equal. Of two rules that cite each other the first by order keeps `out`."""
    return first_wins(edges, keys, order)


def undirected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each unordered pair and key: a < b."""
    df = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return df.select("a", "b", *keys).dropDuplicates(["a", "b", *keys])


def asymmetric(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges without a mirror of the inverse direction and equal keys (nulls are equal)."""
    back = edges.select(F.col("dst").alias("s"), F.col("src").alias("d"), inverse(F.col("direction")).alias("dir"), *(F.col(k).alias(f"k_{k}") for k in keys)).distinct()
    on = (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")) & (F.col("direction") == F.col("dir"))
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return edges.join(back, on, "left_anti")


def bad_terms(edges: DataFrame) -> DataFrame:
    """Edges with a term outside the vocabularies, and which: relation, subtype, direction."""
    relation, subtype = F.col("relation"), F.col("subtype")
    fits = F.when(relation == "cross_reference", subtype.isNull() | subtype.isin(*schema.XREF_SUBTYPES)).when(relation == "thematic", subtype.isin(*schema.THEMATIC_SUBTYPES)).otherwise(subtype.isNull())
    problem = F.when(~F.coalesce(relation.isin(*schema.RELATIONS), F.lit(False)), "relation").when(~F.coalesce(fits, F.lit(False)), "subtype").when(~F.coalesce(F.col("direction").isin(*INVERSE), F.lit(False)), "direction")
    return edges.withColumn("problem", problem).where("problem is not null")


def label_groups(labels: DataFrame) -> DataFrame:
    """gid, members, n: the rules of each label; labels without rules have no group."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_set("id")).alias("members")).select(F.concat(F.lit("dim:"), F.col("label")).alias("gid"), "members", F.size("members").alias("n"))


def section_groups(rules: DataFrame) -> DataFrame:
    """gid, members, n, authorities: the rules of each section, and their authorities as text; with spec, if the rules have it, as sections of
    different documents may have one path."""
    path, by = F.array_join("sections", "/"), ["spec"] if "spec" in rules.columns else []
    df = rules.groupBy(*by, path.alias("path")).agg(F.array_sort(F.collect_set("rule")).alias("members"), F.array_join(F.array_sort(F.collect_set("authority")), ", ").alias("authorities"))
    return df.select(*by, F.concat(F.lit("sec:"), F.col("path")).alias("gid"), "members", F.size("members").alias("n"), "authorities")


def groups_of_rules(groups: DataFrame) -> DataFrame:
    return groups.select("gid", F.explode("members").alias("rule")).groupBy("rule").agg(F.array_sort(F.collect_set("gid")).alias("groups"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends are both among the members (id)."""
    return edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")


def semantic_only(edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without same_section edges and section groups; same_sentence edges stay."""
    return edges.where("relation <> 'same_section'"), groups.where(~F.col("gid").startswith("sec:"))


def unrelated_thematic(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Thematic pairs without a label in common, tested on the edges that there are."""
    held = labels.groupBy("id").agg(F.collect_set("label").alias("set"))
    of = lambda x: held.select(F.col("id").alias(x), F.col("set").alias(f"of_{x}"))
    pair = undirected(edges.where("relation = 'thematic'"), [])
    return pair.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False))).select("a", "b")


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """id of rules to label again: those that changed, and the thematic partners that changed or removed rules had."""
    partners = edges.where("relation = 'thematic'").join(changed.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return changed.where("kind <> 'removed'").select("id").unionByName(partners).distinct()


def changed_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, kind (added, removed, changed): rules whose text or sections differ."""
    a, b = (x.select("id", F.sha2(F.to_json(F.struct("text", "sections")), 256).alias(n)) for x, n in ((before, "h0"), (after, "h1")))
    kind = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return a.join(b, "id", "full").withColumn("kind", kind).where("kind is not null").select("id", "kind")
