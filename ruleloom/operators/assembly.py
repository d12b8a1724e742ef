"""Whole graphs, dossiers, job payloads and requests, put together from the smaller operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as T

from . import edges as E
from . import lexing as L
from .dealing import cut


def titles(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spec, slug, title, and the slugs that several headings have."""
    repeated = tree.groupBy("spec", "slug").agg(F.count("*").alias("n")).where("n > 1")
    return tree.groupBy("spec", "slug").agg(F.min_by("title", "index").alias("title")), repeated


def locations(spans: DataFrame, tree: DataFrame) -> DataFrame:
    """spans (spec, first, last, section) with slug and path of their section."""
    return spans.join(tree.select("spec", F.col("index").alias("section"), "slug", "path"), ["spec", "section"], "left")


def ancestor_guards(tree: DataFrame, paragraphs: DataFrame, most: int = 3, words: int = 40) -> DataFrame:
    """spec, slug, k, anchor, quote: for each section the first paragraphs of its ancestors' own text, outermost first.

    paragraphs by section as lexing.paragraphs() gives them; of an ancestor those before its first child count."""
    own = L.preambles(tree).select("spec", F.col("index").alias("section"), F.col("first").alias("__f"), F.col("last").alias("__l"))
    first = paragraphs.join(own, ["spec", "section"]).where("first between __f and __l")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("spec", "section").orderBy("first"))).where(F.col("n") <= most)
    up = tree.select("spec", "slug", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("depth", "on"))
    at = up.join(L.slugs(tree).select("spec", F.col("slug").alias("on"), F.col("index").alias("section")), ["spec", "on"]).join(first, ["spec", "section"])
    k = F.row_number().over(Window.partitionBy("spec", "slug").orderBy("depth", "n"))
    return at.select("spec", "slug", k.alias("k"), F.concat(F.lit("#"), "on").alias("anchor"), T.clip(F.col("text"), words).alias("quote"))


def mechanical_graph(lines: DataFrame, rules: DataFrame, words: int = 40) -> tuple[DataFrame, DataFrame]:
    """Edges (spec, src, dst, relation, scope, via, anchor, quote) and section references of fenced lines and rules (spec, rule, examples).

    Relations: same_sentence, same_section, shares_example and cross_reference, each from what the lines say. Lines, tree, and the places of
    markers and links (found in one go) are cut, as every relation reads them; what is dealt out by document stays so."""
    lines = cut(lines.select("spec", "ln", "line", "fenced"))
    tree = cut(L.sections(lines))
    marks, links = L.markers(lines).withColumn("anchor", F.lit(None).cast("string")), L.links(lines).withColumn("rule", F.lit(None).cast("string"))
    spots = L.at_sentence(marks.unionByName(links), lines, cut)
    spots = cut(L.innermost(lines, tree).select("spec", "ln", "section").join(spots, ["spec", "ln"]).join(tree.select("spec", F.col("index").alias("section"), "path"), ["spec", "section"], "left"))
    at = spots.where("rule is not null").drop("anchor").join(rules.select("spec", "rule", "examples"), ["spec", "rule"])
    at = cut(at.withColumn("sections", F.coalesce("path", F.array().cast("array<string>"))).withColumn("key", F.array_join("sections", "/")))
    none = F.lit(None).cast("string")

    def edge(df: DataFrame, relation: str, via: Column = none) -> DataFrame:
        return df.select("spec", "src", "dst", F.lit(relation).alias("relation"), none.alias("scope"), via.alias("via"), none.alias("anchor"), none.alias("quote"))

    cited = spots.where("anchor is not null and section is not null").drop("rule").withColumn("section_path", F.array_join("path", "/"))
    xref, refs = E.citations(cited, at, L.slugs(tree), E.direct_owners(at), words)
    shown = at.select("spec", "rule", F.explode("examples").alias("example"))
    return (
        edge(E.pairs(at, "rule", ["spec", "block", "sentence"]), "same_sentence")
        .unionByName(edge(E.pairs(at, "rule", ["spec", "key"]), "same_section"))
        .unionByName(edge(E.pairs(shown, "rule", ["spec", "example"]), "shares_example", F.col("example")))
        .unionByName(xref.select("spec", "src", "dst", "relation", "scope", none.alias("via"), "anchor", "quote"))
    ), refs


def edge_counts(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """id, degree; rules without an edge have 0."""
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return rules.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def without_thematic(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """id of rules without a thematic edge."""
    return rules.select("id").join(edges.where("relation = 'thematic'").select(F.col("src").alias("id")), "id", "left_anti")


def groups_within(groups: DataFrame, members: DataFrame) -> DataFrame:
    """gid, members: groups cut down to the members (id); those left empty go."""
    kept = groups.select("gid", F.explode("members").alias("id")).join(members.select("id"), "id", "left_semi")
    return kept.groupBy("gid").agg(F.array_sort(F.collect_set("id")).alias("members"))


def outside_views(rules: DataFrame, authorities: list[str]) -> DataFrame:
    """Rules whose authority has no view."""
    return rules.where(~F.coalesce(F.col("authority").isin(*authorities), F.lit(False)))


def bridge_counts(bridges: DataFrame, first: DataFrame) -> DataFrame:
    """u, v, n (u <= v): bridges between units, by the unit of each rule's first copy (rule, unit)."""
    at = bridges.join(first.select(F.col("rule").alias("a"), F.col("unit").alias("x")), "a").join(first.select(F.col("rule").alias("b"), F.col("unit").alias("y")), "b")
    return at.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.count("*").alias("n"))


def authority_wide(units: DataFrame, whole: tuple[str, ...] = ("system", "developer")) -> DataFrame:
    """authority, key, members: one unit for each authority that is taken whole, the units as they are for the others."""
    key = F.when(F.col("authority").isin(*whole), F.lit("all")).otherwise(F.col("cid"))
    return units.select("authority", key.alias("key"), F.explode("members").alias("m")).groupBy("authority", "key").agg(F.array_sort(F.collect_set("m")).alias("members"))


def original(copy: Column) -> Column:
    """The rule of a copy."""
    return F.split_part(copy, F.lit("@"), F.lit(1))


def kept_items(items: DataFrame, anchors: DataFrame, rules: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (spec, subject, where, quote) whose place exists in their own document and whose quote is grounded in it, and the others with a
    reason. anchors: spec, slug; rules: spec, rule; documents: spec and the normalized text."""
    from .context import LEAST_QUOTE, held_quotes, needle

    df = items.withColumn("__a", F.regexp_extract("where", "^#(.+)$", 1)).withColumn("__r", F.regexp_extract("where", r"^(?:\[\^)?([^#\]]+)\]?$", 1)).withColumn("__n", needle(F.col("quote")))
    df = cut(df)  # a quote's form is looked up three times and made once
    df = df.join(anchors.select("spec", F.col("slug").alias("__a"), F.lit(True).alias("__x")).distinct(), ["spec", "__a"], "left")
    df = df.join(rules.select("spec", F.col("rule").alias("__r"), F.lit(True).alias("__y")).distinct(), ["spec", "__r"], "left")
    long = df.where(F.length("__n") >= LEAST_QUOTE).select("spec", F.col("__n").alias("quote"))
    df = df.join(held_quotes(long, documents).select("spec", F.col("quote").alias("__n"), F.lit(True).alias("__good")), ["spec", "__n"], "left")
    reason = F.when(F.col("__x").isNull() & F.col("__y").isNull(), "where").when(F.col("__good").isNull(), "quote")
    df = df.withColumn("reason", reason).select("spec", "subject", "where", "quote", "reason")
    return df.where("reason is null").drop("reason"), df.where("reason is not null")


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def verdict_note(verdict: Column, cause: Column, note: Column) -> Column:
    """`BAD[#cause]: note`, without what is missing."""
    return F.concat(verdict, F.coalesce(F.concat(F.lit("[#"), cause, F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(": "), note), F.lit("")))


def example_origins(rules: DataFrame, in_section: DataFrame, external: DataFrame) -> DataFrame:
    """rule, example, origin: the record's own (inventory), then the section's (same_section), then others (external)."""
    own = rules.select("rule", F.explode("examples").alias("example"), F.lit(0).alias("p"))
    df = own.unionByName(in_section.select("rule", "example", F.lit(1).alias("p"))).unionByName(external.select("rule", "example", F.lit(2).alias("p")))
    return df.groupBy("rule", "example").agg(F.min("p").alias("p")).select("rule", "example", F.element_at(F.array(*map(F.lit, ("inventory", "same_section", "external"))), F.col("p") + 1).alias("origin"))


def blinded(line: Column) -> Column:
    """A line without markers and link targets."""
    return F.regexp_replace(F.regexp_replace(line, T.ANY_TAG, ""), r"\[([^\]]*)\]\(#[^)]*\)", "$1")


def substituted(line: Column, table: list[tuple[str, str]]) -> Column:
    """Whole tokens replaced in the table's order, in the three common cases and with possessives."""
    for old, new in table:
        for a, b in dict.fromkeys([(old, new), (old.lower(), new.lower()), (old.upper(), new.upper())]):
            line = F.regexp_replace(line, rf"(?<![A-Za-z0-9_])\Q{a}\E(?![A-Za-z0-9_])", b.replace("\\", "\\\\").replace("$", "\\$"))
    return line


def substitution_counts(lines: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """token, n: how often each token of the table stands in the lines, whatever its case."""
    counts = [F.sum(F.regexp_count("line", F.lit(rf"(?i)(?<![A-Za-z0-9_])\Q{old}\E(?![A-Za-z0-9_])"))).alias(old) for old, _ in table]
    return lines.agg(*counts).select(F.explode(F.map_from_arrays(F.array(*(F.lit(o) for o, _ in table)), F.array(*(F.coalesce(F.col(f"`{o}`"), F.lit(0)).cast("long") for o, _ in table)))).alias("token", "n"))


def dossiers(rules: DataFrame, labels: DataFrame, memberships: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, sections, dimensions, groups, neighbor: a nested record for each rule; neighbours by relation, id, subtype, via."""
    dims = labels.groupBy(F.col("id").alias("rule")).agg(F.array_sort(F.collect_set("label")).alias("dimensions"))
    via = F.coalesce(F.array_join("via", ","), F.lit(""))
    near = edges.groupBy(F.col("src").alias("rule")).agg(F.sort_array(F.collect_list(F.struct(F.col("relation"), F.col("dst").alias("id"), F.coalesce("subtype", F.lit("")).alias("subtype"), via.alias("via"), F.col("direction")))).alias("neighbor"))
    return rules.join(dims, "rule", "left").join(memberships, "rule", "left").join(near, "rule", "left")


def section_payloads(rules: DataFrame, jobs: DataFrame) -> DataFrame:
    """job, sections [(spec, start, path, rules)]: rules (spec, path, rule, start) of each packet's sections, by first line (none first)."""
    by = rules.groupBy("spec", "path").agg(F.min(F.coalesce("start", F.lit(0))).alias("start"), F.array_sort(F.collect_set("rule")).alias("rules"))
    return by.join(jobs, ["spec", "path"]).groupBy("job").agg(F.sort_array(F.collect_list(F.struct("spec", "start", "path", "rules"))).alias("sections"))


def dimension_payloads(labels: DataFrame, registry: DataFrame, least: int = 2) -> DataFrame:
    """key, title, members of the registry's dimensions with at least so many rules."""
    by = labels.groupBy(F.col("label").alias("key")).agg(F.array_sort(F.collect_set("id")).alias("members"))
    return by.where(F.size("members") >= least).join(registry.select("key", "title"), "key").select("key", "title", "members")


def requests(prompts: DataFrame, model: str, most_output: int, system: str, effort: str | None = None) -> DataFrame:
    """custom_id, params of prompts (custom_id, prompt), in the shape of a request line."""
    fields = [F.lit(model).alias("model"), F.lit(most_output).alias("max_tokens"), F.lit(system).alias("system"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages")]
    if effort:
        fields.append(F.struct(F.lit(effort).alias("effort")).alias("output_config"))
    return prompts.select("custom_id", F.struct(*fields).alias("params"))


def pass_summary(outcomes: DataFrame) -> DataFrame:
    """One row: findings, failed (ids in order)."""
    return outcomes.agg(F.coalesce(F.sum(F.coalesce(F.size("findings"), F.lit(0))), F.lit(0)).alias("findings"), F.array_sort(F.collect_list(F.when(F.col("status") != "succeeded", F.col("custom_id")))).alias("failed"))


def taxonomy(conditions: dict[str, DataFrame | None]) -> DataFrame:
    """condition, verdict, n: PASS without violations, FAIL with n of them, SKIP where there was nothing to check by."""
    spark = next(d.sparkSession for d in conditions.values() if d is not None)
    out = [spark.createDataFrame([(c, "SKIP", 0)], "condition string, verdict string, n long") if d is None else d.agg(F.count("*").alias("n")).select(F.lit(c).alias("condition"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("verdict"), "n") for c, d in conditions.items()]
    return reduce(DataFrame.unionByName, out)
