"""Contexts of rules derived from the source, and the nested records made of them: dossiers, job payloads, packets of units.

Tables that several branches read are cut, as plans over uncut ones double with every branch; what is dealt out by document stays so."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.functions import text as T

from . import assembly as A
from . import context as C
from . import lexing as L
from .dealing import cut, stored


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def placed_bodies(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """spec, example, first, last, section, text of the examples whose body is whole."""
    at = L.innermost(lines, tree).select("spec", F.col("ln").alias("first"), "section")
    return L.example_bodies(lines).where("last is not null").join(at, ["spec", "first"])


def derived_contexts(tree: DataFrame, passages: DataFrame, bodies: DataFrame, rules: DataFrame, anchors: DataFrame, refs: DataFrame, quotes: DataFrame, governing: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each rule's judge must see: (spec, rule, passage, own), (spec, rule, example) and (spec, rule, problem, detail).

    rules: spec, rule, sections, examples; anchors: spec, rule, anchor (sections that evidence names); refs: spec, rule, ref (ids of
    rules and examples that it names); quotes: spec, rule, quote. Passages are those of every section on the paths of the rule's own,
    governing and named sections; those with a named rule's marker and of that marker's sections; the rule's own; and, for a
    quote that none of these holds, all that an occurrence of it touches. Examples are the record's, the named ones, those of the
    sections, and those whose tags stand in a passage. Quotes count up to their first [...]."""
    key = ["spec", "rule"]
    home = L.slugs(tree).select("spec", F.col("slug").alias("anchor"), "index")
    named = tree.select("spec", F.col("index").alias("section"), F.col("slug").alias("on"))
    marked = cut(passages.select("spec", "passage", "section", F.explode(F.array_distinct(T.rule_ids(F.col("text")))).alias("ref")))
    met = refs.select(*key, "ref").distinct().join(marked, ["spec", "ref"])
    shown = refs.select(*key, F.col("ref").alias("example")).join(bodies.select("spec", "example"), ["spec", "example"], "left_semi")
    own = rules.select(*key).join(marked.withColumnRenamed("ref", "rule"), key).select(*key, "passage")
    wanted = [rules.select(*key, F.explode("sections").alias("anchor")), anchors.select(*key, F.regexp_replace("anchor", "^#", "").alias("anchor")), met.join(named, ["spec", "section"]).select(*key, F.col("on").alias("anchor"))]
    if governing:
        wanted.append(rules.select(*key, F.explode(F.array(*map(F.lit, governing))).alias("anchor")))
    wanted = cut(union(*wanted).distinct())
    paths = tree.join(home.withColumnRenamed("anchor", "slug"), ["spec", "slug", "index"]).select("spec", F.col("slug").alias("anchor"), F.explode("path").alias("on"))
    reach = wanted.join(paths, ["spec", "anchor"]).select(*key, "on").distinct()
    near = reach.join(passages.join(named, ["spec", "section"]).select("spec", "on", "passage"), ["spec", "on"]).select(*key, "passage")
    own = cut(own.distinct())
    base = cut(union(near, met.select(*key, "passage"), own).distinct())
    # quotes that no passage so far holds are looked for in the whole text and in the examples; without quotes no text is read
    said = quotes.select(*key, F.element_at(F.split("quote", r"\[\.\.\.\]"), 1).alias("quote")).distinct().withColumn("quote", T.normalize(F.col("quote"))).where("quote <> ''").checkpoint()
    if said.isEmpty():
        open_ = said.limit(0)
        found, inside = (open_.select(*key, "quote", F.lit("").alias(c)) for c in ("passage", "example"))
    else:
        normal = passages.select("spec", "passage", T.normalize(F.col("text")).alias("n"))
        held = said.join(base, key).join(normal, ["spec", "passage"]).where("instr(n, quote) > 0").select(*key, "quote").distinct()
        open_ = said.join(held, [*key, "quote"], "left_anti").checkpoint()
        found = C.quote_passages(open_, *C.searchable(passages)).join(open_, ["spec", "quote"]).select(*key, "quote", "passage").checkpoint()
        inside = C.held_quotes(open_, bodies.select("spec", "example", T.normalize(F.col("text")).alias("text")), "example")
        inside = inside.join(open_, ["spec", "quote"]).select(*key, "quote", "example").checkpoint()
    every = union(base, found.select(*key, "passage")).distinct()
    tags = passages.select("spec", "passage", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.EXAMPLE_MARKER), F.lit(1)))).alias("example"))
    examples = union(
        rules.select(*key, F.explode("examples").alias("example")), shown, inside.select(*key, "example"),
        reach.join(bodies.join(named, ["spec", "section"]).select("spec", "on", "example"), ["spec", "on"]).select(*key, "example"),
        every.join(tags, ["spec", "passage"]).select(*key, "example"),
    ).distinct()

    def problem(df: DataFrame, name: str, detail: str | None = None) -> DataFrame:
        return df.select(*key, F.lit(name).alias("problem"), (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"))

    problems = union(
        problem(wanted.join(home, ["spec", "anchor"], "left_anti"), "unknown section", "anchor"),
        problem(rules.select(*key).join(own.select(*key), key, "left_anti"), "no marker"),
        problem(refs.select(*key, "ref").distinct().join(marked.select("spec", "ref"), ["spec", "ref"], "left_anti").join(bodies.select("spec", F.col("example").alias("ref")), ["spec", "ref"], "left_anti"), "unknown reference", "ref"),
        problem(open_.join(found.select(*key, "quote"), [*key, "quote"], "left_anti").join(inside.select(*key, "quote"), [*key, "quote"], "left_anti"), "ungrounded quote", "quote"),
        problem(examples.join(bodies.select("spec", "example"), ["spec", "example"], "left_anti"), "missing example", "example"),
    )
    mine = own.withColumn("own", F.lit(True))
    return every.join(mine, [*key, "passage"], "left").withColumn("own", F.coalesce("own", F.lit(False))), examples.join(bodies.select("spec", "example"), ["spec", "example"], "left_semi"), problems


def mechanical_context(lines: DataFrame, words: int = 40) -> DataFrame:
    """spec, rule and what the lines alone say of it: line, section_anchor, sections, sentence, stem, framing, ancestor_guards [(where, quote)],
    commentary [(where, quote)] of its section, section_examples [(id, title, verdicts)]. Lines that lexing.placed() gave their section are
    taken as they are (and read again and again), others are placed and stored."""
    here = lines if {"section", "header_line", "path"} <= set(lines.columns) else stored(L.placed(lines))
    lines = here.select("spec", "ln", "line", "fenced")
    tree = stored(L.sections(lines).select("spec", "index", "level", "slug", "path", "header_line", "end_line", "child_start"))
    at = here.select("spec", "ln", "section", F.element_at("path", -1).alias("section_anchor"))
    marks = L.at_sentence(L.markers(lines), lines, stored).join(here.select("spec", "ln", "section", F.element_at("path", -1).alias("section_anchor"), F.col("path").alias("sections")), ["spec", "ln"])
    guards = A.ancestor_guards(tree, L.paragraphs(here.select("spec", "ln", "line", "fenced", "section")), words=words).groupBy("spec", F.col("slug").alias("section_anchor")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "anchor", "quote"))), lambda x: F.struct(x["anchor"].alias("where"), x["quote"].alias("quote"))).alias("ancestor_guards"))
    said = L.commentary(lines).join(at.where("section is not null"), ["spec", "ln"])
    said = said.groupBy("spec", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("ln", F.concat(F.lit("#"), "section_anchor").alias("where"), T.clip(F.col("text"), words).alias("quote")))), lambda x: F.struct(x["where"].alias("where"), x["quote"].alias("quote"))).alias("commentary"))
    shown = L.example_records(lines).join(at, ["spec", "ln"]).groupBy("spec", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("ln", "example", "title", "verdicts"))), lambda x: F.struct(x["example"].alias("id"), x["title"].alias("title"), x["verdicts"].alias("verdicts"))).alias("section_examples"))
    df = marks.join(L.stems(lines, L.markers(lines), words), ["spec", "ln"], "left").join(guards, ["spec", "section_anchor"], "left").join(said, ["spec", "section"], "left").join(shown, ["spec", "section"], "left")
    return df.select("spec", "rule", F.col("ln").alias("line"), "section_anchor", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.col("sentence_text").alias("sentence"), "stem", "framing", "ancestor_guards", "commentary", "section_examples")


def _quoted(context: str, name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct(F.concat(F.lit("#"), context).alias("where"), F.col(name).alias("quote")))


def grouped_records(rules: DataFrame, contexts: DataFrame, enriched: DataFrame, memberships: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """A rule's whole record: its own fields, dimensions, groups, neighbor, and related_context of fifteen parts.

    rules: spec and the fields of schema.RULE with `rule` for id, and authority_provenance; contexts as mechanical_context() gives
    them; enriched: spec, rule, dimensions, definitions, meta_resolution, exceptions, facets, facet_specifics, facet_evidence,
    external_examples [(id, housed_in, why, verdict_notes)], coverage_notes; memberships: spec, rule, groups; edges: spec, src and the
    fields of a neighbour; references: spec, rule, anchor, scope, quote."""
    key = ["spec", "rule"]
    fields = ["id", "relation", "subtype", "direction", "source", "via", "evidence", "note"]
    order = lambda e: F.struct(e["relation"].alias("relation"), e["id"].alias("id"), F.coalesce(e["subtype"], F.lit("")).alias("subtype"), F.coalesce(F.array_join(e["via"], ","), F.lit("")).alias("via"), e.alias("e"))
    near = edges.groupBy("spec", F.col("src").alias("rule")).agg(F.transform(F.array_sort(F.transform(F.collect_list(F.struct(F.col("dst").alias("id"), *fields[1:])), order)), lambda x: x["e"]).alias("neighbor"))
    cited = references.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("#"), "anchor").alias("anchor"), "scope", "quote"))).alias("section_references"))
    df = rules.drop("sections").join(contexts, key).join(enriched, key, "left").join(memberships, key, "left").join(near, key, "left").join(cited, key, "left")
    facets = F.map_from_arrays(F.array(*map(F.lit, schema.FACETS)), F.array(*(F.lit(None).cast("string") if f == "state" else F.lit("unconditional_or_unspecified") for f in schema.FACETS)))
    none = F.array().cast("array<struct<id:string,housed_in:string,origin:string,title:string,verdict_notes:array<string>>>")
    notes = lambda ex: F.transform(ex["verdicts"], lambda v: A.verdict_note(v["verdict"], v["cause"], v["note"]))
    own = F.transform("section_examples", lambda x: F.struct(x["id"].alias("id"), F.concat(F.lit("#"), "section_anchor").alias("housed_in"), F.when(F.array_contains(F.col("examples"), x["id"]), "inventory").otherwise("same_section").alias("origin"), x["title"].alias("title"), notes(x).alias("verdict_notes")))
    far = F.transform("external_examples", lambda x: F.struct(x["id"].alias("id"), x["housed_in"].alias("housed_in"), F.lit("external").alias("origin"), x["why"].alias("title"), F.coalesce(x["verdict_notes"], F.array().cast("array<string>")).alias("verdict_notes")))
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    related = F.struct(
        F.col("sentence"), _quoted("section_anchor", "stem").alias("stem"), _quoted("section_anchor", "framing").alias("framing"),
        empty("ancestor_guards", "array<struct<where:string,quote:string>>").alias("ancestor_guards"), *(empty(c, dict(enriched.dtypes)[c]).alias(c) for c in ("definitions", "meta_resolution", "exceptions")),
        F.coalesce("facets", facets).alias("facets"), F.coalesce("facet_specifics", F.create_map().cast("map<string,string>")).alias("facet_specifics"), empty("facet_evidence", dict(enriched.dtypes)["facet_evidence"]).alias("facet_evidence"),
        F.concat(F.coalesce(own, none), F.coalesce(far, none)).alias("examples"),
        F.coalesce(F.transform("commentary", lambda c: F.struct(c["where"].alias("where"), c["quote"].alias("quote"), F.lit(False).alias("normative"))), F.array().cast("array<struct<where:string,quote:string,normative:boolean>>")).alias("commentary"),
        F.coalesce("section_references", F.array().cast("array<struct<anchor:string,scope:string,quote:string>>")).alias("section_references"), F.col("authority_provenance"), F.col("coverage_notes"),
    )
    fixed = [c for c in ("authority", "system_flags", "sections", "text", "trigger", "behavior", "modality", "examples") if c in df.columns]
    neighbor = F.coalesce("neighbor", F.array().cast(f"array<struct<{schema.NEIGHBOR}>>"))
    return df.select(*key, *fixed, empty("dimensions", "array<string>").alias("dimensions"), F.coalesce(F.array_sort("groups"), F.array().cast("array<string>")).alias("groups"), neighbor.alias("neighbor"), related.alias("related_context"))


def section_members(records: DataFrame, contexts: DataFrame, edges: DataFrame, jobs: DataFrame, spans: DataFrame) -> DataFrame:
    """job_id, spec, start_line, section_path, end_line, marker_ids, rules: section_jobs() as a row for each section, in any order, so that no
    row or task holds a packet."""
    key, place = ["spec", "rule"], ["spec", "path"]
    xref = edges.groupBy("spec", F.col("src").alias("rule")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("target_id"), "anchor", F.col("quote").alias("citing_sentence")))).alias("cross_reference_edges"))
    df = records.drop("sections").join(contexts, key).join(xref, key, "left").withColumn("path", F.array_join("sections", "/"))
    entry = F.struct("rule", *(c for c in df.columns if c not in ("spec", "rule", "path")))
    by = df.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("rule", entry.alias("e")))).alias("r")).join(jobs, place).join(spans, place, "left")
    return by.select(F.col("job").alias("job_id"), "spec", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.col("path").alias("section_path"), "end_line", F.transform("r", lambda x: x["rule"]).alias("marker_ids"), F.transform("r", lambda x: x["e"]).alias("rules"))


def section_jobs(records: DataFrame, contexts: DataFrame, edges: DataFrame, jobs: DataFrame, spans: DataFrame) -> DataFrame:
    """job_id, rule_count, section_count, sections: every packet's sections by first line with whole entries of their rules.

    records: spec, rule and fields; jobs: spec, path, job; spans: spec, path, start_line, end_line; edges: spec, src, dst, anchor, quote."""
    by = section_members(records, contexts, edges, jobs, spans)
    section = F.struct(*(c for c in by.columns if c != "job_id"))
    sections = F.array_sort(F.collect_list(section), lambda a, b: F.when(F.struct(a["spec"], a["start_line"], a["section_path"]) < F.struct(b["spec"], b["start_line"], b["section_path"]), -1).otherwise(1))
    return by.groupBy("job_id").agg(F.sum(F.size("rules")).alias("rule_count"), F.count("*").alias("section_count"), sections.alias("sections"))


def dimension_members(records: DataFrame, labels: DataFrame, registry: DataFrame, least: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """key, title, definition, member_count, spec, rule and the fields of records: dimension_jobs() as a row for each member, in any order, so
    that no row or task holds a dimension. keep writes the members once, as they are counted and read; without it they are made each time."""
    by = labels.select("spec", F.col("id").alias("rule"), F.col("label").alias("key")).distinct().join(F.broadcast(registry.select("key")), "key", "left_semi")
    members = keep(by.join(records, ["spec", "rule"]).select("key", *records.columns))
    counts = members.groupBy("key").agg(F.count("*").alias("member_count")).where(F.col("member_count") >= least)
    heads = registry.join(counts, "key").select("key", "title", "definition", "member_count")
    return members.join(F.broadcast(heads), "key").select(*heads.columns, *records.columns)


def dimension_jobs(records: DataFrame, labels: DataFrame, registry: DataFrame, least: int = 2) -> DataFrame:
    """key, title, definition, member_count, members: whole entries of each dimension's rules; dimensions of fewer rules have none."""
    entry = F.struct("rule", *(c for c in records.columns if c not in ("spec", "rule")))
    by = labels.select("spec", F.col("id").alias("rule"), F.col("label").alias("key")).distinct().join(records, ["spec", "rule"])
    members = by.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("spec", "rule", entry.alias("e"))), lambda a, b: F.when((a["spec"] < b["spec"]) | ((a["spec"] == b["spec"]) & (a["rule"] < b["rule"])), -1).otherwise(1)).alias("m"))
    return members.where(F.size("m") >= least).join(registry, "key").select("key", "title", "definition", F.size("m").alias("member_count"), F.transform("m", lambda x: x["e"]).alias("members"))


def unit_packets(units: DataFrame, nodes: DataFrame, records: DataFrame, contexts: DataFrame, examples: DataFrame, passages: DataFrame, bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, group_key, provenance, context, examples, rules, relations of every unit, ready to be rendered.

    units: unit, authority, cid, provenance, members (copies); nodes: copy, rule, context; records: rule and its fields, with facets and
    facet_specifics; contexts: rule, passage, own; examples: rule, example; passages: passage, text, commentary, first, last; bodies:
    example, text; edges as collapsed_relations() takes them, without `unit`. Equal passages are one, under the smallest id.
    Of nodes, records, contexts and passages, those that have `unit` too are each unit's own and are joined within it, so that tables dealt out
    by unit stay where they are."""
    on = lambda df, c: ["unit", c] if "unit" in df.columns else c
    roles = units.select("unit", F.explode("members").alias("copy")).join(nodes, on(nodes, "copy")).groupBy("unit", "rule").agg(F.array_sort(F.collect_set("context")).alias("dimension_roles_in_group"))
    roles = cut(roles)
    refs = cut(roles.select("unit", "rule").join(contexts, on(contexts, "rule")).select("unit", "rule", "passage", "own"))
    kept, mapped = C.canonical_passages(refs.select("unit", "rule", "passage"), passages)
    kept, mapped = cut(kept), cut(mapped)
    same = kept.select("unit", F.col("passage").alias("canonical"), F.explode("sources").alias("s")).select("unit", F.col("s.passage").alias("passage"), "canonical")
    sources = refs.where("own").join(same, ["unit", "passage"]).groupBy("unit", "rule").agg(F.array_sort(F.collect_set("canonical")).alias("source_text_refs"))
    around = mapped.groupBy("unit", "rule").agg(F.array_sort(F.collect_set("passage")).alias("context_refs"))
    shown = roles.select("unit", "rule").join(examples, "rule")
    used = shown.groupBy("unit", "rule").agg(F.array_sort(F.collect_set("example")).alias("example_refs"))
    full = roles.join(records, on(records, "rule")).join(sources, ["unit", "rule"], "left").join(around, ["unit", "rule"], "left").join(used, ["unit", "rule"], "left")
    hints = C.facet_hints(F.col("facets"))
    full = full.withColumn("extracted_scope_hints", F.when(F.size(hints) > 0, F.struct(hints.alias("facets"), F.col("facet_specifics").alias("specifics")))).drop("facets", "facet_specifics", "spec")
    members = roles.select("unit", F.col("rule").alias("r"))
    within = edges.join(members.withColumnRenamed("r", "src"), "src").join(members.withColumnRenamed("r", "dst"), ["unit", "dst"])
    relations = C.collapsed_relations(within)
    bodies_of = shown.select("unit", "example").distinct().join(bodies.select("example", "text"), "example")
    packed = C.packets(units, full, kept, bodies_of, relations)
    key = F.concat_ws("/", "authority", "cid")
    return units.select("unit", key.alias("group_key"), "provenance").join(packed, "unit")
