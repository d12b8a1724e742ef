"""Context of rules and the packets and prompts of analysis units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as T

from .dealing import cut
from .partition import by_group

#: Notes that only repeat what the relation says. Fixed values.
PLAIN_NOTES = ["cited from the rule's own sentence", "cited by that rule's sentence"]


def passages_of_sections(passages: DataFrame, tree: DataFrame) -> DataFrame:
    """spec, anchor, passage: for every section the passages of all sections on its path, by path."""
    own = passages.join(tree.select("spec", F.col("index").alias("section"), F.col("slug").alias("on")), ["spec", "section"]).select("spec", "on", "passage")
    paths = tree.select("spec", F.col("slug").alias("anchor"), F.explode("path").alias("on"))
    return paths.join(own, ["spec", "on"]).select("spec", "anchor", "passage").distinct()


def searchable(passages: DataFrame, normal: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One text for each spec, its normalized passages joined by spaces, and the span (spec, passage, start, end) of each."""
    df = passages.withColumn("n", normal if normal is not None else T.normalize(F.col("text")))
    before = Window.partitionBy("spec").orderBy("passage").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("n") + 1).over(before), F.lit(0))
    spans = df.select("spec", "passage", start.alias("start"), (start + F.length("n")).alias("end"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("passage", "n"))), lambda x: x["n"]), " ")
    return df.groupBy("spec").agg(text.alias("text")), spans


#: Quotes of a document that one automaton holds; a document with more is read once for each group of so many.
QUOTES = 1 << 17
#: Characters of a stretch by which occurrences and passages meet.
STRETCH = 1024


def _beside(quotes: DataFrame, texts: DataFrame, of: str, schema: str, found: Callable[[object, str], Iterator[tuple]]) -> DataFrame:
    """What `found` yields for each text of a document and the automaton of the document's distinct quotes.

    Quotes and texts of a document come to one task, which takes its documents one after the other as a stream; the automaton is built once and
    each text is read once, however many quotes there are and whether or not they overlap. Null and empty quotes are nowhere."""
    quotes = quotes.select("spec", F.col(of).alias("__q")).where(F.col("__q") != "")
    # only documents of more quotes than one automaton holds go in groups; there are at most rows / QUOTES of them
    many = F.broadcast(quotes.groupBy("spec").agg(F.ceil(F.count("*") / QUOTES).cast("int").alias("__n")).where("__n > 1"))
    groups = F.coalesce("__n", F.lit(1))
    more = [c for c in texts.columns if c != "spec"]
    asked = quotes.join(many, "spec", "left").select("spec", F.pmod(F.xxhash64("__q"), groups).cast("int").alias("__g"), F.lit(False).alias("__held"), "__q", *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in more))
    held = texts.where("text is not null").join(many, "spec", "left").select("spec", F.explode(F.sequence(F.lit(0), groups - 1)).alias("__g"), F.lit(True).alias("__held"), F.lit(None).cast("string").alias("__q"), *more)
    key = quotes.schema["spec"].dataType.simpleString()

    def work(spec, _, rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton, ready = ahocorasick.Automaton(), False
        for is_text, quote, *values in rows:  # quotes come first
            if not is_text:
                automaton.add_word(quote, quote)
                continue
            if not ready:
                if not len(automaton):
                    return
                automaton.make_automaton()
                ready = True
            for x in found(automaton, dict(zip(more, values, strict=True))):
                yield (spec, *x)

    return by_group(asked.unionByName(held), ["spec", "__g"], work, f"spec {key}, {schema}", ("__held",))


def occurrences(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """spec, quote, start: every place (from 0) of a document's quotes in its text (spec, text), overlapping ones too."""

    def found(automaton, row: dict) -> Iterator[tuple]:
        return ((q, end - len(q) + 1) for end, q in automaton.iter(row["text"]))

    return _beside(quotes, texts.select("spec", "text"), "quote", "quote string, start bigint", found)


def held_quotes(quotes: DataFrame, texts: DataFrame, name: str | None = None) -> DataFrame:
    """spec, quote (and the text's name): which quotes stand in a document's text, or in each of its texts (spec, name, text)."""
    more = [name] if name else []

    def found(automaton, row: dict) -> Iterator[tuple]:
        return ((q, *(row[n] for n in more)) for q in {q for _, q in automaton.iter(row["text"])})

    schema = ", ".join(["quote string", *(f"{n} {texts.schema[n].dataType.simpleString()}" for n in more)])
    return _beside(quotes, texts.select("spec", *more, "text"), "quote", schema, found).distinct()


def needle(quote: Column) -> Column:
    """A quote as it is looked for: an omission is a blank."""
    return T.normalize(F.replace(quote, F.lit("[...]"), F.lit(" ")))


def quote_passages(quotes: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """spec, quote, passage: the passages that any occurrence of a quote touches, so also quotes across passages.

    Occurrences meet the spans of their own stretch of the text, by an equi-join."""
    needles = cut(quotes.select("spec", "quote").distinct().withColumn("needle", needle(F.col("quote"))).where("needle <> ''"))
    at = occurrences(needles.select("spec", F.col("needle").alias("quote")), texts).select("spec", F.col("quote").alias("needle"), F.col("start").alias("low"), (F.col("start") + F.length("quote")).alias("high"))
    stretches = lambda low, high: F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH)))
    left = at.withColumn("__s", stretches(F.col("low"), F.col("high")))
    right = spans.withColumn("__s", stretches(F.col("start"), F.col("end")))
    met = left.join(right, ["spec", "__s"]).where("low < end and high > start").select("spec", "needle", "passage").distinct()
    return met.join(needles, ["spec", "needle"]).select("spec", "quote", "passage").distinct()


#: Characters that a normalized quote has at least, to count as evidence.
LEAST_QUOTE = 12


def grounded(quote: Column, document: Column, least: int = LEAST_QUOTE) -> Column:
    """Whether a normalized quote of at least so many characters stands in the normalized document."""
    n = T.folded(F.replace(quote, F.lit("[...]"), F.lit(" ")))
    return F.coalesce((F.length(n) >= least) & (F.instr(document, n) > 0), F.lit(False))


def canonical_passages(refs: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of refs (unit, rule, passage): passages once for each text and unit, (unit, passage, text, commentary, sources) under the
    smallest id, and the refs to them. Passages with a `unit` are that unit's own."""
    used = refs.select("unit", "passage").distinct().join(passages, ["unit", "passage"] if "unit" in passages.columns else "passage")
    same = Window.partitionBy("unit", "text", "commentary")
    used = used.withColumn("canonical", F.min("passage").over(same))
    kept = used.groupBy("unit", "canonical").agg(F.first("text").alias("text"), F.first("commentary").alias("commentary"), F.array_sort(F.collect_list(F.struct("passage", "first", "last"))).alias("sources"))
    again = refs.join(used.select("unit", "passage", "canonical"), ["unit", "passage"]).select("unit", "rule", F.col("canonical").alias("passage")).distinct()
    return kept.withColumnRenamed("canonical", "passage"), again


def common_and_own(refs: DataFrame) -> DataFrame:
    """unit, passage, rule: rule is null for what all rules of the unit refer to, else a rule that refers to it."""
    rules = refs.groupBy("unit").agg(F.countDistinct("rule").alias("rules"))
    uses = refs.groupBy("unit", "passage").agg(F.countDistinct("rule").alias("uses")).join(rules, "unit")
    everywhere = uses.where("uses = rules").select("unit", "passage")
    own = refs.select("unit", "passage", "rule").distinct().join(everywhere, ["unit", "passage"], "left_anti")
    return everywhere.withColumn("rule", F.lit(None).cast(refs.schema["rule"].dataType)).unionByName(own)


def collapsed_relations(edges: DataFrame) -> DataFrame:
    """Unordered relations of a unit (unit, a, b, relation, subtype, source, via, evidence, notes): equal ones once, notes sorted.

    Evidence is part of what makes them equal; shares_dimension is left out, and notes that say nothing new are dropped."""
    note = F.when(~((F.col("relation") == "cross_reference") & F.col("note").isin(*PLAIN_NOTES)), F.col("note"))
    df = edges.where("relation <> 'shares_dimension'").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).withColumn("note", F.when(F.col("note").isNotNull(), note))
    return df.groupBy("unit", "a", "b", "relation", "subtype", "source", "via", "evidence").agg(F.array_sort(F.collect_set("note")).alias("notes"))


def facet_hints(facets: Column) -> Column:
    """Facets that say something: neither null nor the default."""
    return F.map_filter(facets, lambda k, v: v.isNotNull() & (v != "unconditional_or_unspecified"))


def facet(value: Column, name: str) -> tuple[Column, Column]:
    """A facet's value and what was specific in it: a known value stays, another short text becomes `applies`."""
    known = value.isin("applies", "not_applicable", "unconditional_or_unspecified")
    short = value.isNotNull() & (F.length(value) <= 40)
    default = F.lit(None).cast("string") if name == "state" else F.lit("unconditional_or_unspecified")
    return F.when(known, value).when(short, F.lit("applies")).otherwise(default), F.when(~known & short, value)


def rendered_passages(passages: DataFrame) -> DataFrame:
    """unit, text: passages (unit, passage, path, text) in order, with the path of headings wherever it changes."""
    by = Window.partitionBy("unit").orderBy("passage")
    heads = F.array_join(F.transform("path", lambda x: F.regexp_replace(x, r"^#+\s*", "")), " / ")
    new = ~F.lag("path").over(by).eqNullSafe(F.col("path"))
    df = passages.withColumn("t", F.concat(F.when(new & (F.size("path") > 0), F.concat(F.lit("Section: "), heads, F.lit("\n"))).otherwise(F.lit("")), F.concat(F.lit("["), F.col("passage"), F.lit("] "), F.col("text"))))
    return df.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("passage", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def packets(units: DataFrame, rules: DataFrame, passages: DataFrame, examples: DataFrame, relations: DataFrame) -> DataFrame:
    """unit and its nested context, examples, rules and relations; each child table has a `unit` column. Passages, examples and
    rules are in the order of their ids, relations in that of all their fields as JSON."""

    def nested(df: DataFrame, order: Column, name: str) -> DataFrame:
        row = F.struct(order.alias("k"), F.struct(*(c for c in df.columns if c != "unit")).alias("row"))
        by_key = F.array_sort(F.collect_list(row), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        return df.groupBy("unit").agg(F.transform(by_key, lambda x: x["row"]).alias(name))

    out = units.select("unit").distinct()
    whole = F.to_json(F.struct(*sorted(c for c in relations.columns if c != "unit")))
    for df, order, name in ((passages, F.col("passage"), "context"), (examples, F.col("example"), "examples"), (rules, F.col("rule"), "rules"), (relations, whole, "relations")):
        out = out.join(nested(df, order, name), "unit", "left")
    return out


def filled(template: str, slots: dict[str, Column]) -> Column:
    """A template with $name slots; every slot of the template must be given."""
    import re

    names = set(re.findall(r"\$([a-z_]+)", template))
    if names - set(slots):
        raise ValueError(f"slots without a value: {sorted(names - set(slots))}")
    parts = re.split(r"\$([a-z_]+)", template)
    return F.concat(*(slots[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def shared_context(context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) == "", "None.").otherwise(context)


def rotated(chapters: DataFrame, coders: int) -> DataFrame:
    """coder, chapter, place: each coder reads the chapters (chapter, n from 0) from another begin."""
    df = chapters.crossJoin(F.broadcast(chapters.agg(F.count("*").alias("total")))).withColumn("coder", F.explode(F.sequence(F.lit(0), F.lit(coders - 1))))
    return df.select("coder", "chapter", F.pmod(F.col("n") - F.col("coder"), F.col("total")).alias("place"))
