"""Rule records: index of markers, merge with extracted fragments, authority overrides, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.functions import text as T


def repeats(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, side: `missing` is expected and not found, `extra` the other way round."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order, which should be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key: the one with the largest order; an aggregate with partial results, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def flattened_fragments(fragments: DataFrame) -> DataFrame:
    """file, pos and the record's fields of both envelope shapes: records[], and fragments[].records[]."""
    inner = F.flatten(F.transform(F.coalesce("fragments", F.array().cast(dict(fragments.dtypes)["fragments"])), lambda x: x["records"]))
    both = F.concat(F.coalesce("records", F.array().cast(dict(fragments.dtypes)["records"])), F.coalesce(inner, F.array().cast(dict(fragments.dtypes)["records"])))
    return fragments.select("file", F.posexplode(both).alias("pos", "r")).select("file", "pos", "r.*")


def rule_index(markers: DataFrame, lines: DataFrame, tree: DataFrame) -> DataFrame:
    """spec, rule, ln, authority, system_flags, sections, text: a row for each marker."""
    from .lexing import at_sentence, innermost

    placed = innermost(lines, tree).select("spec", "ln", "section")
    owner = tree.select("spec", F.col("index").alias("section"), "authority", "path", "tags")
    df = at_sentence(markers, lines).join(placed, ["spec", "ln"]).join(owner, ["spec", "section"], "left")
    flags = F.coalesce(T.split_list(F.col("tags")), F.array().cast("array<string>"))
    return df.select("spec", "rule", "ln", "authority", flags.alias("system_flags"), F.coalesce("path", F.array().cast("array<string>")).alias("sections"), F.col("sentence_text").alias("text"))


def resolved_authority(index: DataFrame, overrides: DataFrame) -> DataFrame:
    """index with authority and provenance from overrides (rule, authority, reason) where the structure gives none."""
    o = overrides.select("rule", F.col("authority").alias("__a"), F.col("reason").alias("__r"))
    df = index.join(o, "rule", "left")
    provenance = F.when(F.col("__a").isNotNull(), F.col("__r")).otherwise("section_header")
    return df.withColumn("provenance", provenance).withColumn("authority", F.coalesce("authority", "__a")).drop("__a", "__r")


def override_problems(index: DataFrame, overrides: DataFrame) -> DataFrame:
    """rule, problem: overrides of unknown rules, of rules that inherit an authority, of no known authority or without a reason."""
    o = overrides.join(index.select("rule", F.col("authority").alias("__own"), F.lit(True).alias("__known")), "rule", "left")
    problem = (
        F.when(F.col("__known").isNull(), "unknown rule").when(F.col("__own").isNotNull(), "redundant")
        .when(~F.coalesce(F.col("authority").isin(*schema.AUTHORITIES), F.lit(False)), "unknown authority").when(F.coalesce(T.strip(F.col("reason")), F.lit("")) == "", "no reason")
    )
    return o.withColumn("problem", problem).where("problem is not null").select("rule", "problem")


def merged_rules(index: DataFrame, fragments: DataFrame) -> DataFrame:
    """Rule records in order of id: the index with each rule's first fragment record; unknown modalities become null."""
    first = first_wins(fragments, ["id"], [F.col("file"), F.col("pos")])
    modality = F.when(F.col("modality").isin(*schema.MODALITIES), F.col("modality"))
    df = index.join(first.withColumnRenamed("id", "rule").drop("file", "pos"), "rule")
    return df.withColumn("modality", modality).orderBy("rule")


def section_jobs(index: DataFrame) -> DataFrame:
    """sections, rules, n: the rules of each innermost section in order of place, most first, ties by path."""
    rules = F.transform(F.sort_array(F.collect_list(F.struct("ln", "rule"))), lambda x: x["rule"])
    return index.groupBy("spec", "sections").agg(rules.alias("rules"), F.count("*").alias("n")).orderBy(F.desc("n"), "sections")


def new_ids(untagged: DataFrame, tagged: DataFrame) -> DataFrame:
    """Ids zNNN for untagged places (spec, ln, col) after the highest z number in use, in document order; above z999 the number
    takes as many digits as it needs, so that no id comes twice. example: the ids egNNN of places whose kind is `example` (a
    column that may be missing), counted apart."""
    kind = F.col("kind") if "kind" in untagged.columns else F.lit("rule")
    places = untagged.withColumn("kind", F.coalesce(kind, F.lit("rule"))).withColumn("head", F.when(F.col("kind") == "example", "eg").otherwise("z"))
    used = F.regexp_extract("rule", r"^(z|eg)(\d{3,})$", 1).alias("head"), F.regexp_extract("rule", r"^(z|eg)(\d{3,})$", 2).alias("number")
    most = tagged.select("spec", *used).where("number <> ''").groupBy("spec", "head").agg(F.max(F.col("number").cast("int")).alias("most"))
    n = F.row_number().over(Window.partitionBy("spec", "head").orderBy("ln", "col")) + F.coalesce("most", F.lit(0))
    number = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(3)), F.lit("0"))
    return places.join(most, ["spec", "head"], "left").select("spec", "ln", "col", F.concat("head", number).alias("rule"))


def resolved_links(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines with [?](#anchor) labelled by the heading's title, and n, how many were; unknown anchors stay and count as unknown.

    A line's links are put in one after the other by a fold over its own title map, so no line is split or joined again."""
    pattern = r"\[\?\]\(#([A-Za-z0-9_-]+)\)"
    anchors = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
    df = lines.withColumn("__a", anchors)
    used = df.where(F.size("__a") > 0).select("spec", "ln", F.explode(F.array_distinct("__a")).alias("slug")).join(titles.select("spec", "slug", "title"), ["spec", "slug"])
    maps = used.groupBy("spec", "ln").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slug", "title")))).alias("__t"))
    df = df.join(maps, ["spec", "ln"], "left")
    known = F.filter("__a", lambda a: F.coalesce(F.map_contains_key("__t", a), F.lit(False)))
    line = F.aggregate(F.array_distinct(known), F.col("line"), lambda s, a: F.replace(s, F.concat(F.lit("[?](#"), a, F.lit(")")), F.concat(F.lit("["), F.try_element_at("__t", a), F.lit("](#"), a, F.lit(")"))))
    return df.select("spec", "ln", line.alias("line"), F.size(known).alias("n"), (F.size("__a") - F.size(known)).alias("unknown"))


#: What parts words, as in Python's str.split; a word that is one tag.
_BLANKS, _ONE_TAG = r"(?U)[\s\x1C-\x1F]+", T.ANY_TAG.replace("(?U)", "(?U)^") + "$"


def additions_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """spec, ok, place, word: whether a text's words are the other's with tags added only; the first place that differs.

    Each word of the text takes the next one of the other that isn't a tag alone, or is the same: with tags taken off, and all of its
    own tags kept. A fold over the other's words knows how many words it has met, so it stays in the JVM, one row a document; tags are
    looked at only where words differ."""
    words = lambda df, name: df.groupBy("spec").agg(F.filter(F.split(F.array_join(F.collect_list("text"), " "), _BLANKS), lambda x: x != "").alias(name))
    both = words(before, "was").join(words(after, "now"), "spec", "full")
    none = F.array().cast("array<string>")
    both = both.select("spec", F.coalesce("was", none).alias("was"), F.coalesce("now", none).alias("now"))
    state = lambda k, place, word: F.struct(k.alias("k"), place.cast("long").alias("place"), word.cast("string").alias("word"))
    null = F.lit(None)

    def step(s: Column, x: Column) -> Column:
        w = F.get(F.col("was"), s["k"])
        return (
            F.when(s["place"].isNotNull(), s)
            .when(w == x, state(s["k"] + 1, null, null))
            .when(w.isNotNull() & (T.bare(w) == T.bare(x)) & T.keeps_tags(w, x), state(s["k"] + 1, null, null))
            .when(x.rlike(_ONE_TAG), s)
            .otherwise(state(s["k"], s["k"] + 1, x))
        )

    met = both.withColumn("s", F.aggregate("now", state(F.lit(0), null, null), step))
    short = F.col("s.place").isNull() & (F.col("s.k") < F.size("was"))
    place = F.when(short, F.col("s.k") + 1).otherwise(F.col("s.place")).cast("long")
    word = F.when(short, F.get(F.col("was"), F.col("s.k"))).otherwise(F.col("s.word"))
    return met.select("spec", place.isNull().alias("ok"), place.alias("place"), word.alias("word"))
