"""Structure recovery: fences, sections, blocks, sentences, markers, examples, links and commentary from (spec, ln, line).

All state is kept by window functions over one document's lines, so the work is dealt out by document and no driver loop or
self join is needed; a tree of sections takes six running maxima, one for each heading level. Where documents may be huge, `chunk`
(lines) deals the lines of one document out too: fences, sections, innermost and blocks then go by chunks of lines, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as T

from . import chunks
from .chunks import scan

LEVELS = range(1, 7)

def _by():
    """A document's lines in order. A function, as windows need a session that may not be there on import."""
    return Window.partitionBy("spec").orderBy("ln")


def _so_far():
    return _by().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return _by().rowsBetween(Window.unboundedPreceding, -1)


def _after():
    return _by().rowsBetween(1, Window.unboundedFollowing)


def _blank(c: Column) -> Column:
    return T.strip(c) == ""


def _begins(mark: str) -> Column:
    """Whether a line begins with the mark, past blanks; lines without the mark, which are most, aren't stripped."""
    return F.when(~F.contains("line", F.lit(mark)), False).otherwise(F.regexp_replace("line", r"(?U)^\s+", "").startswith(mark))


def simple_fences(lines: DataFrame, is_fence: Column | None = None) -> DataFrame:
    """fenced by ~~~ alone; the fence lines are fenced."""
    mark = F.coalesce(is_fence if is_fence is not None else _begins("~~~"), F.lit(False))
    return lines.withColumn("__m", mark.cast("int")).withColumn("fenced", (F.col("__m") == 1) | (F.sum("__m").over(_so_far()) % 2 == 1)).drop("__m")


def fences(lines: DataFrame, chunk: int | None = None) -> DataFrame:
    """fenced by ~~~ or, outside those, ```; the fence lines are fenced."""
    tilde, backtick = _begins("~~~"), _begins("```")
    if chunk is not None:
        return chunks.fences(lines, tilde, backtick, chunk)
    df = lines.withColumn("__t", tilde.cast("int")).withColumn("__in", F.sum("__t").over(_so_far()) % 2 == 1)
    df = df.withColumn("__k", (~F.col("__in") & (F.col("__t") == 0) & backtick).cast("int"))
    return df.withColumn("fenced", (F.col("__t") == 1) | F.col("__in") | (F.col("__k") == 1) | (F.sum("__k").over(_so_far()) % 2 == 1)).drop("__t", "__in", "__k")


def _is_heading() -> Column:
    return ~F.col("fenced") & F.col("line").rlike(T.HEADER)


def _heading_fields() -> dict[str, Column]:
    attributes, title = T.header_attributes(F.col("line")), T.header_title(F.col("line"))
    return {"level": T.header_level(F.col("line")), "slug": F.coalesce(T.anchor(attributes), T.slug(title)), "title": title, "own_authority": T.attribute(attributes, "authority"), "own_tags": T.attribute(attributes, "tags")}


def headings(lines: DataFrame) -> DataFrame:
    """spec, ln, level, slug, title, own_authority, own_tags of the headings outside fences."""
    last = ["last"] if "last" in lines.columns else []
    return lines.where(_is_heading()).select("spec", "ln", *last, *(c.alias(n) for n, c in _heading_fields().items()))


def _nested(heads: DataFrame, chunk: int | None = None) -> DataFrame:
    """Heads with index, parent, path, authority and tags, and what comes after them (__next, __n1 to __n6); see section_tree().

    Rows without a level are no heads: they change nothing for others, and have no values of their own but index, that of the last head."""
    here = F.struct("ln", "index", "slug", "own_authority", "own_tags")
    df = scan(heads, {"index": ("total", F.col("level").isNotNull().cast("int"))}, chunk).withColumn("index", (F.col("index") - 1).cast("int"))
    wanted = {"__next": ("following", F.struct("ln", "level"))}
    for m in LEVELS:
        wanted |= {f"__l{m}": ("highest_before", F.when(F.col("level") == m, here)), f"__n{m}": ("lowest_after", F.when(F.col("level") == m, F.col("ln")))}
    df = scan(df, wanted, chunk)
    open_ = []
    for m in LEVELS:
        above = [F.coalesce(F.col(f"__l{j}.ln"), F.lit(0)) for j in range(1, m)]
        ok = (F.col("level") > m) & F.col(f"__l{m}").isNotNull()
        if above:
            ok &= F.col(f"__l{m}.ln") > (F.greatest(*above) if len(above) > 1 else above[0])
        open_.append(F.when(ok, F.col(f"__l{m}")))
    df = df.withColumn("__up", F.filter(F.array(*open_), lambda x: x.isNotNull()))
    chain = lambda field: F.filter(F.transform("__up", lambda x: x[field]), lambda x: x.isNotNull())
    last = lambda a: F.element_at(F.when(F.size(a) > 0, a), -1)
    df = df.withColumn("parent", last(F.col("__up"))["index"]).withColumn("path", F.concat(F.transform("__up", lambda x: x["slug"]), F.array("slug")))
    return df.withColumn("authority", F.coalesce("own_authority", last(chain("own_authority")))).withColumn("tags", F.coalesce("own_tags", last(chain("own_tags"))))


def section_tree(heads: DataFrame, chunk: int | None = None) -> DataFrame:
    """spec, index, level, slug, title, path, authority, tags, parent, header_line, end_line, child_start.

    Of heads (spec, ln, level, slug, title, own_authority, own_tags, and last, the document's last line). The open section of level m
    before a heading is the last one of that level if no heading of a smaller level came after it; the open ones of
    smaller levels are the ancestors. A child's authority and tags are its own or those of the nearest ancestor that has some."""
    ends = [F.when(F.col("level") >= m, F.col(f"__n{m}")) for m in LEVELS]
    df = _nested(heads, chunk).withColumn("__end", F.least(*ends) - 1)
    df = df.withColumn("end_line", F.coalesce("__end", "last"))
    # the first child is the next heading if that lies deeper
    df = df.withColumn("child_start", F.when(F.col("__next.level") > F.col("level"), F.col("__next.ln")))
    return df.select("spec", "index", "level", "slug", "title", "path", "authority", "tags", "parent", F.col("ln").alias("header_line"), "end_line", "child_start")


def sections(lines: DataFrame, chunk: int | None = None) -> DataFrame:
    """The section tree of fenced lines."""
    if chunk is not None:
        return section_tree(headings(lines).join(lines.groupBy("spec").agg(F.max("ln").alias("last")), "spec"), chunk)
    return section_tree(headings(lines.withColumn("last", F.max("ln").over(Window.partitionBy("spec")))))


def preambles(tree: DataFrame) -> DataFrame:
    """first and last line of each section's own text before its first child."""
    return tree.withColumn("first", F.col("header_line") + 1).withColumn("last", F.coalesce(F.col("child_start") - 1, F.col("end_line")))


def slugs(tree: DataFrame) -> DataFrame:
    """spec, slug, index: the first section of a slug."""
    return tree.groupBy("spec", "slug").agg(F.min("index").alias("index"))


def innermost(lines: DataFrame, tree: DataFrame, chunk: int | None = None) -> DataFrame:
    """Lines with `section`, the index of the innermost section (null before the first heading). Sections nest, so it is the last that began."""
    marked = lines.join(tree.select("spec", F.col("header_line").alias("ln"), "index"), ["spec", "ln"], "left")
    return scan(marked, {"section": ("last", F.col("index"))}, chunk).drop("index")


def placed(lines: DataFrame) -> DataFrame:
    """Lines with section, header_line, path and authority of their innermost section (null before the first heading): innermost() and its section's
    fields by windows over all lines, so that lines are lexed once and meet no tree in a join."""
    df = lines.withColumn("__head", _is_heading())
    df = _nested(df.withColumns({n: F.when(F.col("__head"), c) for n, c in _heading_fields().items()}))
    here = F.when(F.col("level").isNotNull(), F.struct("index", F.col("ln").alias("header_line"), "path", "authority"))
    df = scan(df.withColumn("__here", here).drop("path", "authority"), {"__at": ("last", F.col("__here"))})
    return df.select(*lines.columns, F.col("__at.index").alias("section"), *(F.col(f"__at.{c}").alias(c) for c in ("header_line", "path", "authority")))


def _blocked(lines: DataFrame, chunk: int | None = None) -> DataFrame:
    """spec, ln, block, piece of the lines inside blocks."""
    stop = F.col("fenced") | _blank(F.col("line")) | F.col("line").rlike(T.HEADER) | F.col("line").rlike(T.COMMENTARY)
    df = scan(lines.withColumn("__stop", stop), {"__was": ("previous", F.col("__stop"))}, chunk)
    new = ~F.col("__stop") & (F.col("line").rlike(T.LIST_ITEM) | F.coalesce("__was", F.lit(True)))
    df = scan(df, {"block": ("total", new.cast("int"))}, chunk)
    return df.where(~F.col("__stop")).select("spec", "ln", (F.col("block") - 1).alias("block"), T.strip(F.col("line")).alias("piece"))


def _joined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    inside = Window.partitionBy("spec", "block").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    places = df.select("spec", "ln", "block", F.coalesce(F.sum(F.length("piece") + 1).over(inside), F.lit(0)).alias("offset"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "piece"))), lambda x: x["piece"]), " ")
    return df.groupBy("spec", "block").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), text.alias("text")), places


def blocks(lines: DataFrame, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Wrapped lines joined: (spec, block, first, last, text) and the place of each line (spec, ln, block, offset).

    A block ends at a fenced or blank line, a heading or a commentary head; a list item begins another."""
    return _joined(_blocked(lines, chunk))


def at_sentence(spots: DataFrame, lines: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """spots (spec, ln, col from 0) with block, sentence and sentence_text; a line outside blocks is block -ln of its own.

    The column counts in the raw line although the block's pieces are stripped, as the rule records expect. keep cuts a table that is read
    several times (lines in blocks, and spots with their places); without one it is made each time."""
    whole, places = _joined(keep(_blocked(lines)))
    met = keep(spots.join(places, ["spec", "ln"], "left"))
    # a block is cut into sentences once, and its spots look theirs up
    cut = whole.select("spec", "block", "text", T.sentences(F.col("text")).alias("__spans"))
    inside = met.where("block is not null").join(cut, ["spec", "block"]).withColumn("__s", T.sentence_in(F.col("__spans"), F.col("text"), F.col("offset") + F.col("col")))
    outside = met.where("block is null").drop("block", "offset").join(lines.select("spec", "ln", "line"), ["spec", "ln"])
    outside = outside.withColumn("block", -F.col("ln")).withColumn("__s", T.sentence_at(F.col("line"), F.col("col")))
    told = [*spots.columns, "block", F.col("__s.sentence").alias("sentence"), F.col("__s.text").alias("sentence_text")]
    return inside.select(*told).unionByName(outside.select(*told))


def _matches(lines: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    """spec, ln, col, name: every match in a line with its column, from the lengths of what lies between the matches."""
    found = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    names = F.regexp_extract_all("line", F.lit(pattern), F.lit(group))
    between = F.split("line", pattern, -1)
    df = lines.where(F.col("line").rlike(pattern)).select("spec", "ln", found.alias("f"), names.alias("n"), between.alias("b"))
    col = F.aggregate(F.slice("b", 1, F.col("i") + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("f", 1, F.col("i")), F.lit(0), lambda s, x: s + F.length(x))
    return df.select("spec", "ln", "f", "b", F.posexplode("n").alias("i", name)).select("spec", "ln", col.alias("col"), name)


def markers(lines: DataFrame) -> DataFrame:
    """spec, ln, col, rule: rule markers outside fences."""
    return _matches(lines.where(~F.col("fenced")), T.RULE_MARKER, 1, "rule").where(~F.col("rule").startswith("eg"))


def links(lines: DataFrame) -> DataFrame:
    """spec, ln, col, anchor: links to anchors outside fences."""
    return _matches(lines.where(~F.col("fenced")), T.LINK, 1, "anchor")


def marker_repeats(found: DataFrame) -> DataFrame:
    return found.groupBy("spec", "rule").agg(F.count("*").alias("n")).where("n > 1")


def examples(lines: DataFrame) -> DataFrame:
    """spec, ln, example, title: example heads outside fences."""
    line = T.strip(F.col("line"))
    return lines.where(~F.col("fenced") & line.rlike(T.EXAMPLE_HEAD)).select("spec", "ln", F.regexp_extract(line, T.EXAMPLE_HEAD, 1).alias("example"), T.strip(F.regexp_extract(line, T.EXAMPLE_HEAD, 2)).alias("title"))


def verdicts(lines: DataFrame) -> DataFrame:
    """spec, ln, i, example, verdict, cause, note: comments in any line, fenced or not, of the latest example head."""
    heads = examples(lines).select("spec", "ln", "example")
    df = lines.join(heads, ["spec", "ln"], "left").withColumn("of", F.last("example", ignorenulls=True).over(_so_far()))
    df = df.where(F.col("line").rlike(T.VERDICT) & F.col("of").isNotNull() & F.col("example").isNull())
    parts = [F.regexp_extract_all("line", F.lit(T.VERDICT), F.lit(g)) for g in (1, 2, 3)]
    df = df.select("spec", "ln", "of", F.posexplode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("verdict", "cause", "note"), strict=True)))).alias("i", "v"))
    note = F.regexp_replace("v.note", r"^[ :\-]+|[ :\-]+$", "")
    return df.select("spec", "ln", "i", F.col("of").alias("example"), "v.verdict", T.empty_to_null(F.col("v.cause")).alias("cause"), T.empty_to_null(note).alias("note"))


def example_records(lines: DataFrame) -> DataFrame:
    """spec, example, ln, title, verdicts [(verdict, cause, note)] in order."""
    of = verdicts(lines).groupBy("spec", "example").agg(F.sort_array(F.collect_list(F.struct("ln", "i", "verdict", "cause", "note"))).alias("v"))
    return examples(lines).join(of, ["spec", "example"], "left").select("spec", "example", "ln", "title", F.transform(F.coalesce("v", F.array().cast("array<struct<ln:int,i:int,verdict:string,cause:string,note:string>>")), lambda x: F.struct(x["verdict"].alias("verdict"), x["cause"].alias("cause"), x["note"].alias("note"))).alias("verdicts"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """spec, section, paragraph, first, last, text of the prose in each section's own lines (`section` from innermost()).

    Headings, blank lines and commentary break; fenced lines are passed over; commentary's indented body is left out."""
    seen = lines.where(~F.col("fenced"))
    head, blank = F.col("line").rlike(T.COMMENTARY), _blank(F.col("line"))
    own = Window.partitionBy("spec", "section").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = ~blank & F.col("line").startswith("    ")
    # inside commentary from its head until a line that is not an indented one
    df = seen.withColumn("__edge", F.when(head, F.struct("ln", F.lit(True).alias("in"))).when(~body, F.struct("ln", F.lit(False).alias("in"))))
    df = df.withColumn("__in", F.coalesce(F.last("__edge", ignorenulls=True).over(own)["in"], F.lit(False)))
    df = df.withColumn("__prose", ~F.col("__in") & ~blank & ~F.col("line").rlike(T.HEADER))
    df = df.withColumn("__stop", head | (~(F.col("__in") & body) & ~F.col("__prose")))
    df = df.withColumn("paragraph", F.sum(F.col("__stop").cast("int")).over(own)).where("__prose")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", T.strip(F.col("line")).alias("t")))), lambda x: x["t"]), " ")
    out = df.groupBy("spec", "section", "paragraph").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), text.alias("text"))
    return out.withColumn("paragraph", F.row_number().over(Window.partitionBy("spec", "section").orderBy("first")))


def commentary(lines: DataFrame) -> DataFrame:
    """spec, ln, text: commentary bodies (indented by four spaces or more) by their head's line; blank lines inside are passed over."""
    seen = lines.where(~F.col("fenced"))
    head = F.col("line").rlike(T.COMMENTARY)
    body = ~_blank(F.col("line")) & F.col("line").startswith("    ")
    edge = F.when(head, F.col("ln")).when(~_blank(F.col("line")) & ~body, F.lit(0))
    df = seen.withColumn("head", F.last(edge, ignorenulls=True).over(_so_far())).where((F.col("head") > 0) & ~head & body)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", T.strip(F.col("line")).alias("t")))), lambda x: x["t"]), " ")
    heads = seen.where(head).select("spec", F.col("ln").alias("head"))
    bodies = df.groupBy("spec", "head").agg(text.alias("text"), F.max("ln").alias("end"))
    return bodies.join(heads, ["spec", "head"]).select("spec", F.col("head").alias("ln"), "end", "text")


def commentary_lines(lines: DataFrame) -> DataFrame:
    """Lines with in_commentary: from a head until a line that isn't blank and not indented at all."""
    raw = F.col("line")
    edge = F.when(raw.rlike(T.COMMENTARY), True).when(~_blank(raw) & ~raw.startswith(" ") & ~raw.startswith("\t"), False)
    return lines.withColumn("in_commentary", F.coalesce(F.last(edge, ignorenulls=True).over(_so_far()), F.lit(False)))


def example_bodies(lines: DataFrame) -> DataFrame:
    """spec, example, first, last, text: from a head to the close of its fenced body; problem says what is missing.

    The close is the first later line of at least as many of the fence's characters. Not found: last and text are null. What
    follows a head or an opening is looked up by windows, so that a document's heads never meet all its fences."""
    fence = F.regexp_extract("line", r"(?U)^\s*(~{3,}|`{3,})", 1)
    heads = examples(lines).select("spec", "ln", "example")
    stop = (fence != "") | F.col("line").rlike(r"(?U)^#{1,6}\s") | T.strip(F.col("line")).rlike(T.EXAMPLE_HEAD)
    df = lines.withColumn("__fence", fence).withColumn("__open", F.first(F.when(stop, F.struct("ln", F.col("__fence").alias("fence"))), ignorenulls=True).over(_after()))
    bare = F.col("line").rlike(r"(?U)^\s*(~{3,}|`{3,})\s*$")
    opened = df.join(heads, ["spec", "ln"]).select("spec", "example", F.col("ln").alias("first"), F.col("__open").alias("open"))
    spans = opened.withColumn("problem", F.when(F.col("open").isNull() | (F.col("open.fence") == ""), "no fenced body"))
    wanted = spans.where("problem is null").select("spec", F.col("open.ln").alias("ln"), F.left("open.fence", F.lit(1)).alias("mark"), F.length("open.fence").alias("width")).distinct()
    marks = df.where(bare).select("spec", "ln", F.left("__fence", F.lit(1)).alias("mark"), F.length("__fence").alias("width"), F.lit(True).alias("close"))
    # openings and closing lines of one character in order; for each width that an opening has, the next closing line at least as wide
    widths = wanted.select("spec", "mark", "width").distinct().withColumnRenamed("width", "w")
    both = wanted.withColumn("close", F.lit(False)).unionByName(marks).join(widths, ["spec", "mark"])
    after = Window.partitionBy("spec", "mark", "w").orderBy("ln", F.desc("close")).rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("last", F.min(F.when(F.col("close") & (F.col("width") >= F.col("w")), F.col("ln"))).over(after))
    closed = both.where("not close and width = w").select("spec", F.col("ln").alias("__at"), "last")
    spans = spans.withColumn("__at", F.col("open.ln")).join(closed, ["spec", "__at"], "left").select("spec", "example", "first", "last", F.coalesce("problem", F.when(F.col("last").isNull(), "not closed")).alias("problem"))
    own = spans.where("last is not null").select("spec", "example", F.explode(F.sequence("first", "last")).alias("ln"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    texts = own.join(lines.select("spec", "ln", "line"), ["spec", "ln"]).groupBy("spec", "example").agg(text.alias("text"))
    return spans.join(texts, ["spec", "example"], "left")


def passages(lines: DataFrame, bodies: DataFrame, tree: DataFrame) -> DataFrame:
    """spec, passage (ctxNNNNN), first, last, section, commentary, text: runs of lines outside examples, headings and blanks."""
    covered = bodies.where("last is not null").select("spec", F.explode(F.sequence("first", "last")).alias("ln")).distinct().withColumn("__ex", F.lit(True))
    heads = tree.select("spec", F.col("header_line").alias("ln"), F.lit(True).alias("__head"))
    df = commentary_lines(innermost(lines, tree)).join(covered, ["spec", "ln"], "left").join(heads, ["spec", "ln"], "left")
    df = df.withColumn("__stop", F.col("__ex").isNotNull() | F.col("__head").isNotNull() | (_blank(F.col("line")) & ~F.col("fenced")))
    df = df.withColumn("__run", F.sum(F.col("__stop").cast("int")).over(_so_far())).where(~F.col("__stop"))
    first = F.min_by("section", "ln").alias("section"), F.min_by("in_commentary", "ln").alias("commentary")
    text = T.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n"))
    out = df.groupBy("spec", "__run").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), *first, text.alias("text"))
    return out.select("spec", F.format_string("ctx%05d", "first").alias("passage"), "first", "last", "section", "commentary", "text")


def chapters(tree: DataFrame) -> DataFrame:
    """spec, slug, chapter: each section's latest top-level section."""
    by = Window.partitionBy("spec").orderBy("header_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.min("level").over(Window.partitionBy("spec"))
    return tree.withColumn("__top", top).withColumn("chapter", F.last(F.when(F.col("level") == F.col("__top"), F.col("slug")), ignorenulls=True).over(by)).select("spec", "slug", "chapter")


def stems(lines: DataFrame, spots: DataFrame, words: int = 40) -> DataFrame:
    """spec, ln, stem, framing of list items at spots (spec, ln): prose blocks above, past blanks and other items.

    The nearest is the stem; the framing is the nearest of the next three that doesn't end with a colon, else the next. Looking up
    stops at a heading or a fence. Blocks here are runs of lines that are no items; only those of the same stretch count. Each run
    carries the three before it, and an item takes the last run above it, so that items never meet all runs."""
    raw = F.col("line")
    wall = F.col("fenced") | raw.rlike(T.HEADER)
    item, blank = raw.rlike(T.LIST_ITEM), _blank(raw)
    df = lines.withColumn("__wall", F.sum(wall.cast("int")).over(_so_far())).withColumn("__prose", ~wall & ~item & ~blank)
    df = df.withColumn("__run", F.sum((~F.col("__prose")).cast("int")).over(_so_far()))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", T.strip(raw).alias("t")))), lambda x: x["t"]), " ")
    runs = df.where("__prose").groupBy("spec", "__wall", "__run").agg(F.max("ln").alias("ln"), text.alias("text"))
    last = Window.partitionBy("spec", "__wall").orderBy("ln")
    runs = runs.withColumn("b", F.filter(F.array("text", *(F.lag("text", k).over(last) for k in (1, 2, 3))), lambda x: x.isNotNull()))
    ends = df.join(runs.select("spec", "ln", "b"), ["spec", "ln"], "left")
    above = Window.partitionBy("spec", "__wall").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("b", F.last("b", ignorenulls=True).over(above)).where(item & ~wall)
    got = ends.join(spots.select("spec", "ln").distinct(), ["spec", "ln"]).where("b is not null")
    later = F.slice("b", 2, 3)
    plain = F.filter(later, lambda x: ~F.rtrim(x).endswith(":"))
    framing = F.coalesce(F.get(plain, F.lit(0)), F.get(later, F.lit(0)))
    return got.select("spec", "ln", T.clip(F.get("b", F.lit(0)), words).alias("stem"), T.clip(framing, words).alias("framing"))
