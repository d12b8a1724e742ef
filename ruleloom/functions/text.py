"""Column functions over lines, titles, quotes and model output; all run in the JVM but for NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The forms of the marked-up specification. White space, letters and digits are those of all scripts.
HEADER = r"(?U)^(#{1,6})\s+(.*?)\s*(?:\{(.+?)\})?\s*$"
RULE_MARKER = r"(?U)\[\^(\w{4})\]"
EXAMPLE_MARKER = r"(?U)\[\^(eg\d{3})\]"
ANY_TAG = r"(?U)\[\^(?:\w{4}|eg\d{3})\]"
LINK = r"(?U)\[[^\]]*\]\(#([\w-]+)\)"
COMMENTARY = r'(?U)^\s*!!!\s+meta\s+"Commentary"'
EXAMPLE_HEAD = r"(?U)^\*\*Example\[\^(eg\d{3})\]\*\*:?\s*(.*)$"
VERDICT = r"(?U)<!--\s*(GOOD|OK|BAD)(?:\[#([\w_]+)\])?\s*:?\s*(.*?)\s*-->"
LIST_ITEM = r"(?U)^\s*(?:[-*+]|\d+\.)\s+"
#: The end mark is asked for first, so that other places cost one look and not fourteen.
SENTENCE_END = r"(?U)(?<=[.!?])(?<!\be\.g\.)(?<!\bi\.e\.)(?<!\betc\.)(?<!\bvs\.)(?<!\bcf\.)(?<!\bal\.)(?<!\bDr\.)(?<!\bMr\.)(?<!\bMs\.)(?<!\bSt\.)(?<!\bNo\.)(?<!\bU\.S\.)(?<!\bapprox\.)[\"'\)\]]*\s+(?=[A-Z\(\[\"'*`])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def header_level(line: Column) -> Column:
    return F.when(line.rlike(HEADER), F.length(F.regexp_extract(line, HEADER, 1)))


def header_title(line: Column) -> Column:
    return strip(F.regexp_extract(line, HEADER, 2))


def header_attributes(line: Column) -> Column:
    return empty_to_null(F.regexp_extract(line, HEADER, 3))


def anchor(attributes: Column) -> Column:
    """The first #anchor of an attribute block."""
    return empty_to_null(F.regexp_extract(attributes, r"(?U)#([\w_]+)", 1))


def attribute(attributes: Column, name: str) -> Column:
    """The last name=value of a block, without a closing brace."""
    values = F.regexp_extract_all(attributes, F.lit(rf"(?U)(?<!\w){name}=(\S+)"), F.lit(1))
    return F.regexp_replace(F.element_at(F.when(F.size(values) > 0, values), -1), r"\}+$", "")


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clip(text: Column, words: int) -> Column:
    """The first words, with ` [...]` where some are left out; white space becomes single spaces."""
    parts = F.split(strip(text), r"(?U)\s+")
    return F.when(F.size(parts) <= words, F.array_join(parts, " ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(" [...]")))


def bare(word: Column) -> Column:
    """A word without its tags."""
    return F.regexp_replace(word, ANY_TAG, "")


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY_TAG), F.lit(0))


def rule_ids(text: Column) -> Column:
    """Ids of rule markers; an id of four characters that begins with eg is an example's."""
    return F.filter(F.regexp_extract_all(text, F.lit(RULE_MARKER), F.lit(1)), lambda x: ~x.startswith("eg"))


def keeps_tags(before: Column, after: Column) -> Column:
    """Whether every tag of `before` is in `after` at least as often."""
    a, b = tags(before), tags(after)
    return F.forall(F.array_distinct(a), lambda t: F.size(F.filter(b, lambda x: x == t)) >= F.size(F.filter(a, lambda x: x == t)))


def split_list(value: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value, ","), strip), lambda x: x != "")


#: Lengths that are summed one by one before the sums of whole runs are used.
_RUN = 256


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it, also inside lambdas."""
    return F.transform(F.array(value), f)[0]


def starts(parts: Column) -> Column:
    """Where each part begins, from 0: the lengths of whole runs of parts before it, and of the parts before it in its own run."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, n: s + n)
    whole = lambda i: F.floor(i / _RUN).cast("int")

    def of(size: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), whole(F.size(size) - 1)), lambda k: total(F.slice(size, k * _RUN + 1, F.lit(_RUN))))
        return with_value(runs, lambda r: F.transform(size, lambda _, i: total(F.slice(r, F.lit(1), whole(i))) + total(F.slice(size, whole(i) * _RUN + 1, i % _RUN))))

    return with_value(F.transform(parts, lambda p: F.length(p)), of)


def sentences(text: Column) -> Column:
    """[(sentence, start, end, text)]: spans from 0 that cover the text; blank spans are left out and not counted.

    Each boundary with what it consumes belongs to the sentence before it, so the parts' lengths give the offsets."""

    def of(parts: Column) -> Column:
        placed = F.zip_with(parts, starts(parts), lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("text")))
        return F.transform(F.filter(placed, lambda s: strip(s["text"]) != ""), lambda s, i: F.struct(i.alias("sentence"), s["start"].alias("start"), s["end"].alias("end"), strip(s["text"]).alias("text")))

    return with_value(F.split(F.regexp_replace(text, SENTENCE_END, "$0\u0001"), "\u0001"), of)


def sentence_in(spans: Column, text: Column, position: Column) -> Column:
    """The sentence over a position, of a text's sentences; number 0 and the whole text if there is none."""
    none = F.struct(F.lit(0).alias("sentence"), F.lit(0).alias("start"), F.length(text).alias("end"), strip(text).alias("text"))
    over = F.filter(spans, lambda s: (s["start"] <= position) & (position < s["end"]))
    return F.coalesce(F.get(over, F.lit(0)), none)


def sentence_at(text: Column, position: Column) -> Column:
    return sentence_in(sentences(text), text, position)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(text: Column) -> Column:
    """Quotes, dashes and ellipses in one form, no tags, single hyphens and spaces; the text should be NFKC already."""
    c = F.translate(text, "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "''''\"\"\"\"-------")
    c = F.replace(c, F.lit("\u2026"), F.lit("..."))
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ANY_TAG, ""), "-{2,}", "-"), r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    return folded(nfkc(text))


def without_trailing_commas(text: Column) -> Column:
    """Model output without commas before } or ], where something stands before them; strings stay as they are.

    Each string, and each run of anything but openings, colons and commas, is taken with the white space and comma after it."""
    return F.regexp_replace(text, r'("(?:[^"\\]++|\\.)*+(?:"|$)|[^\[{,:\s"]++)(?:(\s*+),(?=[ \t\r\n]*[}\]]))?', "$1$2")


def removed_commas(text: Column) -> Column:
    return (F.length(text) - F.length(without_trailing_commas(text))).cast("long")
