"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized_join

#: A word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of what comes before each row in a total order. Rows are dealt out by ranges of the order, each range sums
    its own, and only one row for each range goes through a window of all."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    per = per.select("__range", *(F.coalesce(F.sum(f"__{n}").over(whole), F.lit(0)).alias(f"__{n}") for n in sums))
    out = ranged.join(F.broadcast(per), "__range")
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, c in sums.items()))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target from (source, size).

    Sources in code-point order, null last, get the weights in turn. The total of all sizes is shared by weight; a target
    stops at `most` times its source's size and the excess goes to the others by weight until none is above. That fixed
    point has a closed form: in the order of cap / weight the first sources are capped, the rest get
    (total - capped) * weight / (weight of the rest). Ranks and sums before a source are taken range by range of the sources.
    """
    by = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by = running(by, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    by = by.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    place = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    by = cut(running(by, place, {"capped": F.col("cap"), "passed": F.col("weight")}))
    every = by.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    by = by.crossJoin(F.broadcast(every)).withColumn("open", F.col("weights") - F.col("passed"))
    # a source is above its cap at the level that holds when all before it are capped; the first that isn't gives the level
    above = F.col("cap") * F.col("open") < (F.col("total") - F.col("capped")) * F.col("weight")
    by = by.withColumn("above", above)
    level = by.where(~F.col("above")).agg(F.min_by(F.struct("capped", "open"), F.struct("capped", "passed")).alias("level"))
    by = by.crossJoin(F.broadcast(level))
    share = (F.col("total") - F.col("level.capped")) * F.col("weight") / F.col("level.open")
    return by.select("source", "source_size", F.when(F.col("above") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(share).alias("target"))


def unit(name: Column) -> Column:
    """A number in [0, 1) that depends on the name alone."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def seeded(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone (without an id: on the text)."""
    return unit(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))))


def size_class(size: Column) -> Column:
    """The size itself up to 127, then 64 classes for each doubling: a source has some thousands of classes at most."""
    shift = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", size, shift)).cast("long")


def draws(per: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """source, cell, limit: the documents of a source and size class whose number is at most the limit get the copy for the
    fraction, from (source, cell, u, n) and (source, fraction).

    A source's documents stand in the order of their classes, and of their numbers in a class. With one offset a source, drawn from
    the seed, the running sums of the fraction pass a whole number in some classes: as often as that, documents of the class with the
    smallest numbers are drawn. So every document's chance is the fraction, and the sizes drawn add up to their share within about
    one document. Numbers are ranked range by range over rows of three numbers; the limits are a row for each class.
    """
    order = [F.col("source").asc_nulls_last(), F.col("cell")]
    cells = cut(per.groupBy("source", "cell").agg(F.sum("n").alias("n")))
    cells = running(cells, order, {"start": F.col("n")}).withColumnRenamed("source", "s")
    first = cut(cells.groupBy("s").agg(F.min("start").alias("base")))
    about = targets.select(F.col("source").alias("t"), "fraction", unit(F.concat(F.lit(f"{seed}offset:"), F.coalesce("source", F.lit("")))).alias("offset"))
    about = cut(first.join(about, F.col("s").eqNullSafe(F.col("t"))).select(F.col("s").alias("r"), "base", "fraction", "offset"))
    cells = sized_join(cells, about, F.col("s").eqNullSafe(F.col("r")), "inner")

    def passed(before: Column) -> Column:
        return F.floor(F.col("fraction") * before.cast("double") + F.col("offset"))

    before = F.col("start") - F.col("base")
    cells = cut(cells.select("s", F.col("cell").alias("c"), "start", (passed(before + F.col("n")) - passed(before)).alias("wanted")).where("wanted > 0"))
    ranked = running(per.select("source", "cell", "u", "n"), [*order, F.col("u")], {"place": F.col("n")})
    drawn = sized_join(ranked, cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")), "inner").where(F.col("place") - F.col("start") < F.col("wanted"))
    return drawn.groupBy("source", "cell").agg(F.max("u").alias("limit"))


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix:", keep: list[str] | None = None) -> DataFrame:
    """Each document with size, source_size, target and copies: floor(rate) plus one with the fraction's probability.

    rate is target / source_size. The draws of one source depend on each other (see draws), so that its taken words come within
    about a document of its target. Null text has size 0; documents of a source whose size is 0 get no copy; null sources are one
    source; repeated rows with one id share its draw. An empty table gives an empty one. `keep` names the columns that are carried
    (all by default). The texts are read twice and stay where they are: sizes and numbers are added up by source and size class, and
    the tables of sources and classes are joined by broadcast after a count.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    number = seeded(seed, F.col("doc_id"), F.col("text"))
    per = documents.select("source", size.alias("size"), number.alias("u")).groupBy("source", size_class(F.col("size")).alias("cell"), "u").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    per = cut(per)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(per.select("source", "size")).withColumn("rate", rate)
    targets = cut(targets.select("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction")))
    limits = cut(draws(per, targets, seed).select(F.col("source").alias("__s"), F.col("cell").alias("__c"), F.col("limit").alias("__limit")))
    wide = documents.select(*(keep if keep is not None else documents.columns), size.alias("__size"), F.col("source").alias("__source"), number.alias("__u"))
    of = targets.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"))
    wide = sized_join(wide, of, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")
    wide = sized_join(wide, limits, F.col("__source").eqNullSafe(F.col("__s")) & (size_class(F.col("__size")) == F.col("__c")), "left").drop("__s", "__c", "__source")
    return wide.withColumn("__copies", (F.col("__whole") + F.coalesce((F.col("__u") <= F.col("__limit")).cast("long"), F.lit(0))).cast("long")).drop("__whole", "__limit")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of the documents, each row as often as the plan says."""
    plan = mix_plan(documents, **options)
    return plan.where("__copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*documents.columns)
