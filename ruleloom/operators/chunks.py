"""Running values over a document's lines in order, at once or by chunks of lines.

At once, a window takes a document's lines in one task. By chunks, every chunk of a document is a window of its own and
gives one row of summaries; these are composed in order, and each chunk's lines take what came before (or after) the chunk. So a document
of any length is dealt to all tasks, and what one task holds of it is a row for each chunk. Both give the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of running values: the sum so far, the last value so far, the highest before, the lowest after, that of the line before or after.
KINDS = ("total", "last", "highest_before", "lowest_after", "previous", "following")


def _windows(*by: str):
    w = Window.partitionBy(*by).orderBy("ln")
    first, last, here = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    return w, w.rowsBetween(first, here), w.rowsBetween(first, -1), w.rowsBetween(1, last)


def _local(kind: str, c: Column, windows) -> Column:
    w, so_far, before, after = windows
    return {"total": lambda: F.sum(c).over(so_far), "last": lambda: F.last(c, True).over(so_far), "highest_before": lambda: F.max(c).over(before), "lowest_after": lambda: F.min(c).over(after), "previous": lambda: F.lag(c).over(w), "following": lambda: F.lead(c).over(w)}[kind]()


def scan(df: DataFrame, wanted: dict[str, tuple[str, Column]], size: int | None = None) -> DataFrame:
    """df (spec, ln, ...) with the wanted running values, {name: (kind, of what)}; size: lines of a chunk (None: whole documents).

    By chunks, df is cut by checkpoint(), as it is read for the summaries and for the lines."""
    if size is None:
        windows = _windows("spec")
        return df.withColumns({n: _local(kind, c, windows) for n, (kind, c) in wanted.items()})
    df = df.withColumns({"__chunk": F.floor((F.col("ln") - 1) / size), **{f"__of_{n}": c for n, (_, c) in wanted.items()}}).checkpoint()
    placed = lambda c: F.when(c.isNotNull(), F.col("ln"))
    summary = {
        "total": lambda c: F.sum(c), "last": lambda c: F.max_by(c, placed(c)), "highest_before": lambda c: F.max(c),
        "lowest_after": lambda c: F.min(c), "previous": lambda c: F.max_by(c, F.col("ln")), "following": lambda c: F.min_by(c, F.col("ln")),
    }
    chunks = df.groupBy("spec", "__chunk").agg(*(summary[kind](F.col(f"__of_{n}")).alias(f"__sum_{n}") for n, (kind, _) in wanted.items()))
    w = Window.partitionBy("spec").orderBy("__chunk")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    carried = {
        "total": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "last": lambda c: F.last(c, True).over(before), "highest_before": lambda c: F.max(c).over(before),
        "lowest_after": lambda c: F.min(c).over(after), "previous": lambda c: F.lag(c).over(w), "following": lambda c: F.lead(c).over(w),
    }
    chunks = chunks.select("spec", "__chunk", *(carried[kind](F.col(f"__sum_{n}")).alias(f"__carry_{n}") for n, (kind, _) in wanted.items()))
    windows = _windows("spec", "__chunk")
    local = df.withColumns({**{f"__here_{n}": _local(kind, F.col(f"__of_{n}"), windows) for n, (kind, _) in wanted.items()}, "__first": F.lag("ln").over(windows[0]).isNull(), "__end": F.lead("ln").over(windows[0]).isNull()})
    met = local.join(chunks, ["spec", "__chunk"])

    def value(n: str, kind: str) -> Column:
        here, carry = F.col(f"__here_{n}"), F.col(f"__carry_{n}")
        if kind == "total":
            return carry + F.coalesce(here, F.lit(0))
        if kind in ("previous", "following"):
            return F.when(F.col("__first" if kind == "previous" else "__end"), carry).otherwise(here)
        return {"last": F.coalesce, "highest_before": F.greatest, "lowest_after": F.least}[kind](here, carry)

    own = [c for c in df.columns if not c.startswith(("__of_", "__chunk"))]
    return met.select(*own, *(value(n, kind).alias(n) for n, (kind, _) in wanted.items()))


def fences(lines: DataFrame, tilde: Column, backtick: Column, size: int) -> DataFrame:
    """Lines with `fenced`, by chunks: tildes always toggle, backticks only outside tildes.

    A chunk is a transducer of four states: as it can't know whether it begins within tildes, it counts the backticks that toggle
    in either case, and its own tildes. Composing chunks takes the count that fits the tildes before; each line then takes the one that fits."""
    df = lines.withColumns({"__chunk": F.floor((F.col("ln") - 1) / size), "__t": tilde.cast("int"), "__b": (backtick & ~tilde).cast("int")}).checkpoint()
    _, so_far, _, _ = _windows("spec", "__chunk")
    df = df.withColumn("__odd", F.sum("__t").over(so_far) % 2)
    if_out, if_in = (F.when(F.col("__odd") == state, F.col("__b")).otherwise(0) for state in (0, 1))
    df = df.withColumns({"__out": if_out, "__inn": if_in})
    chunks = df.groupBy("spec", "__chunk").agg(F.sum("__t").alias("t"), F.sum("__out").alias("o"), F.sum("__inn").alias("i"))
    before = Window.partitionBy("spec").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("__tildes", F.coalesce(F.sum("t").over(before), F.lit(0)) % 2)
    chunks = chunks.withColumn("__ticks", F.coalesce(F.sum(F.when(F.col("__tildes") == 0, F.col("o")).otherwise(F.col("i"))).over(before), F.lit(0)))
    met = df.withColumns({"__o": F.sum("__out").over(so_far), "__i": F.sum("__inn").over(so_far)}).join(chunks.select("spec", "__chunk", "__tildes", "__ticks"), ["spec", "__chunk"])
    inside = (F.col("__tildes") + F.col("__odd")) % 2 == 1
    ticks = F.col("__ticks") + F.when(F.col("__tildes") == 0, F.col("__o")).otherwise(F.col("__i"))
    toggles = (F.col("__b") == 1) & ~inside
    return met.select(*lines.columns, ((F.col("__t") == 1) | inside | toggles | (ticks % 2 == 1)).alias("fenced"))
