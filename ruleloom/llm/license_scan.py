"""License scans by diagonal voting.

Every word k-gram of every text is hashed and joined by Spark to the templates' positions. A hit at word p of a text and
word q of a template votes for the diagonal p - q. Votes are summed by diagonal, neighbouring diagonals (words put in or
left out) merge, and the spans with enough votes are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Words, cut, matched, rolled, slices, trimmed

# The base phrases with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notices of common licenses, as their publishers word them.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3.0", "gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "creative commons zero"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
]
K = 3
#: Templates of fewer words must be there word for word.
LONG = 20
#: Of a longer template, this share of the words. Candidates need the votes that are left however the other words lie.
COVERAGE = 0.8


class Template:
    def __init__(self, number: int, label: str, text: str, base: bool):
        self.number, self.label, self.base = number, label, base
        words = Words(pa.array([text]), WORD)
        self.words = [words.text(i).encode() for i in range(len(words.start))]
        self.k = min(K, len(self.words))
        self.grams = rolled(words.hash, self.k).view(np.int64).tolist()
        exact = base or len(self.words) < LONG
        self.coverage = 1.0 if exact else COVERAGE
        self.slack = int(len(self.words) * (1 - self.coverage) + 1e-9)  # words that may be others
        self.votes = max(1, len(self.grams) - self.k * self.slack)


def templates(notices: list[tuple[str, str]] = NOTICES) -> list[Template]:
    base = [Template(i, label, text, True) for i, (text, label) in enumerate(BASE.items())]
    return base + [Template(len(base) + i, label, text, False) for i, (label, text) in enumerate(notices)]


def _positions(spark: SparkSession, known: list[Template], k: int) -> DataFrame:
    """hash, [(template, word)] of all k-grams; as large as the templates, so it is broadcast."""
    by: dict[int, list] = {}
    for t in known:
        for q, h in enumerate(t.grams if t.k == k else []):
            by.setdefault(h, []).append((t.number, q))
    return F.broadcast(spark.createDataFrame(list(by.items()), f"t{k} long, at{k} array<struct<template:int,q:int>>"))


def candidates(texts: DataFrame, known: list[Template]) -> DataFrame:
    """key, [(template, low, high)] of (key, text): the merged diagonals with enough votes. Rows of one key vote once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                w = Words(part.column("text"), WORD)
                n, doc = len(w.start), w.document()
                left = w.first[1:][doc] - np.arange(n)  # words from here to the text's end
                columns = {"key": part.column("key").to_numpy()[doc], "p": (np.arange(n) - w.first[:-1][doc]).astype(np.int32)}
                for k in (2, 3):
                    h = np.zeros(n, np.int64)
                    g = rolled(w.hash, k).view(np.int64)
                    h[: len(g)] = g
                    h[left < k] = 0
                    columns[f"h{k}"] = h
                yield pa.record_batch(columns)

    spark = texts.sparkSession
    rows = texts.select("key", "text").mapInArrow(trimmed(emit), "key long, p int, h2 long, h3 long")
    for k in (2, 3):
        rows = rows.join(_positions(spark, known, k), F.col(f"h{k}") == F.col(f"t{k}"), "left")
    none = F.array().cast("array<struct<template:int,q:int>>")
    hits = rows.where("t2 is not null or t3 is not null").select("key", "p", F.explode(F.concat(F.coalesce("at2", none), F.coalesce("at3", none))).alias("hit"))
    diagonals = hits.groupBy("key", F.col("hit.template").alias("template"), (F.col("p") - F.col("hit.q")).alias("diagonal")).agg(F.collect_set("hit.q").alias("qs"))
    limits = F.broadcast(spark.createDataFrame([(t.number, t.slack, t.votes) for t in known], "template int, slack int, votes int"))
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    diagonals = diagonals.join(limits, "template").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > F.col("slack")).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(by))
    merged = diagonals.groupBy("key", "template", "island").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("got"), F.max("votes").alias("votes"))
    return merged.where("got >= votes").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("spans"))


def scan_licenses(documents: DataFrame, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """All columns, with n_words, n_base, first_word, last_word, base_labels, labels, score and spans for each row.

    A null or empty text has no words, empty labels and score 0. Whole texts count; rows with one id are each their own, and
    repeated rows get the same result. score is the largest share of a template's words that a verified span holds.
    spans: label, first word, words, share.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    known = templates(notices)
    keyed = documents.withColumn("__key", F.xxhash64(F.col("doc_id"), F.col("text")))
    found = cut(candidates(keyed.select(F.col("__key").alias("key"), "text"), known)).select(F.col("key").alias("__found"), "spans").withColumnRenamed("spans", "__spans")
    joined = matched(keyed, F.col("__key"), found, "__found", F.col("__key") == F.col("__found"), "left").drop("__key", "__found")
    new = StructType.fromDDL("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long,share:double>>")
    columns = [f for f in documents.schema.fields if f.name not in new.names]
    schema = StructType([*columns, *new.fields])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), WORD, hashed=False)
                rows = []
                for i, spans in enumerate(part.column("__spans").to_pylist()):
                    base, places, good = set(), [], []
                    for s in spans or []:
                        t, first, n = known[s["template"]], int(w.first[i]), int(w.counts[i])
                        held = [any(0 <= (p := d + q) < n and w.data[w.start[first + p] : w.end[first + p]].tobytes() == word for d in range(s["low"], s["high"] + 1)) for q, word in enumerate(t.words)]
                        share = sum(held) / len(held)
                        if share >= t.coverage:
                            good.append({"label": t.label, "first": max(0, s["low"]), "words": len(t.words) + s["high"] - s["low"], "share": share})
                            if t.base:
                                base.add(t.label)
                                places.append(s["low"])
                    rows.append((int(w.counts[i]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({g["label"] for g in good})), max((g["share"] for g in good), default=0.0), good))
                added = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), [kinds.field(n) for n in new.names], strict=True)]
                yield pa.record_batch([*(part.column(f.name).cast(kinds.field(f.name).type) for f in columns), *added], names=kinds.names)

    return joined.select(*(f.name for f in columns), *(["text"] if "text" not in [f.name for f in columns] else []), "__spans").mapInArrow(trimmed(verify), schema)
