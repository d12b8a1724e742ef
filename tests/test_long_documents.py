"""Rules of documents beyond 1,000 lines, whose names recur, are told apart: the same rows as in another engine."""

import pytest

from ruleloom.plans import catalogue

from test_catalogue import plain

QUERIES = ["mechanical_graph", "section_references", "rule_contexts", "unit_packets", "dimension_job_payloads", "section_job_payloads", "dossier_records"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    lines = ["" if i % 13 == 5 else f"Line {i % 1000} says a thing. Then more" for i in range(1, 2104)]
    texts = ["\n".join(lines), "\n".join(lines[:1003]), "\n".join(["the same"] * 1050), "\n".join(lines[:30]), None]
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_rules_of_one_name_are_told_apart(spark, tables, name):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tables}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    want = db.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert plain([r[i] for i in at] for r in want.fetchall()) == plain(tuple(r) for r in got.select(*columns).collect())


def test_unique_markers(spark):
    from pyspark.sql import functions as F

    from ruleloom.functions import text as T
    from ruleloom.plans import shim

    at = spark.range(4).select(F.col("id").alias("spec")).crossJoin(spark.range(1, 5001).select(F.col("id").cast("int").alias("ln")))
    got = at.withColumn("rule", shim.marker(True)).withColumn("plain", shim.marker(False)).withColumn("found", T.rule_ids(F.concat(F.lit("x [^"), "rule", F.lit("]"))))
    assert got.select("spec", "rule").distinct().count() == 20000
    assert got.where((shim.named(F.col("rule")) != F.col("plain")) | (F.col("found")[0] != F.col("rule")) | (F.size("found") != 1)).count() == 0
    assert got.where("ln < 997 and rule <> plain").count() == 0
    # the rules of a section have one letter, so their order is that of their names
    section = F.floor((F.col("ln") + F.col("spec")) / 4)
    assert got.groupBy("spec", section).agg(F.countDistinct(F.left("rule", F.lit(1))).alias("n")).where("n > 1").count() == 0
