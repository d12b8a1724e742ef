"""A part of the catalogue against its SQL in another engine, over the smallest tables."""

import math
import os

import pytest

from ruleloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
SOME = ["heading_parse", "section_ranges", "nested_fences", "blocks_islands", "example_bodies", "paragraph_runs", "crossref_resolve", "additions_only", "same_section_pairs", "shares_label_pairs", "edge_dedup", "edge_contexts", "components", "dominant_label", "partition_integrity", "refine_valid", "common_context", "passage_render", "capacity", "result_status", "new_pairs_by_pass"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain([r[i] for i in at] for r in want.fetchall()) == plain(tuple(r) for r in got.select(*columns).collect())


def test_every_query_has_a_stable_name():
    assert len(catalogue.QUERIES) > 80 and set(catalogue.ORACLES) <= set(catalogue.QUERIES)
