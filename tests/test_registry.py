"""The registered queries have SQL twins, and agree with them on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare
from shoebox.workload import oracle
from shoebox.workload import queries as registry

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(oracle.SQL)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["content_hash", "phash", "search_topk", "chunk_manifest", "file_classification", "dup_groups", "near_dup_indexed", "library_stats"])
def test_query_equals_twin(spark, name):
    state, rows, *_ = compare(spark, SMALL, name)
    assert state == "ok", rows


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["score", "id", "s3_path"]
