"""The driver's contract: names, and SQL that agrees on the smallest tables where they are there."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from spanloom import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings snapshot_meta demo file_evidence patches benchmark mix_targets".split()
SAMPLE = ["fragment_sizes", "test_exclusions", "stable_ids", "line_counts", "file_coverage", "region_pairs", "staged_file_match", "patch_rows", "zipped_runs", "grouped_changes", "numbered_groups", "stats_rows", "definition_kinds", "staged_pairs", "planted_snapshot_faults", "planted_overlaps", "planted_manifest_faults", "planted_field_faults", "writing_splits", "ordered_distinct", "coverage_violations", "packet_sources"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.oracle_sql()) <= set(core.queries())
    assert all(callable(q) for q in entry.queries().values())


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(core.oracle_sql()[name]).df()
    got = core.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        return sorted(tuple("" if pd.isna(v) else str(int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
