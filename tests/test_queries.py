"""Every query against its SQL oracle, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from mendseq.plans.reads_view import noisy_reads

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{TABLES / name}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].round(6).astype(str)
    return df.sort_values(list(df.columns)).values.tolist()


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 1500


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, engine, name):
    ours = contract.queries()[name](spark, str(TABLES)).toPandas()
    assert len(ours)
    oracle = contract.oracle_sql().get(name)
    if oracle is not None:
        theirs = engine.sql(oracle).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert plain(ours) == plain(theirs)


def test_noisy_reads_change_only_their_errors(spark, tmp_path):
    """Null and short reads, errors beyond the end, several in a read, none."""
    lines = [(1, 0, 0, 0), (1, 0, 0, 1), (1, 0, 0, 5), (2, 0, 0, 5), (3, 0, 0, 0), (5, 0, 0, 0), (6, 0, 0, 0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = [(0, 1, "@1", "ACGTACGTACGTACGTAC", "I" * 18), (0, 2, "@2", "ACG", "III"), (0, 3, "@3", "N", None), (0, 4, "@4", "AC", "II"),
            (0, 5, "@5", None, None), (0, 6, "@6", "", "")]
    reads = spark.createDataFrame(rows, "file_ind int, read_idx bigint, id string, seq string, qual string")
    found = {r.read_idx: (r.seq, r.qual) for r in noisy_reads(spark, str(tmp_path), reads).collect()}
    assert found == {1: ("GCGTACGTACGTACGTAT", "I" * 17 + "#"), 2: ("ACG", "III"), 3: ("N", None), 4: ("AC", "II"), 5: (None, None), 6: ("", "")}
