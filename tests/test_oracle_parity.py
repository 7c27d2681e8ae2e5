"""DuckDB parity of the catalogue on the smallest test tables (the driver checks sf0.01)."""
import os

import duckdb
import pytest

import __spark_entry__ as se
from evalspark.plans import catalog
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
FAST = ["composite_leaderboard", "subject_accuracy", "pass_summary", "pass_by_language_rollup",
        "latency_summary", "ppl_summary", "token_perplexity", "choice_accuracy", "registry_flatten",
        "generation_exact_match", "subject_spread", "exercise_matrix_long"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_parity(spark, con, name):
    df = se.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    sh, sl = digest(srows, df.columns)
    dh, dl = digest(drows, dcols)
    assert sh == dh, (sorted(set(sl) - set(dl))[:3], sorted(set(dl) - set(sl))[:3])


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    assert set(catalog.QUERIES) <= set(se.oracle_sql())
