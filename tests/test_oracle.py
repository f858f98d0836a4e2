"""Each registered query with SQL gives DuckDB's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

from paywarden.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def _norm(rows):
    cell = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x if isinstance(x, (int, bool)) else str(x)
    return sorted(str([cell(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in found.fetchall()]
    assert _norm(df.select(*cols).collect()) == _norm(want)


def test_only_these_lack_sql():
    """pii_full_sweep is compared with plain Python in test_engine, metrics_text's parts are decision_metrics and a test of its lines."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"pii_full_sweep", "metrics_text"}


def test_metrics_text_runs(spark):
    lines = [r.line for r in QUERIES["metrics_text"](spark, SF).orderBy("no").collect()]
    assert lines[0].startswith("# HELP paywarden_mpa_events_total") and len([x for x in lines if x.startswith("paywarden_payment_amount_usd")]) == 13
