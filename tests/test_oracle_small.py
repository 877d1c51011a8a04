"""A sample of registered queries against their DuckDB oracle on sf0.001
(tools/oracle_check.py runs every query)."""

import pytest

from conftest import SMALL
from tools.oracle_check import TABLES, digest

SAMPLE = [
    "a02_group_prevalence", "a10_a12_bias_aucs", "a14_final_metric", "m18_bias_report",
    "x03_balanced_split", "a20_vocabulary", "a17_doc_mean_vectors", "m06_score_mean",
    "m07_debias_search", "m10_apply_weights_group_toxic", "m16_fuzzed_eval", "s13_metric_report",
]


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() == 9
    assert "subgroup_auc" in out.columns
