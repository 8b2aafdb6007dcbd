"""Every registered query against its DuckDB oracle on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tunelake.plans.catalog import QUERIES
from tunelake.sources.tables import TABLES

from paths import SF_SMALL

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float):
        return round(v, 6)
    return v


# Without SQL: one row for each sample (or group); values are tested by hand elsewhere.
ROWS_WITHOUT_SQL = {"custom_tokenizer_lengths": 200, "score_with_callable": 16,
                    "length_quantiles_approx": 4, "significance_report": 15}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    srows = df.collect()
    if name not in SQLS:
        assert len(srows) == ROWS_WITHOUT_SQL[name]
        return
    res = con.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    drows = res.fetchall()
    assert len(srows) == len(drows)
    order = sorted(cols)

    def canon(rows, names):
        idx = [names.index(c) for c in order]
        return sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)
    a, b = canon([tuple(r) for r in srows], cols), canon(drows, dcols)
    mism = 0
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, (float, int)):
                if abs(u - v) > 1e-6 * max(1, abs(u)):
                    mism += 1
            elif u != v and not (isinstance(u, (list, tuple)) and list(u) == list(v)):
                mism += 1
    assert mism == 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "total_samples" in df.columns
