"""Every reference query against its DuckDB SQL on the same tables."""

import math
import os

import duckdb
import pytest

from pastline import queries as Q
from pastline import queries_review  # noqa: F401  (registers its queries)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{os.environ.get('SF', DIR)}/{t}.parquet'")
    return c


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, con, name):
    df = Q.QUERIES[name](spark, os.environ.get("SF", DIR))
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    rel = con.execute(Q.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == cols
    want = sorted((tuple(r[at[c]] for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want) > 0
    key = [i for i, c in enumerate(cols) if not any(isinstance(r[i], float) for r in want)]
    order = lambda r: repr([r[i] for i in key] + [round(v, 3) if isinstance(v, float) else v for v in r])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert all(map(same, g, w)), (dict(zip(cols, g, strict=True)), dict(zip(cols, w, strict=True)))
