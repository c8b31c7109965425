import datetime
import math

import duckdb
import pytest

from cindergrid.plans.catalog import Q, SQL

DIR = "/root/testdata/sf0.01"


def norm(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events labels documents embeddings".split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    rel = con.sql(SQL[name])
    cols = sorted(rel.columns)
    got = Q[name](spark, DIR)
    assert sorted(got.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    def order(row):
        return [(0, round(v, 5), "") if isinstance(v, float) else (1, 0, v) for v in row]
    want = sorted((tuple(norm(r[i]) for i in at) for r in con.sql(SQL[name]).fetchall()), key=order)
    have = sorted((tuple(norm(v) for v in r) for r in got.select(*cols).collect()), key=order)
    assert len(want) == len(have)
    for a, b in zip(want, have):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)
