"""nearest suppliers of parts without a place and of repeated part keys, against the queries' SQL."""

import duckdb
import pytest

from cindergrid.plans.catalog import Q, SQL

PARTS = [(1, 3), (2, None), (None, 4), (4, 8), (4, 7), (5, 7), (5, None), (6, 50), (6, 50), (None, None)]


@pytest.mark.parametrize("name", ["nearest_vector", "nearest_cutoff"])
@pytest.mark.parametrize("keys", [[1, 2, None, 50, 3], [None, None], []])
def test_parts_without_place_and_repeated_keys(spark, tmp_path, name, keys):
    spark.createDataFrame(PARTS, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(SQL[name]).fetchall()
    got = [tuple(r) for r in Q[name](spark, str(tmp_path)).select("ask", "distance", "point").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert keys == [] or name == "nearest_cutoff" or len(got) == 6
