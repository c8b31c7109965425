import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cindergrid.plans.catalog import Q


@pytest.fixture(scope="module")
def axis(tmp_path_factory):
    """Customers over bins' edges, in bins without suppliers and outside of all suppliers; gaps between bins."""
    d, asks, have = tmp_path_factory.mktemp("axis"), [-950.0, 5.0, 995.0, 1005.0, 2500.0, 4100.0, 5990.0, 9999.0, 1000.0], [-20.0, 990.0, 1900.0, 6010.0, 7000.0]
    pq.write_table(pa.table({"c_custkey": list(range(len(asks))), "c_acctbal": asks}), d / "customer.parquet")
    pq.write_table(pa.table({"s_suppkey": list(range(len(have))), "s_acctbal": have}), d / "supplier.parquet")
    return str(d), asks, have


def test_nearest_is_over_the_whole_axis(spark, axis):
    d, asks, have = axis
    assert {r.c_custkey: r.near for r in Q["nearest_axis"](spark, d).collect()} == {k: min((abs(v - x), x) for x in have)[1] for k, v in enumerate(asks)}


def test_blocks_have_dense_ranks(spark, axis):
    d, asks, _ = axis
    rank = {b: k for k, b in enumerate(sorted({v // 1000 for v in asks}))}
    assert {r.c_custkey: r.block for r in Q["block_ids"](spark, d).collect()} == {k: rank[v // 1000] for k, v in enumerate(asks)}
