import math
from statistics import median

import pyarrow as pa
import pyarrow.parquet as pq

from cindergrid.plans import catalog


def draw(a, b, c, seed=11):
    h = (a * 73856093 + b * 19349663 + c * 83492791 + seed * 2654435) % 999983
    for k in (12345, 67891, 24681):
        h = (h * h % 999983 * h + k) % 999983
    return h / 999983


def test_spread_from_a_table_of_few_cells(spark, tmp_path):
    """The reference's repetitions and hours, from a cell that every table has."""
    assert catalog.RUNS >= 20 and catalog.STEPS >= 48
    balance = {k: -900.0 + 10800 * (k * 37 % 101) / 101 for k in range(1, 131)}
    pq.write_table(pa.table({"c_custkey": list(balance), "c_acctbal": list(balance.values())}), tmp_path / "customer.parquet")
    fuel = {k: min(1, .25 + v / 20000) for k, v in balance.items()}
    around = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    where = {divmod(k, 40): k for k in balance}
    reached = {}
    for run in range(catalog.RUNS):
        at = {min(fuel, key=lambda k: (-fuel[k], k)): 0}
        for t in range(1, catalog.STEPS + 1):
            new = set()
            for k, since in at.items():
                if since < t - catalog.BURN:
                    continue
                for i, (dr, dc) in enumerate(around):
                    to = where.get((k // 40 + dr, k % 40 + dc))
                    if to and to not in at and draw(run, k, i + 8 * t) < min(1, .35 * fuel[to] * math.exp(.2 * dc) / math.hypot(dr, dc)):
                        new.add(to)
            at |= dict.fromkeys(new, t)
        for k, t in at.items():
            reached.setdefault(k, []).append(t)
    got = {r.cell: (r.prob, r.arrival) for r in catalog.Q["spread_ensemble"](spark, str(tmp_path)).collect()}
    assert got == {k: (round(len(v) / catalog.RUNS, 6), median(v)) for k, v in reached.items()}
    assert len(got) > 20
