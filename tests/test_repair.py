"""Repair of rings against the parity of crossings."""

import random

import pytest
from pyspark.sql import functions as F

from cindergrid.operators import polygons, repair


def odd(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def area(found):
    return sum(repair.signed(r) for p in found for r in p)


@pytest.mark.parametrize("ring, parts, whole", [
    ([(0, 0), (4, 0), (4, 4), (0, 4)], 1, 16),
    ([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], 1, 16),
    ([(0, 0), (4, 4), (4, 0), (0, 4)], 2, 8),
    ([(0, 0), (6, 4), (6, 0), (0, 2)], 2, None),
    ([(0, 0), (4, 0), (4, 0), (9, 0), (4, 0), (4, 4), (4, 4), (0, 4)], 1, 16),
    ([(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)], 1, 16),
    ([(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)], 2, 8),
    ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)], 0, 0),
    ([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0), (3, 3), (3, 6), (6, 6), (6, 3), (3, 3)], 1, 72),
    ([(0, 0), (1, 1), (2, 2)], 0, 0), ([(0, 0), (1, 1)], 0, 0), ([], 0, 0), ([(0, 0), (float("nan"), 1), (2, 0)], 0, 0), ([(0, 0), (None, 1), (2, 0)], 0, 0), (None, 0, 0)])
def test_known_rings(ring, parts, whole):
    found = repair.polygons_of(ring)
    assert len(found) == parts and (whole is None or area(found) == pytest.approx(whole))
    assert all(repair.signed(p[0]) > 0 and all(repair.signed(h) < 0 for h in p[1:]) for p in found)
    assert all(len(set(r)) == len(r) >= 3 for p in found for r in p)


def test_random_rings_keep_their_parity():
    rng = random.Random(3)
    for n in range(3, 16):
        for _ in range(6):
            ring = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)]
            found = repair.polygons_of(ring)
            for _ in range(60):
                x, y = rng.uniform(-1, 11), rng.uniform(-1, 11)
                assert sum(odd(r, x, y) for p in found for r in p) % 2 == odd(ring, x, y)
                assert sum(odd(p[0], x, y) and not any(odd(h, x, y) for h in p[1:]) for p in found) == odd(ring, x, y)
            for p in found:
                for r in p:
                    assert repair.polygons_of(r) and abs(area(repair.polygons_of(r))) == pytest.approx(abs(repair.signed(r)))


def test_rings_on_whole_numbers():
    rng = random.Random(5)
    for _ in range(150):
        ring = [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(3, 9))]
        found = repair.polygons_of(ring)
        for _ in range(25):
            x, y = rng.uniform(0, 5), rng.uniform(0, 5)
            assert sum(odd(r, x, y) for p in found for r in p) % 2 == odd(ring, x, y), ring


def test_rows(spark):
    kind = "k string, ring array<struct<x:double,y:double>>, part int"
    df = spark.createDataFrame([("a", [(0., 0.), (4., 4.), (4., 0.), (0., 4.)], 7), ("b", None, 7), (None, [(0., 0.), (1., 0.), (0., 1.)], 7), ("c", [(0., 0.), None, (1., 1.)], 7)], kind)
    rows = repair.repaired(df, "k", "ring")
    assert sorted((r.k or "", r.part, len(r.rings)) for r in rows.collect()) == [("", 0, 1), ("a", 0, 1), ("a", 1, 1)]
    assert repair.repaired(df.limit(0), "k", "ring").count() == 0
    whole = polygons.coverage(rows.withColumn("k", F.concat_ws("-", "k", "part")), "k", 1.0).agg(F.sum("area")).first()[0]
    assert whole == pytest.approx(8.5)


ORDERS = [2111, 22006, 68857, 79333, 94215, 106860, 121032, 142663, 152111, 172006, 218857, 229333, 244215, 256860, 271032, 292663, 302111, 322006, 368857, 379333, 394215, 406860, 421032, 442663, 452111, 472006, 518857, 529333, 544215, 556860, 571032, 592663, 602111, 622006, 668857, 679333, 694215, 706860, 721032, 742663, 752111, 772006, 818857, 829333, 844215, 856860, 871032, 892663]


def test_points_near_other_edges():
    """rounded crossings of these rings don't close; their area is that of slabs between all heights."""
    for key, orders in ((8, ORDERS), (3, range(3, 423, 7)), (4, range(4, 664, 11))):
        ring = [(o * 7 % 97 + key % 10 / 7.3, o * 11 % 89 + o % 13 / 17.9) for o in orders]
        edges = [(p, q) for p, q in zip(ring, ring[1:] + ring[:1]) if p[1] != q[1]]
        m = [(q[0] - p[0]) / (q[1] - p[1]) for p, q in edges]
        heights = {v[1] for v in ring}
        for i in range(len(edges)):
            for j in range(i):
                if m[i] != m[j]:
                    y = (edges[j][0][0] - m[j] * edges[j][0][1] - edges[i][0][0] + m[i] * edges[i][0][1]) / (m[i] - m[j])
                    if all(min(p[1], q[1]) < y < max(p[1], q[1]) for p, q in (edges[i], edges[j])):
                        heights.add(y)
        want, heights = 0.0, sorted(heights)
        for y0, y1 in zip(heights, heights[1:]):
            y = (y0 + y1) / 2
            xs = sorted(p[0] + (y - p[1]) * s for (p, q), s in zip(edges, m) if (p[1] > y) != (q[1] > y))
            want += (y1 - y0) * sum(b - a for a, b in zip(xs[::2], xs[1::2]))
        got = repair.polygons_of(ring)
        assert abs(sum(repair.signed(r) for p in got for r in p) - want) < 1e-6 and all(repair.signed(p[0]) > 0 for p in got)
