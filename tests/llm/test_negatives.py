"""Hard negatives against a search over all pairs."""

import math
import random

import pytest

from cindergrid.llm import negatives, registry

SCHEMA = "vec_id long, embedding array<float>, label int, score string, part int, rank int"


def brute(rows, chosen, positives=5, k=5, least=80):
    """rows: (vec_id, vector, label), in Python's whole numbers."""
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = {}
    for i, v, y in ok:
        own[i] = min(own.get(i, (y, v)), (y, v))
    out = []
    for i, (y, v) in own.items():
        if chosen(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, (z, w) in own.items() if j != i and len(w) == len(v))
            for s, j, _ in [x for x in scored if x[2] == y][:positives]:
                near = [x for x in scored if x[2] != y and least * -s <= 100 * -x[0] <= 100 * -s][:k]
                out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(near, 1)]
    return sorted(out)


def got(spark, rows, chosen="vec_id % 3 = 0"):
    df = spark.createDataFrame([(i, v, y, "s", 1, 2) for i, v, y in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(df, chosen).collect())


def vectors(n, dim, seed, labels=3, spread=0.3):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [float(int(64 * (m + rng.gauss(0, spread))) / 64) for m in rng.choice(middle)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("n, dim, labels", [(1, 3, 1), (5, 3, 2), (120, 4, 3), (300, 2, 7)])
def test_all_pairs(spark, n, dim, labels):
    rows = vectors(n, dim, n, labels)
    assert got(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_many_parts_and_blocks(spark, monkeypatch):
    """Small parts, blocks and leaves, so that every level of both trees is walked; one vector is a third of the rows."""
    for name, value in (("PART_ROWS", 40), ("PART_ASKS", 20), ("ROWS", 16), ("ASKS", 8), ("LEAF", 4), ("AT_ONCE", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(260, 3, 9)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(130)]
    assert got(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_edges(spark):
    inf = float("inf")
    rows = [(None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, inf], 1), (4, [1.0, float("nan")], 1), (6, [1.0, 1.0], None), (9, [0.0, 0.0], 1), (12, [], 1), (15, [], 2), (15, [], 2), (18, [1.0], 1), (21, [1.0], 2), (24, [1.0], 1),
            (27, [1.0, 1.0], 1), (27, [1.0, 1.0], 1), (27, [5.0, 1.0], 1), (30, [1.0, 1.0], 2), (33, [1.0, 1.0], 1), (36, [1.0, .9], 2), (39, [-1.0, -1.0], 1), (42, [1.0, .5], 2), (45, [.999, .001], 2), (48, [-.001, 0.0], 2)]
    want = brute(rows, lambda i: i % 3 == 0)
    assert got(spark, rows) == want and len(want) > 10
    assert negatives.mine(spark.createDataFrame([], SCHEMA), "vec_id > 0").collect() == []


def test_large_components(spark):
    rows = [(i, [float(2 ** 21 + i), float(2 ** 22 - 2 * i)], i % 2) for i in range(24)]
    assert got(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_products_are_exact():
    import numpy as np
    for most in (1 << 8, 1 << 30, 1 << 40):
        a = np.array([[most - 1, most - 3], [1 - most, 5]])
        assert negatives.products(a, a).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in a.tolist()] for p in a.tolist()]


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in registry.read(spark, d, "embeddings").collect()]
    found = registry.op12_dual_tree_negatives(spark, d)
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, lambda i: i % 100 == 0)
