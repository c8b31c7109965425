"""Leaf-wise boosted trees against a plain loop over rows, one split at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid.operators import boosting


def plain(bins, y, trees, rate, leaves, least, l2):
    """The training scores (log-odds), by trees that are grown one split at a time."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def split(rows):
            best = None
            base = g[rows].sum() ** 2 / (h[rows].sum() + l2)
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                for missing_left in (True, False):
                    for cut in range(255):
                        left = np.where(b == 255, missing_left, b <= cut)
                        if min(left.sum(), (~left).sum()) >= least:
                            i, j = rows[left], rows[~left]
                            gain = g[i].sum() ** 2 / (h[i].sum() + l2) + g[j].sum() ** 2 / (h[j].sum() + l2) - base
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                                best = (gain, i, j)
            return best
        own = [(np.arange(len(y)), split(np.arange(len(y))))]
        while len(own) < leaves and any(s for _, s in own):
            at = max((k for k, (_, s) in enumerate(own) if s), key=lambda k: own[k][1][0])
            _, i, j = own.pop(at)[1]
            own += [(i, split(i)), (j, split(j))]
        for rows, _ in own:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-raw))


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = ((x[:, 0] > .2) ^ (x[:, 1] > 0) ^ (rng.random(n) < .1)).astype(int)
    x[rng.random((n, 3)) < .15] = np.nan
    rows = [(i, *[None if np.isnan(v) and i % 2 else float(v) for v in r], int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int"), x, y


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_equals_a_plain_loop(spark, monkeypatch, alone):
    monkeypatch.setattr(boosting, "ALONE", alone)
    df, x, y = table(spark)
    how = {"rate": .3, "leaves": 6, "least": 10, "l2": 1.0}
    model = boosting.boost(df, ["a", "b", "c"], "y", None, trees=4, share=0, patience=99, key="id", **how)
    assert len(model.trees) == 4
    got = {r.id: r.score for r in boosting.scored(df, model).collect()}
    bins = boosting.binned(x, boosting.cuts_of(df, ["a", "b", "c"]))
    want = plain(bins, y, 4, **how)
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-5)


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_folds_grow_at_once(spark, monkeypatch, alone):
    monkeypatch.setattr(boosting, "ALONE", alone)
    df, _, _ = table(spark)
    how = {"trees": 3, "rate": .3, "leaves": 5, "least": 8, "share": 0, "patience": 99, "key": "id"}
    all_at_once = boosting.boost(df, ["a", "b", "c"], "y", "fold", **how)
    assert sorted(all_at_once) == [0, 1, 2]
    for k, m in all_at_once.items():
        alone = boosting.boost(df.filter(F.col("fold") != k).withColumn("fold", F.lit(9)), ["a", "b", "c"], "y", None, **how)
        assert len(m.trees) == len(alone.trees) == 3
    held = boosting.scored(df, all_at_once, "fold")
    assert held.columns == [*df.columns, "score"] and held.filter("score is null or score < 0 or score > 1").count() == 0


def test_stops_early_and_keeps_the_best(spark, monkeypatch):
    """Both ways stop at the same tree, and have the same trees."""
    monkeypatch.setattr(boosting, "KEEP", 3)
    df, _, _ = table(spark, 400)
    noise = df.withColumn("y", F.when(F.pmod(F.xxhash64("id"), F.lit(12)) == 0, 1 - F.col("y")).otherwise(F.col("y")))
    made = []
    for alone in (0, 1 << 20):
        monkeypatch.setattr(boosting, "ALONE", alone)
        made.append(boosting.boost(noise, ["a", "b", "c"], "y", None, trees=60, rate=.5, leaves=8, least=5, patience=4, key="id"))
    assert 0 < len(made[0].trees) == len(made[1].trees) < 50
    for a, b in zip(*(m.trees for m in made)):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist() and a.value.tolist() == b.value.tolist()


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_and_missing_values(spark, label):
    df = spark.createDataFrame([(i, None, float("nan"), label) for i in range(20)], "id long, a double, b double, y int")
    model = boosting.boost(df, ["a", "b"], "y", None, trees=3, key="id")
    assert {r.score for r in boosting.scored(df, model).collect()} == {float(label)}
    mixed = df.withColumn("y", (F.col("id") % 2).cast("int"))
    model = boosting.boost(mixed, ["a", "b"], "y", None, trees=3, least=1, key="id")
    assert {round(r.score, 6) for r in boosting.scored(mixed, model).collect()} == {.5}


def test_missing_values_have_a_side(spark):
    """Only missing values are positive: one split at the least tells them apart."""
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 7), int(i % 4 == 0)) for i in range(400)], "id long, a double, y int")
    model = boosting.boost(df, ["a"], "y", None, trees=30, rate=.5, leaves=2, least=5, share=.2, key="id")
    got = {(r.y, r.score > .5) for r in boosting.scored(df, model).collect()}
    assert got == {(0, False), (1, True)}


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_equal_rows_are_one_row_with_a_count(spark, monkeypatch, alone):
    """what grows the trees has a row for each distinct one, and the trees are those of all rows."""
    monkeypatch.setattr(boosting, "ALONE", alone)
    kept, write = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda df: kept.append(write(df)) or kept[-1])
    df, x, y = table(spark)
    many = df.join(spark.range(40).select(F.col("id").alias("copy")))
    how = {"trees": 4, "rate": .3, "leaves": 6, "l2": 1.0, "share": 0, "patience": 99, "key": "id"}
    model = boosting.boost(many, ["a", "b", "c"], "y", None, least=400, **how)
    assert kept[0].count() <= 300 and kept[0].agg(F.sum("n")).first()[0] == 12_000
    bins = boosting.binned(x, model.cuts)
    want = plain(np.repeat(bins, 40, axis=0), np.repeat(y, 40), 4, .3, 6, 400, 1.0)[::40]
    assert np.allclose(model.of_bins(bins), want, atol=1e-5)
    values = np.where(np.isnan(x), np.nan, x)
    alike = model.probability(values)
    assert (alike == model.of_bins(bins)).all()
    monkeypatch.setattr(boosting, "TABLE", 1 << 30)
    assert (model.tabled().probability(values) == alike).all() and model.all is not None


def test_sums_are_whole_beyond_doubles():
    values = np.array([(1 << 53) + 1, 3, -(1 << 53) - 1, 5])
    assert boosting.added(np.array([0, 0, 1, 1]), values, 2).tolist() == [(1 << 53) + 4, -(1 << 53) + 4]
