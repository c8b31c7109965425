"""Ranking, calibration and overlap metrics. Distinct scores are counted first and summed in ranges, so that no task holds all of them."""

from pyspark.sql import functions as F

from cindergrid.operators.state import running


def by_score(scored, label, score):
    """score, pos and neg: how many rows of each label have it."""
    y = F.col(label).cast("long")
    return scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def average_precision(scored, label, score):
    """One row, ap: the sum over distinct thresholds, from the highest, of recall gained times precision; null without positives."""
    rows = running(by_score(scored, label, score), [F.desc("score")], "pos", "neg")
    hits = F.col("pos_before") + F.col("pos")
    return rows.agg(F.try_divide(F.sum(F.try_divide(F.col("pos") * hits, hits + F.col("neg_before") + F.col("neg"))), F.sum("pos")).alias("ap"))


def average_precisions(scored, groups, label, score):
    """ap of each group; null without positives. Counts of distinct scores are summed in ranges of group and score."""
    y = F.col(label).cast("long")
    per = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*groups, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    rows = running(per, [*groups, F.desc("score")], "pos", "neg")
    start = rows.groupBy(*groups).agg(F.min("pos_before").alias("_p"), F.min("neg_before").alias("_n"))
    rows = rows.join(start, groups)
    hits, misses = F.col("pos_before") - F.col("_p") + F.col("pos"), F.col("neg_before") - F.col("_n") + F.col("neg")
    return rows.groupBy(*groups).agg(F.try_divide(F.sum(F.try_divide(F.col("pos") * hits, hits + misses)), F.sum("pos")).alias("ap"))


def roc_auc(scored, label, score):
    """One row, auc: the share of pairs of a positive and a negative that are in order, equals by half; null without positives or without negatives."""
    rows = running(by_score(scored, label, score), ["score"], "neg")
    return rows.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def brier(scored, label, score):
    return scored.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def confusion(rows, truth, found):
    """hits, misses, false_alarms and iou, precision, recall, f1 of two flags; nulls are false, empty denominators count as 1."""
    t, f = (F.coalesce(F.col(c), F.lit(False)) for c in (truth, found))
    n = rows.agg(F.count_if(t & f).alias("hits"), F.count_if(t & ~f).alias("misses"), F.count_if(~t & f).alias("false_alarms"))
    part = lambda *c: F.col("hits") / F.greatest(F.lit(1), sum(map(F.col, c), F.col("hits")))
    n = n.withColumns({"iou": part("misses", "false_alarms"), "precision": part("false_alarms"), "recall": part("misses")})
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall")))


def timing(observed, simulated, least=10):
    """n, mae and bias of simulated against observed times where both are known; null under so many."""
    error = F.col(simulated) - F.col(observed)
    n = F.count(error)
    return [n.alias("n"), F.when(n >= least, F.avg(F.abs(error))).alias("mae"), F.when(n >= least, F.avg(error)).alias("bias")]


def objective(iou, mae, weight=0.3, scale=48):
    """Overlap less a share of the timing error; the overlap alone where there is no timing."""
    return F.when(mae.isNull(), iou).otherwise(iou - weight * F.least(mae / scale, F.lit(1.0)))


def quantiles(df, group, value, shares):
    """q_1, q_2, ... of each group, linear between the two next values. Counts of distinct values are summed in ranges of group and value."""
    per = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    rows = running(per, [group, value], "k")
    start = rows.groupBy(group).agg(F.min("k_before").alias("start"), F.sum("k").alias("n"))
    rows = rows.join(start, group).withColumn("from", F.col("k_before") - F.col("start")).withColumn("to", F.col("from") + F.col("k") - 1)
    out = []
    for i, p in enumerate(shares, 1):
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = (F.max(F.when(f(at).between(F.col("from"), F.col("to")), F.col(value))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q_{i}"))
    return rows.groupBy(group).agg(*out)
