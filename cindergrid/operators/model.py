"""Risk model: folds of whole groups, classifiers, out-of-fold scores, importance by permutation, risk surfaces and summaries."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cindergrid.functions.exprs import prior_corrected, wind_from
from cindergrid.operators import boosting
from cindergrid.operators.metrics import average_precision, average_precisions
from cindergrid.operators.state import numbered, written
from cindergrid.operators.windows import percentile_rank

GROUPS = 1_000_000


def block(x, y, size=10_000):
    """Id of the square block of a place."""
    return F.floor(x / size) * 100_000 + F.floor(y / size)


def group_folds(df, group, k=5):
    """group and fold: whole groups, the largest first, each to the fold of the fewest rows so far (the first of equals; groups of equal size in order).

    Groups are blocks or years; over GROUPS of them raise an error, as their counts are put in order on the driver.
    """
    sizes = df.groupBy(group).count().orderBy(F.desc("count"), group).limit(GROUPS + 1).collect()
    if len(sizes) > GROUPS:
        raise ValueError(f"over {GROUPS} groups: take larger blocks")
    load, out = [0] * k, []
    for r in sizes:
        f = load.index(min(load))
        load[f] += r["count"]
        out.append((r[group], f))
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"{group} {kind}, fold int")


def features_of(df, drop):
    """Columns that a model may see: all but those named, in order."""
    return [c for c in df.columns if c not in set(drop)]


def logistic(features, label, penalty=1e-4):
    """Logistic baseline on scaled values; missing values are 0."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"{c}_zero" for c in features], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=penalty)])


def prepared(df, features):
    """The columns that logistic reads."""
    return df.withColumns({f"{c}_zero": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})


def scored(model, df, features):
    """df with score, the probability of label 1."""
    if isinstance(model, boosting.Model):
        return boosting.scored(df, model)
    out = model.transform(prepared(df, features))
    return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def fitted(estimator, df, features, label):
    """estimator fitted to all rows. The logistic model, which reads its rows in each of its steps, reads rows of equal features and label once, with their count as weight."""
    rows, last = prepared(df, features), estimator.getStages()[-1] if isinstance(estimator, Pipeline) else None
    if not isinstance(last, LogisticRegression) or last.isSet("weightCol"):
        return estimator.fit(rows)
    first = Pipeline(stages=estimator.getStages()[:-1]).fit(rows)
    counted = rows.groupBy(*[f"{c}_zero" for c in features], label).agg(F.count("*").cast("double").alias("_n"))
    return PipelineModel([*first.stages, last.copy({last.weightCol: "_n"}).fit(first.transform(counted))])


def out_of_fold(df, estimator, features, label, fold="fold"):
    """Each row scored by a model of the other folds; a fold whose training rows have one label gets their share of positives."""
    folds, parts = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()], []
    for f in folds:
        train, held = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        share = train.agg(F.avg(label)).first()[0]
        parts.append(held.withColumn("score", F.lit(share)) if share in (None, 0, 1) else scored(fitted(estimator, train, features, label), held, features))
    return reduce(lambda a, b: a.unionByName(b), parts)


def boosted_out_of_fold(df, features, label, fold="fold", **how):
    """Each row scored by boosted trees of the other folds; all folds grow in the same jobs. how: as of boosting.boost."""
    return boosting.scored(df, boosting.boost(df, features, label, fold, **how), fold)


def prior_out_of_fold(df, label, fold="fold"):
    """Each row scored by the share of positives in the other folds."""
    each = df.groupBy(fold).agg(F.sum(label).alias("_p"), F.count(label).alias("_n"))
    whole = each.agg(F.sum("_p").alias("_wp"), F.sum("_n").alias("_wn"))
    share = each.crossJoin(whole).select(fold, F.try_divide(F.col("_wp") - F.col("_p"), F.col("_wn") - F.col("_n")).alias("score"))
    return df.join(share, fold)


def shuffled(df, columns, key, repeats, seed=42):
    """key, repeat and _dealt, a struct of the columns of another row: in every repeat the rows in one drawn order take the values of rows in another, so each row's values are dealt once."""
    rows = df.select(key, F.struct(*columns).alias("_dealt"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    draw = lambda s: F.xxhash64(F.lit(s), "repeat", key)
    to, of = (numbered(rows, [F.col("repeat"), draw(s), F.col(key)], "_n") for s in (seed, -seed - 1))
    return to.select(key, "repeat", "_n").join(of.select("_n", "_dealt"), "_n").drop("_n")


def permutation_importance(model, df, features, label, key, repeats=10, seed=42):
    """feature, mean and sd of the loss in average precision over the repeats. key: a column without equal values. All features and repeats are scored in one pass."""
    df = written(df.select(key, label, *features))
    whole = average_precision(scored(model, df, features), label, "score").first()[0]
    own = df.join(written(shuffled(df, features, key, repeats, seed)), key)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"_dealt.{x}" if x == c else x).alias(x) for x in features]) for c in features])).alias("_row")
    rows = own.select(label, "repeat", each).select(label, "repeat", "_row.*")
    lost = average_precisions(scored(model, rows, features), ["feature", "repeat"], label, "score").select("feature", (F.lit(whole) - F.col("ap")).alias("lost"))
    return lost.groupBy("feature").agg(F.avg("lost").alias("mean"), F.stddev_pop("lost").alias("sd")).orderBy(F.desc("mean"))


def risk_surface(model, cells, features, fraction, by=()):
    """cells with risk (score after undoing the sampling), rank (0 to 100, ties averaged; within each value of by, such as dates) and per_10000."""
    out = written(scored(model, cells, features).withColumn("risk", prior_corrected(F.col("score"), fraction)))
    out = percentile_rank(out, "risk", by)
    return out.withColumn("rank", F.col("pct") * 100).withColumn("per_10000", F.col("risk") * 10_000).drop("pct")


def override_wind(df, speed=None, direction=None):
    """df with wind columns of a scenario, where one is given: u and v of a wind of the speed from the direction."""
    if speed is None or direction is None:
        return df
    turn = F.radians(F.lit(float(direction)))
    return df.withColumns({"u_wind": -speed * F.sin(turn), "v_wind": -speed * F.cos(turn), "wind_speed": F.lit(float(speed))})


def conditions(df, *means):
    """One row: the mean of each column, and the mean wind's speed (miles an hour) and bearing."""
    u, v = F.avg("u_wind"), F.avg("v_wind")
    return df.agg(*[F.avg(c).alias(c) for c in means], (F.hypot(u, v) * 2.23694).alias("wind_mph"), wind_from(u, v).alias("wind_from"))


def labelled_union(cases, controls):
    """Cases under controls, with ignition 1 and 0."""
    return cases.withColumn("ignition", F.lit(1)).unionByName(controls.withColumn("ignition", F.lit(0)), allowMissingColumns=True)


def prevalence(cases, cells, days, ratio):
    """One row: positives, cell_days, prevalence, controls, sampled prevalence and the fraction of negatives sampled."""
    n = F.count("*").cast("double")
    whole = F.lit(float(cells * days))
    return cases.select("cell", "day").distinct().agg(F.count("*").alias("positives"), F.lit(cells * days).alias("cell_days"), (n / whole).alias("prevalence"), (F.count("*") * ratio).alias("controls"),
                                                      (n / (n * (1 + ratio))).alias("sampled_prevalence"), F.try_divide(n * ratio, whole - n).alias("fraction"))
