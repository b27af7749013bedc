"""Fitted models: clusters, components, ridge by sufficient statistics, MLlib learners over unit-grouped folds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmill.operators.distances import distance_sums
from fleetmill.operators.quantiles import quantiles
from fleetmill.sources.shared import written


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def kmeans(df: DataFrame, columns: list[str], k: int, seeds: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, list[list[float]]]:
    """(df with cluster, centroids): the cheapest of several seeds; clusters are numbered by their centroids' order."""
    v = vectors(df, columns).persist()
    if k == 1:
        means = v.agg(*[F.avg(c).alias(c) for c in columns]).first()
        v.unpersist()
        return v.drop("features").withColumn("cluster", F.lit(0)), [list(means)]
    fits = [KMeans(k=k, seed=s).fit(v) for s in seeds]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    v.unpersist()
    centres = [list(map(float, c)) for c in best.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    new = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(len(centres))]), F.col("prediction") + 1)
    return best.transform(v).withColumn("cluster", new).drop("features", "prediction"), [centres[i] for i in order]


def relabel_by_size(df: DataFrame, label: str) -> DataFrame:
    """The labels numbered anew: 0 is the largest, of equal sizes that with the least old label."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    new = n.select(label, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__n"), label)) - 1).alias("__new"))  # a row for each label
    return df.join(F.broadcast(new), label).drop(label).withColumnRenamed("__new", label)


def moments(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, n, s_<c>, q_<a>_<b>): count, sums and sums of products, from which covariances of any union follow."""
    aggs = [F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns]]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*(keys or [])).agg(*aggs)


def covariance(row: dict, columns: list[str]) -> np.ndarray:
    n, mean = row["n"], np.array([row[f"s_{c}"] / row["n"] for c in columns])
    place = range(len(columns))
    q = np.array([[row[f"q_{columns[min(i, j)]}_{columns[max(i, j)]}"] for j in place] for i in place])
    return q / n - np.outer(mean, mean)


def first_component(row: dict, columns: list[str]) -> tuple[np.ndarray, float]:
    """(loadings, explained share) of the first principal component; the largest loading is positive."""
    values, vecs = np.linalg.eigh(covariance(row, columns))
    v = vecs[:, -1]
    return v * np.sign(v[np.argmax(np.abs(v))]), float(values[-1] / values.sum())


def component_draws(per_unit: DataFrame, drawn: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, replicate, sensor, loading, explained): the first component of each replicate, from weighted unit moments."""
    keys = keys or []
    names = [c for c in per_unit.columns if c not in ("unit", *keys)]
    reps = per_unit.join(drawn, "unit").groupBy(*keys, "replicate").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                v, share = first_component(row, columns)
                yield pd.DataFrame({**{k: row[k] for k in keys}, "replicate": row["replicate"], "sensor": columns, "loading": v, "explained": share})

    kinds = "".join(f"{k} {per_unit.schema[k].dataType.simpleString()}, " for k in keys)
    return reps.mapInPandas(of, f"{kinds}replicate int, sensor string, loading double, explained double")


def _solved(row: dict, columns: list[str], y: str, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge's weights and intercept from a row of moments."""
    cov = covariance(row, [*columns, y])
    n, sd = row["n"], np.sqrt(np.diag(cov)[:-1])
    sd = np.where(sd == 0, 1.0, sd)
    z = cov[:-1, :-1] / np.outer(sd, sd) * n
    w = np.linalg.solve(z + alpha * np.eye(len(columns)), cov[:-1, -1] / sd * n) / sd
    return w, float(row[f"s_{y}"] / n - sum(w[i] * row[f"s_{c}"] / n for i, c in enumerate(columns)))


def ridge(df: DataFrame, columns: list[str], y: str, alpha: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) on the columns' own scale: features are standardised, the penalty leaves out the intercept.

    One pass gathers the Gram sums; only those, a row of p * p numbers, reach the driver.
    """
    return _solved(moments(df, [*columns, y]).first().asDict(), columns, y, alpha)


def ridge_by_fold(df: DataFrame, columns: list[str], y: str, alphas: list[float], fold: str = "fold") -> DataFrame:
    """(fold, alpha, w_<c>, intercept): ridge fitted on the rows of the other folds, for every fold and penalty.

    One pass gathers each fold's Gram sums; a fold's training sums are those of all others.
    """
    rows = {r[fold]: r.asDict() for r in moments(df, [*columns, y], [fold]).collect()}  # a row for each fold
    out = []
    for k in rows:
        rest = [r for f, r in rows.items() if f != k]
        if rest:
            row = {c: sum(r[c] for r in rest) for c in rest[0] if c != fold}
            for a in alphas:
                w, i = _solved(row, columns, y, a)
                out.append((k, float(a), *map(float, w), i))
    kind = df.schema[fold].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"{fold} {kind}, alpha double, {', '.join(f'w_{c} double' for c in columns)}, intercept double")


def predicted(df: DataFrame, fits: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """df with alpha and raw: each row predicted by the fits of its fold; fits: a row for each fold and penalty."""
    raw = reduce(lambda a, c: a + F.col(c) * F.col(f"w_{c}"), columns, F.col("intercept"))
    return df.join(F.broadcast(fits), fold).withColumn("raw", raw).drop("intercept", *(f"w_{c}" for c in columns))


def linear(columns: list[str], w: np.ndarray, b: float) -> F.Column:
    return reduce(lambda a, x: a + x, [F.col(c) * float(v) for c, v in zip(columns, w, strict=True)], F.lit(float(b)))


#: Portions of rows that a forest draws from, about; ranges of each feature that trees tell apart.
CELL_ROWS, RANGES = 200_000, 32


def in_ranges(df: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """df with the numbers of RANGES ranges between train's exact quantiles for its features, whatever its size.

    MLlib's trees tell 32 ranges of a feature apart as well, between quantiles of 10,000 rows; these are of all rows. A fit meets
    RANGES ** features different rows at most, however many rows there are.
    """
    edges = []
    for c in columns:
        found = quantiles(train, c, {f"q{i}": i / RANGES for i in range(1, RANGES)}).first()  # RANGES - 1 numbers
        edges.append([float("-inf"), *sorted({float(x) for x in found if x is not None and np.isfinite(x)}), float("inf")])
    numbers = [f"__in_{c}" for c in columns]
    out = Bucketizer(splitsArray=edges, inputCols=columns, outputCols=numbers).transform(df)
    # Without the metadata by which MLlib would take the numbers for names.
    return out.select(*[F.col(f"__in_{c}").alias(c, metadata={}) if c in columns else F.col(c) for c in df.columns])


def gathered(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(columns, y, weight, within): df's rows as one for each vector of features, with mean y, number and variance.

    A boosted tree of squared errors sees no more of rows with equal features than these: what y varies within them
    adds the same to every split's errors.
    """
    cells = df.groupBy(*columns).agg(F.avg(y).alias(y), F.count("*").cast("double").alias("weight"), F.var_pop(y).alias("within"))
    return written(cells.repartition(df.sparkSession.sparkContext.defaultParallelism, *columns), "cells")


def forest(train: DataFrame, columns: list[str], y: str, trees: int = 300, seed: int = 42):
    """A forest of trees on draws of portions of train's rows with equal features.

    A portion has about a CELL_ROWS'th of all rows or fewer (of a small table, a row), dealt by their hash, as one row with mean
    y and weight, so that the counts of draws that MLlib holds beside each row don't grow with the table. See `in_ranges` for
    features of few values.
    """
    n = train.count()
    parts = train.groupBy(*[F.col(c).alias(f"__k_{c}") for c in columns]).agg(F.ceil(F.count("*") * CELL_ROWS / max(n, 1)).alias("__parts"))
    same = reduce(lambda e, c: e & F.col(c).eqNullSafe(F.col(f"__k_{c}")), columns, F.lit(True))
    dealt = train.withColumn("__hash", F.xxhash64(*train.columns)).join(parts, same).withColumn("__part", F.pmod("__hash", "__parts"))
    cells = dealt.groupBy(*columns, "__part").agg(F.avg(y).alias(y), F.count("*").cast("double").alias("weight"))
    train = written(cells.repartition(train.sparkSession.sparkContext.defaultParallelism, *columns, "__part"), "cells")
    return RandomForestRegressor(labelCol=y, weightCol="weight", numTrees=trees, maxDepth=6, seed=seed).fit(vectors(train, columns))


def boosted(train: DataFrame, columns: list[str], y: str, rounds: int, validation: str | None = None, seed: int = 42):
    """Boosted trees; with a boolean column of validation rows, rounds stop when their error no longer falls."""
    gbt = GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed)
    if validation:
        return gbt.setValidationIndicatorCol(validation).fit(vectors(train, columns))
    return gbt.setWeightCol("weight").fit(vectors(gathered(train, columns, y), columns))


def stopping_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the least error, whether that is final): the search ends after `patience` rounds without a lower one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def truncated(fit: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The ensemble of the first rounds' trees."""
    java = fit._java_obj
    sc = SparkSession.active().sparkContext
    tree = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weight = sc._gateway.new_array(sc._jvm.double, rounds)
    trees, weights = java.trees(), java.treeWeights()
    for k in range(rounds):
        tree[k], weight[k] = trees[k], weights[k]
    part = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{fit.uid}_{rounds}", tree, weight)
    part.set(part.labelCol(), fit.getLabelCol())
    out = GBTRegressionModel(part)
    out.set(out.labelCol, fit.getLabelCol())
    return out.setFeaturesCol(fit.getFeaturesCol()).setPredictionCol(fit.getPredictionCol())


def boosted_with_patience(train: DataFrame, other: DataFrame, columns: list[str], y: str, rounds: int = 500, patience: int = 50, first: int = 64, seed: int = 42):
    """(model, errors): boosted trees up to the round of least squared error on other rows, searched until `patience` rounds bring no lower one.

    One fit gives the error of each of its rounds. A fit begins with `first` rounds and is made again with twice as many
    while the search is open, up to `rounds`: its first trees are the same, so the result is that of one long fit.
    """
    t, v = (vectors(gathered(df, columns, y), columns).persist() for df in (train, other))
    n, within = min(first, rounds), v.agg(F.sum(F.col("weight") * F.col("within")) / F.sum("weight")).first()[0]
    try:
        while True:
            fit = GBTRegressor(labelCol=y, weightCol="weight", maxIter=n, maxDepth=4, stepSize=0.1, seed=seed).fit(t)
            errors = [e + (within or 0.0) for e in fit.evaluateEachIteration(v, "squared")]
            best, final = stopping_round(errors, patience)
            if final or n == rounds:
                return truncated(fit, best), errors
            n = min(2 * n, rounds)
    finally:
        t.unpersist()
        v.unpersist()


def cross_validated(rows: DataFrame, columns: list[str], y: str, candidates: dict[str, Estimator], folds: int, fold: str = "fold", parallelism: int = 4) -> CrossValidatorModel:
    """Every candidate fitted on every fold's other rows, several fits at once; its sub-models are kept, the best of all is fitted to all rows.

    candidates: by name an estimator that reads "features"; the same learner with another seed is another candidate.
    """
    line = Pipeline(stages=[])
    maps = [{line.stages: [VectorAssembler(inputCols=columns, outputCol="features"), e]} for e in candidates.values()]
    return CrossValidator(estimator=line, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=y), numFolds=folds, foldCol=fold, parallelism=parallelism, collectSubModels=True).fit(rows)


def held_out(model: CrossValidatorModel, rows: DataFrame, names: list[str], fold: str = "fold") -> DataFrame:
    """(rows' columns, candidate, raw): one table with each row predicted by each candidate's model of its fold."""
    parts = [m.transform(rows.where(F.col(fold) == k)).select(*rows.columns, F.lit(n).alias("candidate"), F.col("prediction").alias("raw"))
             for k, fits in enumerate(model.subModels) for n, m in zip(names, fits, strict=True)]
    return reduce(DataFrame.unionByName, parts)


def standardised(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    one = F.broadcast(train.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__d_{c}"))]))  # a single row
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__d_{c}") == 0, 1.0).otherwise(F.col(f"__d_{c}")) for c in columns}
    return df.join(one, F.lit(True)).withColumns(z).drop(*one.columns)


def logistic_probability(train: DataFrame, other: DataFrame, columns: list[str], y: str, c: float = 1.0) -> DataFrame:
    """other with p: L2-penalised logistic regression on features standardised by the training rows."""
    t = vectors(standardised(train, train, columns), columns)
    model = LogisticRegression(labelCol=y, regParam=1.0 / (c * max(t.count(), 1)), standardization=False).fit(t)
    out = model.transform(vectors(standardised(other, train, columns), columns))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *columns)


def out_of_fold(df: DataFrame, folds: int, fit_predict) -> DataFrame:
    """Every fold's rows predicted by a fit on the others: one fit for each of a few folds, one table of results."""
    parts = [fit_predict(df.where(F.col("fold") != k), df.where(F.col("fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def split_gain(patterns: list[tuple[list[float], float]]) -> float:
    """Share of the total sum of squares that the best of a few 2-means splits of weighted points removes."""
    x, w = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns])
    mean = np.average(x, axis=0, weights=w)
    total = float((w * ((x - mean) ** 2).sum(1)).sum())
    if total == 0 or len(x) < 2:
        return 0.0
    best = total
    for start in range(min(5, len(x) - 1)):
        far = np.argsort(-((x - x[start]) ** 2).sum(1), kind="stable")[0]
        centres = x[[start, far]].astype(float)
        for _ in range(25):
            side = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            if side.min() == side.max():
                break
            centres = np.array([np.average(x[side == s], axis=0, weights=w[side == s]) for s in (0, 1)])
        best = min(best, float((w * ((x[:, None] - centres[None]) ** 2).sum(2).min(1)).sum()))
    return 1 - best / total


def silhouette_squared(df: DataFrame, columns: list[str], label: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, silhouette): the mean over all rows, by mean squared Euclidean distances to the clusters.

    These follow from each cluster's size, mean and mean of squares, held in one array for each key: no row is compared
    with another, and rows aren't multiplied. A row that is alone in its cluster counts 0.
    """
    keys = keys or []
    total = lambda xs: reduce(lambda x, y: x + y, xs)
    square = total([F.col(c) * F.col(c) for c in columns])
    stats = df.groupBy(*keys, F.col(label).alias("c")).agg(F.count("*").alias("n"), F.avg(square).alias("q"), *[F.avg(c).alias(f"m_{c}") for c in columns])
    every = stats.groupBy(*keys).agg(F.collect_list(F.struct("c", "n", "q", *[f"m_{c}" for c in columns])).alias("__clusters"))  # a row for each key
    rows = df.join(F.broadcast(every), keys or F.lit(True))
    mean = lambda x: square - 2 * total([F.col(c) * x[f"m_{c}"] for c in columns]) + x["q"]
    own = F.get(F.filter("__clusters", lambda x: (x["c"] == F.col(label)) & (x["n"] > 1)), F.lit(0))
    rows = rows.select(*keys, (mean(own) * own["n"] / (own["n"] - 1)).alias("a"), F.array_min(F.transform(F.filter("__clusters", lambda x: x["c"] != F.col(label)), mean)).alias("b"))
    return rows.groupBy(*keys).agg(F.avg(_silhouette(F.col("a"), F.col("b"))).alias("silhouette"))


def _silhouette(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), 0.0).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))


#: Rows of a box of rows that lie side by side.
BLOCK_ROWS = 8_000


def silhouette(df: DataFrame, columns: list[str], label: str, row_id: str, every: int = 50, keys: list[str] | None = None) -> DataFrame:
    """(keys, silhouette, n): the mean over the rows whose id is divisible by `every`, by mean Euclidean distances to all rows of each cluster.

    Distances are added up by `distance_sums`, in boxes of BLOCK_ROWS rows. A row that is alone in its cluster counts 0; rows of a key that are equal but for their ids count as often as they are.
    """
    keys = keys or []
    asked = F.col(row_id) % every == 0
    far = distance_sums(df.select(*keys, label, *columns, asked.alias("__ask")), columns, label, F.col("__ask"), keys, BLOCK_ROWS)
    own = F.col("__c") == F.col(label)
    per = far.groupBy(*keys, label, *columns, "__asked").agg(F.max(F.when(own & (F.col("__n") > 1), F.col("__s") / (F.col("__n") - 1))).alias("a"), F.min(F.when(~own, F.col("__s") / F.col("__n"))).alias("b"))
    times = F.col("__asked")
    mean = F.sum(_silhouette(F.col("a"), F.col("b")) * times) / F.sum(times)
    return per.groupBy(*keys).agg(mean.alias("silhouette"), F.coalesce(F.sum(times), F.lit(0)).alias("n"))
