"""Rankers and their evaluation: labels, forest, ridge, isolation forest, cold start, Gini, Spearman, precision at k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .quantiles import average_ranks

FEATURES = ["lrs", "cc", "nd", "loc", "fo", "fan_in", "total_churn", "authors_90d", "directed_coupling", "convention_bug_fix_count"]
COLD_FEATURES = ["commit_count", "author_count", "author_entropy", "burst_score", "isolation_rate", "age_days", "last_touch_days", "authors_90d"]
CUTOFFS = (10, 20, 50, 100, 200)


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with the features as doubles, NULL as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def gini(df: DataFrame, column: str) -> DataFrame:
    """One row (gini); 0 without rows or where all is 0. Equal values share a run of positions, so a histogram is enough."""
    hist = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    h = hist.select("v", "c", F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("c").over(Window.partitionBy()).alias("n"))
    # The positions b + 1 .. b + c add up to c b + c (c + 1) / 2.
    part = (2 * (F.col("c") * F.col("b") + F.col("c") * (F.col("c") + 1) / 2) - (F.col("n") + 1) * F.col("c")) * F.col("v")
    g = h.agg(F.sum(part).alias("x"), F.max("n").alias("n"), F.sum(F.col("c") * F.col("v")).alias("t"))
    return g.select(F.when(F.coalesce("t", F.lit(0.0)) == 0, 0.0).otherwise(F.col("x") / (F.col("n") * F.col("t"))).alias("gini"))


def top_decile_share(df: DataFrame, column: str) -> DataFrame:
    """One row (share): what part of the total the top tenth of the rows (rounded up) have; NULL for a total of 0."""
    hist = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    h = hist.select("v", "c", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("c").over(Window.partitionBy()).alias("n"))
    k = F.greatest(F.ceil(F.col("n") * 0.1), F.lit(1))
    taken = F.greatest(F.least(F.col("c"), k - F.col("b")), F.lit(0))
    return h.agg(F.sum(taken * F.col("v")).alias("x"), F.sum(F.col("c") * F.col("v")).alias("t")).select(F.when(F.col("t") > 0, F.col("x") / F.col("t")).alias("share"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho): Pearson's correlation of the average ranks; 0 where a side is constant."""
    r = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    m = r.agg(F.covar_pop("_ra", "_rb").alias("c"), (F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("d"))
    return m.select(F.when(F.coalesce(F.col("d"), F.lit(0.0)) == 0, 0.0).otherwise(F.col("c") / F.col("d")).alias("rho"))


def precision_at_k(df: DataFrame, score: str, label: str, key: str, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """(k, precision, base_rate): hits among the first min(k, n) rows by score, ties by key."""
    top = df.orderBy(F.desc(score), key).limit(max(cutoffs)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key)))
    hit = F.coalesce(F.col(label).cast("int"), F.lit(0))
    base = df.agg(F.avg(hit).alias("base_rate"))
    ks = F.explode(F.array(*map(F.lit, cutoffs)))
    return top.withColumn("k", ks).filter("_r <= k").groupBy("k").agg((F.sum(hit) / F.count("*")).alias("precision")).crossJoin(F.broadcast(base))


def screen(df: DataFrame, score: Column, skip: float = 0.03, run: float = 0.06) -> DataFrame:
    """One row (mean_score, verdict): run, ambiguous or skip."""
    m = df.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"))
    return m.withColumn("verdict", F.when(F.col("mean_score") >= run, "run").when(F.col("mean_score") >= skip, "ambiguous").otherwise("skip"))


def cold_start_route(functions: DataFrame, positives: int = 0, low_gini: float = 0.55, uniform: float = 0.2) -> DataFrame:
    """One row (route, top_share, gini, positive_rate). functions: commit_count (NULL is 0).

    uniform_prior where the top tenth has under a fifth of all commits; anomaly for a positive rate from 5 to 30 per cent of some entropy, or
    commits spread evenly; else formula.
    """
    f = functions.withColumn("_c", F.coalesce(F.col("commit_count").cast("double"), F.lit(0.0)))
    row = f.agg(F.count("*").alias("n")).crossJoin(top_decile_share(f, "_c").withColumnRenamed("share", "top_share")).crossJoin(gini(f, "_c"))
    rate = F.when(F.col("n") > 0, F.lit(float(positives)) / F.col("n")).otherwise(0.0)
    few = (F.lit(positives) > 0) & (rate >= 0.05) & (rate < 0.3) & (binary_entropy(rate) > 0.3)
    route = F.when((F.col("n") == 0) | (F.col("top_share") < uniform), "uniform_prior").when(few, "anomaly").when(F.col("gini") < low_gini, "anomaly").otherwise("formula")
    return row.select(route.alias("route"), "top_share", "gini", rate.alias("positive_rate"))


# Isolation forest ------------------------------------------------------------------------------------------------------------------


def normalizer(n: int) -> float:
    """The mean path length of an unsuccessful search among n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0


class IsolationForest:
    """Trees over bounded subsamples; score() gives 2 to the power of -mean path / normalizer(subsample)."""

    def __init__(self, rows: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.size, limit = subsample, int(np.ceil(np.log2(max(subsample, 2))))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[:subsample]], limit, rng) for _ in range(trees)]

    @staticmethod
    def _grow(rows: np.ndarray, limit: int, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            me = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (path, depth + normalizer(len(part)))):
                column.append(value)
            if depth >= limit or len(part) <= 1:
                return me
            f = int(rng.integers(part.shape[1]))
            lo, hi = part[:, f].min(), part[:, f].max()
            if lo == hi:
                return me
            at = rng.uniform(lo, hi)
            below = part[:, f] < at
            if below.all() or not below.any():
                return me
            feature[me], cut[me] = f, at
            left[me] = node(part[below], depth + 1)
            right[me] = node(part[~below], depth + 1)
            return me

        node(rows, 0)
        return tuple(map(np.array, (feature, cut, left, right, path)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                low = rows[i, feature[at[i]]] < cut[at[i]]
                at[i] = np.where(low, left[at[i]], right[at[i]])
            total += path[at]
        return 2 ** (-(total / len(self.trees)) / normalizer(self.size))


def anomaly_scores(df: DataFrame, features: Sequence[str], key: str, trees: int = 100, subsample: int = 256, seed: int = 42) -> DataFrame:
    """df with anomaly_score. The trees are grown on the driver from trees * subsample rows of the least hashes of key; rows are scored in place."""
    x = filled(df, features)
    sample = x.orderBy(F.xxhash64(F.lit(seed), key), key).limit(trees * subsample).select(*features).toPandas().to_numpy(float)
    if not len(sample):
        return df.withColumn("anomaly_score", F.lit(None).cast("double"))
    forest = df.sparkSession.sparkContext.broadcast(IsolationForest(sample, trees, subsample, seed))

    @F.pandas_udf("double")
    def score(row: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.value.score(row.to_numpy(float)))

    return df.withColumn("anomaly_score", score(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])))


# Trained rankers -------------------------------------------------------------------------------------------------------------------


def _assembled(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    x = filled(df, features)
    if label is not None:
        x = x.withColumn("_y", F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(x)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 6, seed: int = 42):
    """A forest of depth-limited trees on 80 % bootstraps, some features a split."""
    from pyspark.ml.classification import RandomForestClassifier

    made = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=seed, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")
    return made.fit(_assembled(df, features, label))


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0):
    """Least squares with an L2 penalty on standardised features."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="_x", labelCol="_y", regParam=alpha, elasticNetParam=0.0, standardization=True, predictionCol="_c").fit(_assembled(df, features, label))


def save(model, path: str) -> None:
    """Writes a fitted ranker to a folder."""
    model.write().overwrite().save(path)


def load(path: str, kind: str):
    """A ranker that save() wrote; kind is 'ridge' or 'forest', as train() named it."""
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.regression import LinearRegressionModel

    return (LinearRegressionModel if kind == "ridge" else RandomForestClassificationModel).load(path)


def ranked(df: DataFrame, model, features: Sequence[str], name: str = "score") -> DataFrame:
    """df with the model's score in 0..1."""
    out = model.transform(_assembled(df, features))
    if "_p" in out.columns:
        from pyspark.ml.functions import vector_to_array

        value = vector_to_array("_p")[1]
    else:
        value = F.least(F.greatest(F.col("_c"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn(name, value).select(*df.columns, name)


def _with_folds(df: DataFrame, key: str, n: int, folds: int) -> DataFrame:
    """df with _fold: contiguous runs by key of n // folds rows, the last with what is left.

    A range partitioning orders the partitions, each is numbered by itself, and their counts, one row a partition, place them.
    """
    x = stored(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()), "folds")
    before = x.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    at = F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return x.join(F.broadcast(before), "_p").withColumn("_fold", F.least(F.floor(at / (n // folds or 1)), F.lit(folds - 1))).drop("_p", "_b")


def regime(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3) -> DataFrame:
    """One row (verdict, delta_rho): by how much a shallow forest ranks better than ridge on contiguous folds by key. Under 5 % positives: unreliable."""
    spark = df.sparkSession
    n, pos = df.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    made = lambda v, d: spark.createDataFrame([(v, float(d))], "verdict string, delta_rho double")
    if not n or pos < 0.05:
        return made("unreliable", 0.0)
    x = _with_folds(df, key, n, folds).persist()
    gain = []
    for f in range(folds):
        train, test = x.filter(F.col("_fold") != f), x.filter(F.col("_fold") == f)
        rho = []
        for model in (fit_forest(train, features, label, 50, 2, 42 + f), fit_ridge(train, features, label)):
            rho.append(spearman(ranked(test, model, features, "_s").withColumn("_l", F.col(label).cast("double")), "_s", "_l").first()[0])
        gain.append(rho[0] - rho[1])
    x.unpersist()
    d = float(np.mean(gain))
    return made("linear" if d < 0.03 else "weak" if d <= 0.1 else "strong", d)


def train(df: DataFrame, features: Sequence[str], label: str, key: str):
    """(model, kind): ridge where the regime is linear, else a forest; ValueError under 50 rows, 5 positives or 10 negatives."""
    n, pos = df.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0))).first()
    if n < 50 or pos < 5 or n - pos < 10:
        raise ValueError(f"too few rows to train on: {n} with {pos} positives")
    verdict = regime(df, features, label, key).first()[0]
    return (fit_ridge(df, features, label), "ridge") if verdict == "linear" else (fit_forest(df, features, label), "forest")
