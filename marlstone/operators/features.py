"""Feature tables, temporal splits, models and their monitoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import regression_metrics
from .joins import repeated_keys
from .windows import halves


def materialize(df: DataFrame, entity: str, timestamp: str, features: Mapping[str, str], target: str) -> DataFrame:
    """The contract's columns in its types; a column that is absent, or a repeated (entity, timestamp), is an error."""
    if lacking := {entity, timestamp, target, *features} - set(df.columns):
        raise ValueError(f"no column {sorted(lacking)}")
    if bad := repeated_keys(df, [entity, timestamp]).head():
        raise ValueError(f"repeated key {bad.asDict()}")
    return df.select(entity, timestamp, *[F.col(c).cast(t).alias(c) for c, t in features.items()], F.col(target).cast("double").alias(target))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def temporal_split(df: DataFrame, day: str, days: int = 30) -> DataFrame:
    """Rows with part: test for the last `days` days, else train."""
    last = df.agg(F.max(day).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn("part", F.when(F.col(day) > F.date_sub("_last", days), "test").otherwise("train")).drop("_last")


def linear_coefficients(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, n) of least squares on one feature, from sums."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def fit_linear(df: DataFrame, features: Sequence[str], target: str):
    """A pipeline model of least squares on several features (normal equations: one pass, a small matrix on the driver)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assemble = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    return Pipeline(stages=[assemble, LinearRegression(featuresCol="_x", labelCol=target, predictionCol="prediction", solver="normal")]).fit(df)


def fit_logistic(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str):
    """A pipeline model of one-hot categories and numbers; categories not seen in training are ignored."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    index = StringIndexer(inputCols=list(categories), outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_h_{c}" for c in categories])
    assemble = VectorAssembler(inputCols=[*[f"_h_{c}" for c in categories], *numbers], outputCol="_x", handleInvalid="skip")
    return Pipeline(stages=[index, hot, assemble, LogisticRegression(featuresCol="_x", labelCol=label, maxIter=25)]).fit(df)


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """Rows with part, train or test, by a hash of the key, alike for each label."""
    place = F.pmod(F.xxhash64(key, label), F.lit(1000)) / 1000
    return df.withColumn("part", F.when(place < share, "train").otherwise("test"))


def place_sites(df: DataFrame, x: str, y: str, weight: str, k: int, seed: int = 1) -> DataFrame:
    """Rows (site, x, y): centres of weighted k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=[x, y], outputCol="_x").transform(df)
    centres = KMeans(k=k, seed=seed, featuresCol="_x", weightCol=weight).fit(points).clusterCenters()
    return df.sparkSession.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(centres)], "site int, x double, y double")


def score_linear(df: DataFrame, coefficients: DataFrame, x: str) -> DataFrame:
    """prediction from a one-row table of coefficients."""
    return df.crossJoin(F.broadcast(coefficients.select("slope", "intercept"))).withColumn("prediction", F.col("slope") * F.col(x) + F.col("intercept")).drop("slope", "intercept")


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean, over their population deviation (1 where that is below 1e-8)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(stats))
    return both.select(*[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))).alias(c) if c in columns else F.col(c) for c in df.columns])


def drift(df: DataFrame, day: str, features: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """Rows (feature, reference_mean, current_mean, reference_std, shift, drifted): the change of mean between the halves of the days, in deviations."""
    long = halves(df, day).select("period", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e")).select("period", "e.*")
    ref, cur = F.col("period") == "reference", F.col("period") == "current"
    s = long.groupBy("feature").agg(F.avg(F.when(ref, F.col("v"))).alias("reference_mean"), F.avg(F.when(cur, F.col("v"))).alias("current_mean"), F.stddev_samp(F.when(ref, F.col("v"))).alias("reference_std"))
    shift = F.when(F.coalesce("reference_std", F.lit(0.0)) == 0, 0.0).otherwise(F.abs(F.col("current_mean") - F.col("reference_mean")) / F.col("reference_std"))
    return s.withColumn("shift", shift).withColumn("drifted", F.col("shift") >= threshold)


def performance(df: DataFrame, truth: str, predicted: str, reference_mae: float, ratio: float = 1.25) -> DataFrame:
    m = regression_metrics(df, truth, predicted)
    return m.withColumns({"mae_ratio": F.col("mae") / reference_mae, "degraded": F.col("mae") / reference_mae >= ratio})


def retrain_decision(drifted: DataFrame, performed: DataFrame, least: int = 2) -> DataFrame:
    """One row (retrain, reasons): at least so many drifted features, or degraded performance."""
    d = drifted.agg(F.count_if("drifted").alias("n"))
    both = d.crossJoin(F.broadcast(performed.select("degraded")))
    many: Column = F.col("n") >= least
    reasons = F.concat_ws("; ", F.when(many, F.format_string("%d features drifted", "n")), F.when(F.col("degraded"), F.lit("performance degraded")))
    return both.select((many | F.col("degraded")).alias("retrain"), reasons.alias("reasons"))
