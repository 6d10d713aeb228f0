"""Habitat suitability on a table of 1 km grid cells (row, col, predictors), with ``pyspark.ml``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.timex import col
from fieldlake.operators.joins import drop_neighbours
from fieldlake.session import cut_lineage

AUC_MIN, TSS_MIN = 0.90, 0.70
MAX_CELLS = 150_000


def suitability_class(vote) -> Column:
    value = col(vote)
    return (F.when(value >= 0.75, "High").when(value >= 0.5, "Moderate").when(value >= 0.25, "Low")
            .when(value.isNotNull(), "Very Low"))


def presence_cells(presences: DataFrame, grid: DataFrame, size: float = 1000.0) -> DataFrame:
    """Distinct valid grid cells of the presences (projected x east and y south of the grid origin)."""
    cells = presences.select(F.floor(F.col("y") / size).cast("bigint").alias("row"), F.floor(F.col("x") / size).cast("bigint").alias("col")).distinct()
    return cells.join(grid.filter("valid").select("row", "col"), ["row", "col"], "left_semi")


def pseudo_absences(grid: DataFrame, presences: DataFrame) -> DataFrame:
    """Valid open cells at the species' elevation, away from every presence."""
    open_cells = grid.filter(F.col("valid") & F.col("elevation").between(1400, 3600) & (F.col("forest_fraction") < 0.1))
    return drop_neighbours(open_cells, presences)


def with_blocks(df: DataFrame, side: int = 10) -> DataFrame:
    return df.withColumn("block", F.concat_ws(":", F.floor(F.col("row") / side), F.floor(F.col("col") / side)))


def spatial_split(df: DataFrame, seed: int = 42, share: float = 0.25) -> DataFrame:
    """``is_test`` by a hash of the 10 km block: neighbours never sit on both sides. Checks the minimum sizes."""
    rows = with_blocks(df)
    counts = rows.filter("label = 1").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("b")).first()
    if counts["n"] < 20 or counts["b"] < 6:
        raise ValueError(f"{counts['n']} presence cells in {counts['b']} blocks; 20 in 6 are needed")
    for attempt in range(20):
        part = F.pmod(F.xxhash64(F.lit(seed + attempt), F.col("block")), F.lit(10_000)) < int(share * 10_000)
        tried = rows.withColumn("is_test", part)
        ok = tried.agg(F.count(F.when(F.col("is_test") & (F.col("label") == 1), 1)).alias("p"), F.count(F.when(F.col("is_test") & (F.col("label") == 0), 1)).alias("a"),
                       F.countDistinct(F.when(~F.col("is_test") & (F.col("label") == 1), F.col("block"))).alias("blocks")).first()
        if ok["p"] >= 5 and ok["a"] >= 5 and ok["blocks"] >= 4:
            return tried
    raise ValueError("no independent spatial partition found")


def balanced_sets(train: DataFrame, repeat: int, seed: int = 42) -> DataFrame:
    """All training presences and as many absences drawn by a seeded hash; three folds by block."""
    n = train.filter("label = 1").count()
    absent = train.filter("label = 0").orderBy(F.xxhash64(F.lit(seed + repeat), "row", "col"), "row", "col").limit(n)
    both = train.filter("label = 1").unionByName(absent)
    return both.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + repeat), "block"), F.lit(3)).cast("int"))


class FourierFeatures(Transformer):
    """Random Fourier features of a vector: their inner products approach exp(-gamma |x - y|^2), a radial kernel.

    Feature j is sqrt(2 / n) cos(w_j x + b_j) with normal w_j of variance 2 gamma and b_j uniform over the circle: one matrix product
    for each Arrow batch of rows.
    """

    def __init__(self, size: int, gamma: float, features: int = 128, seed: int = 42, source: str = "features", target: str = "radial"):
        super().__init__()
        rng = np.random.default_rng(seed)
        self.source, self.target, self.features = source, target, features
        self.weights, self.shifts = rng.normal(0.0, np.sqrt(2.0 * gamma), (features, size)), rng.uniform(0.0, 2.0 * np.pi, features)

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, shifts, scale = self.weights, self.shifts, np.sqrt(2.0 / self.features)

        @F.pandas_udf("array<double>")
        def radial(points: pd.Series) -> pd.Series:
            return pd.Series(list(np.cos(np.stack(points.to_numpy()) @ weights.T + shifts) * scale), index=points.index)
        return df.withColumn(self.target, array_to_vector(radial(vector_to_array(self.source))))


class RadialMargin(Estimator):
    """A margin classifier with a radial kernel: a linear one on random Fourier features.

    The kernel's width follows the data (one over the summed variances of the features) and the penalty is one over the rows, which
    weighs margin errors with one against the norm.
    """

    def __init__(self, features: int = 128, seed: int = 42, source: str = "features"):
        super().__init__()
        self.features, self.seed, self.source = features, seed, source

    def _fit(self, df: DataFrame) -> PipelineModel:
        found = df.select(Summarizer.metrics("variance", "count").summary(F.col(self.source)).alias("s")).select("s.variance", "s.count").first()
        spread = float(sum(found["variance"].toArray()))
        radial = FourierFeatures(len(found["variance"]), 1.0 / spread if spread > 0 else 1.0, self.features, self.seed, self.source)
        margin = LinearSVC(featuresCol="radial", maxIter=30, regParam=1.0 / max(int(found["count"]), 1))
        return PipelineModel([radial, margin.fit(radial.transform(df))])


def member_pipelines(predictors, seed: int = 42) -> dict[str, Pipeline]:
    """Scale, at most five principal components, then a classifier: radial margin, forest, logistic."""
    def pipeline(model):
        return Pipeline(stages=[VectorAssembler(inputCols=list(predictors), outputCol="raw"),
                                StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
                                PCA(k=min(5, len(predictors)), inputCol="scaled", outputCol="features"), model])
    return {"radial_svm": pipeline(RadialMargin(seed=seed)),
            "random_forest": pipeline(RandomForestClassifier(numTrees=80, minInstancesPerNode=2, seed=seed)),
            "logistic": pipeline(LogisticRegression(maxIter=100))}


def estimate(model, df: DataFrame) -> DataFrame:
    """Adds ``estimate``: the positive class's probability, or a squashed margin where there is none."""
    out = model.transform(df)
    if "probability" in out.columns:
        value = F.get(vector_to_array("probability"), F.lit(1))
    else:
        value = 1.0 / (1.0 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    return out.withColumn("estimate", value).drop("raw", "scaled", "features", "radial", "rawPrediction", "probability", "prediction")


def evaluate(df: DataFrame, cutoff: float | None = None, score: str = "estimate") -> dict[str, float]:
    """AUC, TSS and the threshold with the best TPR - FPR (or the TSS at a given one).

    One aggregate per distinct score and a running sum over those; only the best row reaches the driver.
    """
    auc = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label").evaluate(df.withColumn(score, F.col(score).cast("double")))
    totals = df.agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n")).first()
    if cutoff is not None:
        hit = F.col(score) >= cutoff
        got = df.agg(F.avg(F.when(F.col("label") == 1, hit.cast("double"))).alias("t"), F.avg(F.when(F.col("label") == 0, hit.cast("double"))).alias("f")).first()
        return {"auc": float(auc), "tss": float(got["t"] - got["f"]), "threshold": cutoff}
    from fieldlake.operators import scale
    steps = df.groupBy((-F.col(score)).alias("s")).agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("n"))
    sums = scale.running(steps.withColumn("k", F.lit(0)), ["k"], ["s"], {"tp": ("sum", F.col("p")), "fp": ("sum", F.col("n"))})
    gain = F.col("tp") / float(totals["p"]) - F.col("fp") / float(totals["n"])
    best = sums.select(gain.alias("gain"), F.col("s")).agg(F.max("gain").alias("gain"), F.max_by("s", F.struct("gain", -F.col("s"))).alias("s")).first()
    return {"auc": float(auc), "tss": float(best["gain"]), "threshold": -float(best["s"])}


@dataclass
class Member:
    name: str
    repeat: int
    model: object
    auc: float
    tss: float
    threshold: float


def fit_committee(train: DataFrame, predictors, repeats: int = 5, seed: int = 42) -> list[Member]:
    """Members that pass AUC 0.90 and TSS 0.70 in blocked cross-validation, refitted on their whole set."""
    kept = []
    for repeat in range(repeats):
        chosen = cut_lineage(balanced_sets(train, repeat, seed))
        folds = chosen.groupBy("fold").agg(F.countDistinct("label").alias("k")).collect()
        if len(folds) < 3 or any(chosen.filter(F.col("fold") != f["fold"]).select("label").distinct().count() < 2 for f in folds):
            continue
        for name, pipeline in member_pipelines(predictors, seed + repeat).items():
            parts = [estimate(pipeline.fit(chosen.filter(F.col("fold") != f)), chosen.filter(F.col("fold") == f)) for f in range(3)]
            scored = cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("label", "estimate"))
            m = evaluate(scored)
            if m["auc"] >= AUC_MIN and m["tss"] >= TSS_MIN:
                kept.append(Member(name, repeat, pipeline.fit(chosen), **m))
    if not kept:
        raise ValueError("no member passed blocked cross-validation")
    return kept


def committee_vote(grid: DataFrame, members: list[Member]) -> DataFrame:
    """Share of members above their own threshold."""
    out, votes = grid, []
    for i, member in enumerate(members):
        out = estimate(member.model, out).withColumn(f"__v{i}", (F.col("estimate") >= member.threshold).cast("double")).drop("estimate")
        votes.append(f"__v{i}")
    total = F.lit(0.0)
    for name in votes:
        total = total + F.col(name)
    return out.withColumn("vote", total / len(votes)).drop(*votes)


def mask_extrapolation(grid: DataFrame, train: DataFrame, predictors) -> DataFrame:
    """Status of each cell; votes outside the training range of any predictor are withheld."""
    ends = train.agg(*[x for p in predictors for x in (F.min(p).alias(f"{p}__lo"), F.max(p).alias(f"{p}__hi"))]).first()
    outside = F.lit(False)
    for p in predictors:
        outside = outside | (F.col(p) < ends[f"{p}__lo"]) | (F.col(p) > ends[f"{p}__hi"])
    status = F.when(~F.col("valid"), "nodata").when(outside, "extrapolation").otherwise("suitable_model_domain")
    rows = grid.withColumn("status", status)
    return rows.withColumn("vote", F.when(F.col("status") == "suitable_model_domain", F.col("vote"))).withColumn("suitability", suitability_class("vote"))


def gate(test: DataFrame, members: list[Member]) -> dict[str, float]:
    """Held-out blocks must pass too, with the vote itself as score and one half as cut."""
    m = evaluate(committee_vote(test, members), 0.5, "vote")
    if m["auc"] < AUC_MIN or m["tss"] < TSS_MIN:
        raise ValueError(f"independent spatial validation failed: {m}")
    return m
