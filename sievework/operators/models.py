"""Consensus models over tool scores: weighted sums, ridge, logistic regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import columns as C


def moments(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row: n, mean and standard deviation of each feature and the sums of products that a ridge fit needs."""
    rows = df.dropna(subset=[*features, target])
    z = C.z_scores(rows, features)
    parts = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(features):
        # z-scores add up to 0, so the sum of products is that with the centred target: large targets would cancel out.
        parts.append((F.covar_pop(f"{a}_z", target) * F.count(F.lit(1))).alias(f"xy_{a}"))
        parts += [F.sum(F.col(f"{a}_z") * F.col(f"{b}_z")).alias(f"xx_{a}_{b}") for b in features[i:]]
    stats = rows.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return z.agg(*parts).crossJoin(stats)


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0) -> dict[str, dict[str, float]]:
    """weights, means and stds: z-scored features, no intercept, target not centred. The driver solves p equations."""
    m = moments(df, features, target).first().asDict()
    p = len(features)
    xx, xy = np.zeros((p, p)), np.zeros(p)
    for i, a in enumerate(features):
        xy[i] = m[f"xy_{a}"] or 0.0
        for j, b in enumerate(features[i:], i):
            xx[i, j] = xx[j, i] = m[f"xx_{a}_{b}"] or 0.0
    w = np.linalg.solve(xx + penalty * np.eye(p), xy)
    return {"weights": dict(zip(features, map(float, w))), "means": {c: m[f"mean_{c}"] for c in features}, "stds": {c: max(m[f"std_{c}"] or 0.0, 1e-9) for c in features}}


def z_of(model: Mapping[str, Mapping[str, float]], feature: str) -> Column:
    return (F.col(feature) - model["means"][feature]) / max(model["stds"][feature], 1e-9)


def weighted(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of w * z over sum of w, over the values that are there; null where that sum of weights is not positive."""
    used = [F.when(values[c].isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()]
    parts = [F.coalesce(values[c] * float(w), F.lit(0.0)) for c, w in weights.items()]
    total = sum(used[1:], used[0])
    return F.when(total > 0, sum(parts[1:], parts[0]) / total)


def apply_linear(df: DataFrame, model: Mapping, name: str = "consensus") -> DataFrame:
    return df.withColumn(name, weighted({c: z_of(model, c) for c in model["weights"]}, model["weights"]))


def contributions(df: DataFrame, model: Mapping, keys: Sequence[str], weights: str = "weights") -> DataFrame:
    """Each feature's w * z, keyed."""
    return df.select(*keys, *[(z_of(model, c) * float(w)).alias(f"c_{c}") for c, w in model[weights].items()])


def importance(contributed: DataFrame, prefix: str = "c_") -> DataFrame:
    """Per feature the share of the sum of absolute contributions."""
    names = [c for c in contributed.columns if c.startswith(prefix)]
    one = contributed.agg(*[F.sum(F.abs(c)).alias(c) for c in names])
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c[len(prefix) :]).alias("feature"), (F.col(c) / total).alias("share")) for c in names])).alias("x")).select("x.*")


def folds(df: DataFrame, gene: str = "gene", k: int = 5, seed: int = 42) -> DataFrame:
    """A fold for each whole gene, by the seeded hash of its name."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col(gene))), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def fit_logistic(df: DataFrame, features: Sequence[str], target: str, cut: float, penalty: float = 0.01, iterations: int = 100) -> dict:
    """betas, intercept, means and stds for the label target >= cut; negatives weigh positives / negatives; L2 on z-scores."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.dropna(subset=[*features, target]).withColumn("label", (F.col(target) >= cut).cast("double"))
    n = rows.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"), *[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    model = {"means": {c: n[f"m_{c}"] for c in features}, "stds": {c: max(n[f"s_{c}"] or 0.0, 1e-9) for c in features}}
    rows = rows.withColumns({f"{c}_z": z_of(model, c) for c in features}).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise((n["p"] or 0.0) / max(n["n"] or 0.0, 1.0)))
    data = VectorAssembler(inputCols=[f"{c}_z" for c in features], outputCol="features").transform(rows)
    fitted = LogisticRegression(weightCol="weight", regParam=penalty, elasticNetParam=0.0, maxIter=iterations, tol=1e-6, standardization=False).fit(data)
    return model | {"betas": dict(zip(features, map(float, fitted.coefficients))), "intercept": float(fitted.intercept)}


def _newton_sums(rows: DataFrame, betas: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of k + 1 models in one pass over (fold, y, w, x): model f leaves fold f out, the last none."""
    models, p = betas.shape

    def task(batches):
        g, h = np.zeros((models, p)), np.zeros((models, p, p))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.ones(len(pdf)), np.array(pdf["x"].tolist())])
            y, w, fold = pdf["y"].to_numpy(float), pdf["w"].to_numpy(float), pdf["fold"].to_numpy()
            prob = 1 / (1 + np.exp(-np.clip(x @ betas.T, -500, 500)))
            for m in range(models):
                own = w * (fold != m)
                g[m] += x.T @ (own * (prob[:, m] - y))
                h[m] += (x * (own * prob[:, m] * (1 - prob[:, m]))[:, None]).T @ x
        yield pd.DataFrame({"at": np.arange(models * p * (p + 1)), "v": np.concatenate([g.ravel(), h.ravel()])})

    out = np.zeros(models * p * (p + 1))
    for r in rows.mapInPandas(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # (k + 1) * p * (p + 1) rows
        out[r["at"]] = r["v"]
    return out[: models * p].reshape(models, p), out[models * p :].reshape(models, p, p)


def cross_validated(df: DataFrame, features: Sequence[str], target: str, cut: float, k: int = 5, penalty: float = 0.01, iterations: int = 100, tolerance: float = 1e-6, gene: str = "gene", seed: int = 42) -> tuple[dict, DataFrame, DataFrame]:
    """(model, held_out, thresholds): the logistic consensus with a threshold from cross-validation over whole genes.

    ``held_out`` has the rows without nulls with ``fold`` and ``probability``, by the model that never saw the row's genes;
    ``thresholds`` Youden's of each fold. The model is fitted on all rows, and its ``threshold`` is the mean of the folds' ones.
    All k + 1 fits go step by step together (Newton's method), so a step is one pass over the rows. Z-scores and the
    weight of negatives, positives over negatives, are those of all rows, as fit_logistic has them. A fold whose held-out
    rows have one class only has no threshold; without any the threshold is null.
    """
    rows = df.dropna(subset=[*features, target, gene])
    label = (F.col(target) >= cut).cast("double")
    n = rows.agg(F.sum(label).alias("p"), F.sum(1 - label).alias("n"), *[f(c).alias(f"{s}_{c}") for c in features for s, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if not n["p"] or not n["n"]:
        raise ValueError("both classes are needed")
    stats = {"means": {c: n[f"m_{c}"] for c in features}, "stds": {c: max(n[f"s_{c}"] or 0.0, 1e-9) for c in features}}
    negative = n["p"] / n["n"]
    given = folds(rows, gene, k, seed)
    narrow = given.select("fold", label.alias("y"), F.when(label == 1, 1.0).otherwise(negative).alias("w"), F.array(*[z_of(stats, c) for c in features]).alias("x")).persist()
    try:
        weight = {r["fold"]: r["w"] for r in narrow.groupBy("fold").agg(F.sum("w").alias("w")).collect()}
        total = sum(weight.values())
        share = np.array([*(max(total - weight.get(f, 0.0), 1e-12) for f in range(k)), total])
        ridge = np.diag([0.0, *[penalty] * len(features)])
        betas = np.zeros((k + 1, len(features) + 1))
        for _ in range(iterations):
            g, h = _newton_sums(narrow, betas, k)
            step = np.array([np.linalg.lstsq(h[m] / share[m] + ridge, g[m] / share[m] + ridge @ betas[m], rcond=None)[0] for m in range(k + 1)])
            betas = betas - step
            if np.abs(step).max() < tolerance:
                break
    finally:
        narrow.unpersist()
    own = lambda j: F.get(F.array(*[F.lit(float(b)) for b in betas[:k, j]]), F.col("fold"))
    score = sum((z_of(stats, c) * own(j + 1) for j, c in enumerate(features)), own(0))
    held_out = given.withColumn("probability", 1 / (1 + F.exp(-score)))
    thresholds = youden_threshold(held_out, "probability", F.col(target) >= cut)
    mean = thresholds.agg(F.avg("threshold")).first()[0]
    model = stats | {"betas": dict(zip(features, map(float, betas[k, 1:]))), "intercept": float(betas[k, 0]), "threshold": mean}
    return model, held_out, thresholds


def apply_logistic(df: DataFrame, model: Mapping, name: str = "consensus", legacy: bool = False) -> DataFrame:
    """Sigmoid of the weighted z-scores; ``legacy`` leaves the intercept out. Null where a feature is."""
    total = sum((z_of(model, c) * float(b) for c, b in model["betas"].items()), F.lit(0.0 if legacy else float(model["intercept"])))
    return df.withColumn(name, 1 / (1 + F.exp(-total)))


def youden_threshold(df: DataFrame, probability: str, label: Column, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Per key the threshold of 0.01 to 0.99 with the greatest TPR - FPR, the largest on ties; one-class keys are left out."""
    rows = df.where(F.col(probability).isNotNull()).withColumn("_y", label)
    counts = rows.groupBy(*keys, F.least(F.floor(F.round(F.col(probability) * 100, 9)), F.lit(99)).cast("int").alias("_b")).agg(F.sum(F.col("_y").cast("int")).alias("_p"), F.sum((~F.col("_y")).cast("int")).alias("_n"))
    packed = counts.groupBy(*keys).agg(F.collect_list(F.struct("_b", "_p", "_n")).alias("_c"), F.sum("_p").alias("_ap"), F.sum("_n").alias("_an")).where("_ap > 0 and _an > 0")  # 100 entries at most
    grid = packed.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(99))))
    above = lambda k: F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + F.when(c["_b"] >= F.col("_t"), c[k]).otherwise(0))
    j = grid.select(*keys, (F.col("_t") / 100).alias("threshold"), (above("_p") / F.col("_ap") - above("_n") / F.col("_an")).alias("youden"))
    return j.groupBy(*keys).agg(F.max(F.struct(F.round("youden", 12).alias("y"), "threshold")).alias("m")).select(*keys, "m.threshold", F.col("m.y").alias("youden"))


def positive_log_likelihood(df: DataFrame, probability: str, label: Column, threshold: float) -> DataFrame:
    p = F.when(F.col(probability) >= threshold, F.col(probability)).otherwise(1 - F.col(probability))
    return df.where(label).agg(F.sum(F.ln(F.greatest(p, F.lit(1e-12)))).alias("log_likelihood"))


SCHEMA = T.StructType([T.StructField(k, T.MapType(T.StringType(), T.DoubleType())) for k in ("weights", "betas", "means", "stds")] + [T.StructField(k, T.DoubleType()) for k in ("intercept", "threshold")])


def save_model(spark, model: Mapping, path: str) -> None:
    spark.createDataFrame([{f.name: model.get(f.name) for f in SCHEMA.fields}], SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load_model(spark, path: str) -> dict:
    row = spark.read.schema(SCHEMA).json(path).first()
    if row is None:
        raise ValueError(f"no model at {path}")
    return {k: v for k, v in row.asDict().items() if v is not None}
