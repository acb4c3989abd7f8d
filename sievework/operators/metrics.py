"""Evaluation of scoring tools: curves, thresholds, confusion, correlation.

``long`` is a table with columns tool and score and whatever else a function names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievework.operators import columns as C
from sievework.operators.prefix import running_sums


def r6(column) -> Column:
    return F.round(column, 6)


def steps(long: DataFrame, positive: Column, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Keys, score, p, n: positives and negatives at each distinct score; null scores and labels are left out."""
    rows = long.where(F.col("score").isNotNull() & positive.isNotNull())
    return rows.groupBy(*keys, "score").agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))


def roc_points(long: DataFrame, positive: Column, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Keys, threshold, tpr, fpr, precision: one point for each distinct score, ties taken together."""
    s = steps(long, positive, keys)
    whole = s.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    c = running_sums(s, keys, "score", ["p", "n"], few=True).join(F.broadcast(whole), list(keys))
    return c.select(
        *keys, F.col("score").alias("threshold"), "p", (F.col("cum_p") / F.nullif("pos", F.lit(0))).alias("tpr"), (F.col("cum_n") / F.nullif("neg", F.lit(0))).alias("fpr"),
        (F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))).alias("precision"), "pos", "neg",
    )


def auc(long: DataFrame, positive: Column, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Keys, auc, pos, neg: the area under the ROC curve with ties at half; null where a class is missing."""
    s = running_sums(steps(long, positive, keys), keys, "score", ["n"], descending=False, few=True)
    part = F.col("p") * (F.col("cum_n") - F.col("n") / 2)
    a = s.groupBy(*keys).agg(F.sum(part).alias("a"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return a.select(*keys, (F.col("a") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auc"), "pos", "neg")


def at_cutoffs(long: DataFrame, cutoffs: list[float], efficacy: str = "efficacy") -> DataFrame:
    """Each row once for each cutoff of a short list, with the cutoff and whether the row is good at it."""
    return long.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))).withColumn("good", F.col(efficacy) >= F.col("cutoff"))


def average_precision(long: DataFrame, positive: Column) -> DataFrame:
    """Sum over the distinct scores of the recall gained times the precision there."""
    p = roc_points(long, positive)
    return p.groupBy("tool").agg(F.sum(F.col("p") / F.col("pos") * F.col("precision")).alias("average_precision"))


def threshold_counts(long: DataFrame, kind: Column, n_steps: int) -> DataFrame:
    """tool, threshold and the rows of each kind (Good, Moderate, Poor) with a score at or above it.

    Thresholds are ``n_steps`` even steps from the least to the greatest score. A score goes to the last step it
    reaches; the step found by division is set right against the thresholds as they are, so the counts equal a
    direct comparison. What follows are sums over ``n_steps`` rows for each tool.
    """
    rows = long.withColumn("kind", kind).where(F.col("score").isNotNull() & F.col("kind").isNotNull())
    ends = long.groupBy("tool").agg(F.min("score").alias("low"), F.max("score").alias("high"))

    def threshold(i):
        return F.when(i >= n_steps - 1, F.col("high")).otherwise(F.col("low") + i * (F.col("high") - F.col("low")) / (n_steps - 1))

    guess = F.when(F.col("high") > F.col("low"), F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * (n_steps - 1))).otherwise(F.lit(n_steps - 1))
    located = rows.join(F.broadcast(ends), "tool").withColumn("i", F.least(F.greatest(guess, F.lit(0)), F.lit(n_steps - 1)))
    located = located.withColumn("i", F.when(F.col("score") < threshold(F.col("i")), F.col("i") - 1).when((F.col("i") < n_steps - 1) & (F.col("score") >= threshold(F.col("i") + 1)), F.col("i") + 1).otherwise(F.col("i")))
    kinds = ("Good", "Moderate", "Poor")
    counts = located.groupBy("tool", "i").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    grid = ends.select("tool", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("i")).select("tool", "i", threshold(F.col("i")).alias("threshold"))
    above = W.Window.partitionBy("tool").orderBy(F.col("i").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    return grid.join(counts, ["tool", "i"], "left").select("tool", "i", "threshold", *[F.sum(F.coalesce(k, F.lit(0))).over(above).alias(k) for k in kinds])


def rates(c: DataFrame, totals: DataFrame, good: tuple[str, ...] = ("Good",)) -> DataFrame:
    """TP, FN, FP, TN and what follows from them for counts above a threshold and class totals."""
    rest = tuple(k for k in ("Good", "Moderate", "Poor") if k not in good)
    add = lambda names, pre="": sum((F.col(pre + k) for k in names), F.lit(0))
    x = c.crossJoin(F.broadcast(totals.select(*[F.col(k).alias(f"all_{k}") for k in ("Good", "Moderate", "Poor")])))
    x = x.withColumns({"tp": add(good), "fn": add(good, "all_") - add(good), "fp": add(rest), "tn": add(rest, "all_") - add(rest)})
    x = x.withColumns({"tpr": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), "specificity": F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0))})
    fpr = 1 - F.col("specificity")
    return x.withColumns({"youden": F.col("tpr") + F.col("specificity") - 1, "lr_plus": F.when(F.col("fp") == 0, F.lit(float("inf"))).otherwise(F.col("tpr") / F.nullif(fpr, F.lit(0.0)))})


def class_totals(df: DataFrame, kind: Column) -> DataFrame:
    """One row with the number of Good, Moderate and Poor rows, scored or not."""
    return df.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("Good", "Moderate", "Poor")])


def best_threshold(long: DataFrame, kind: Column, totals: DataFrame, n_steps: int = 500) -> DataFrame:
    """Per tool the threshold with the greatest min(TPR, specificity) for Good against the rest, the lowest on ties."""
    r = rates(threshold_counts(long, kind, n_steps), totals)
    return r.withColumn("k", F.row_number().over(W.Window.partitionBy("tool").orderBy(F.least("tpr", "specificity").desc(), "i"))).where("k = 1").drop("k", "i")


def both_comparisons(best: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows of best_threshold, for Good against the rest and, at the same threshold, for Good and Moderate against Poor."""
    counts = best.select("tool", "threshold", "Good", "Moderate", "Poor")
    one = rates(counts, totals).withColumn("comparison", F.lit("good_vs_rest"))
    return one.unionByName(rates(counts, totals, ("Good", "Moderate")).withColumn("comparison", F.lit("not_poor_vs_poor")))


def at_thresholds(long: DataFrame, thresholds: DataFrame, kind: Column, totals: DataFrame, good: tuple[str, ...] = ("Good",)) -> DataFrame:
    """The same rates at given (tool, threshold)."""
    rows = long.withColumn("kind", kind).join(F.broadcast(thresholds), "tool").where(F.col("score") >= F.col("threshold"))
    c = rows.groupBy("tool", "threshold").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("Good", "Moderate", "Poor")])
    return rates(c, totals, good)


def best_f1(long: DataFrame, kind: Column, totals: DataFrame, n_steps: int = 100) -> DataFrame:
    r = rates(threshold_counts(long, kind, n_steps), totals)
    r = r.withColumns({"precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": F.col("tpr")})
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    r = r.withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    return r.withColumn("k", F.row_number().over(W.Window.partitionBy("tool").orderBy(F.round("f1", 12).desc(), "i"))).where("k = 1").select("tool", "threshold", "precision", "recall", "f1")


def confusion(df: DataFrame, true: Column, predicted: Column, keys: tuple[str, ...] = ("tool",)) -> DataFrame:
    """keys, true_class, predicted, n and the share of the true class in percent."""
    c = df.select(*keys, true.alias("true_class"), predicted.alias("predicted")).dropna().groupBy(*keys, "true_class", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("percent", F.col("n") * 100 / F.sum("n").over(W.Window.partitionBy(*keys, "true_class")))


def class_bins(guides: DataFrame) -> DataFrame:
    """Bins of two points by class, with the share of the class."""
    c = guides.groupBy(C.even_bin(F.col("efficacy")).alias("bin"), C.three_classes(F.col("efficacy")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", r6(F.col("n") * 100 / F.sum("n").over(W.Window.partitionBy("class"))))


def with_average_ranks(df: DataFrame, keys: tuple[str, ...], column: str, name: str) -> DataFrame:
    """Average ranks among equal values, without a window over all rows: by counts of distinct values."""
    values = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(values, keys, column, ["_n"], descending=False, few=True)
    return df.join(ranked.select(*keys, column, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(name)), [*keys, column])


def pearson(long: DataFrame, against: str = "efficacy") -> DataFrame:
    return long.where(F.col("score").isNotNull() & F.col(against).isNotNull()).groupBy("tool").agg(F.corr("score", against).alias("pearson"), F.count(F.lit(1)).alias("n"))


def spearman(long: DataFrame, against: str = "efficacy") -> DataFrame:
    """Pearson's correlation of average ranks over the rows with both values. Equal pairs of values are counted, and only their
    counts are shuffled and ranked."""
    rows = long.where(F.col("score").isNotNull() & F.col(against).isNotNull())
    cells = rows.groupBy("tool", "score", against).agg(F.count(F.lit(1)).alias("_m"))

    def ranks(column: str) -> DataFrame:
        values = running_sums(cells.groupBy("tool", column).agg(F.sum("_m").alias("_n")), ("tool",), column, ["_n"], descending=False, few=True)
        return values.select("tool", column, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(f"_rank_{column}"))

    one = cells.groupBy("tool").agg(F.sum("_m").alias("n"))
    ranked = cells.join(ranks("score"), ["tool", "score"]).join(ranks(against), ["tool", against]).join(F.broadcast(one), "tool")
    x, y = (F.col(f"_rank_{c}") - (F.col("n") + 1) / 2 for c in ("score", against))  # average ranks have this mean
    product = lambda a, b: F.sum(F.col("_m") * a * b)
    rho = product(x, y) / F.nullif(F.sqrt(product(x, x) * product(y, y)), F.lit(0.0))
    return ranked.groupBy("tool", "n").agg(rho.alias("spearman")).select("tool", "spearman", "n")


#: Levels of Kendall's count whose blocks are cut into buckets: the first has two halves, the last 2**TOP_LEVELS.
TOP_LEVELS = 6


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of one pair of columns.

    Pairs in order are counted level by level: at each bit of the dense rank of x, pairs that part there lie in one
    block and in its two halves, and a running count over y within the block finds those in order. A row takes
    part once for each bit, which is one shuffle; no pairs are made.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    xs = running_sums(cells.groupBy("x").agg(F.lit(1).alias("one"), F.lit(0).alias("k")), ("k",), "x", ["one"], descending=False, few=True).select("x", (F.col("cum_one") - 1).cast("long").alias("rank"))
    cells = cells.join(xs, "x")
    bits = max(1, (xs.agg(F.max("rank")).first()[0] or 0).bit_length())
    half = F.expr("shiftright(rank, level) & 1")
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).select("level", F.expr("shiftright(rank, level + 1)").alias("block"), "y", F.when(half == 0, F.col("n")).otherwise(0).alias("left"), F.when(half == 1, F.col("n")).otherwise(0).alias("right"))
    keys = ("level", "block")
    levels = levels.groupBy(*keys, "y").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    # At the top levels a block has much of the table: running sums in buckets. Below, a block is a window.
    top = bits - TOP_LEVELS
    low = levels.where(F.col("level") < top).withColumn("cum_left", F.sum("left").over(W.Window.partitionBy(*keys).orderBy("y").rowsBetween(W.Window.unboundedPreceding, 0)))
    high = running_sums(levels.where(F.col("level") >= top), keys, "y", ["left"], descending=False, few=True).select(*low.columns)
    both = low.unionByName(high).join(levels.groupBy(*keys).agg(F.sum("left").alias("whole")), [*keys])
    right = F.col("right").cast("double")
    found = both.agg(F.sum(right * (F.col("cum_left") - F.col("left"))).alias("c"), F.sum(right * (F.col("whole") - F.col("cum_left"))).alias("d"))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    tx = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).agg(pairs("n").alias("tx"), F.sum("n").cast("double").alias("total"))
    ty = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(pairs("n").alias("ty"))
    one = found.crossJoin(tx).crossJoin(ty).withColumn("all", F.col("total") * (F.col("total") - 1) / 2)
    return one.select(((F.col("c") - F.col("d")) / F.nullif(F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty"))), F.lit(0.0))).alias("tau_b"), F.col("total").cast("long").alias("n"))


def tool_correlations(wide: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """(tool_a, tool_b, n, pearson, spearman) for each two tool columns in either order, over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(tools) for b in tools[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("tool_a"), F.lit(b).alias("tool_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    rows = wide.select(each.alias("p")).select("p.*").where("x is not null and y is not null")
    keys = ("tool_a", "tool_b")
    spread = F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))  # null, not an error, where a tool never varies
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("x", "y") / spread).alias("pearson"))
    cells = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("m"))  # equal pairs of values are counted, and only their counts are ranked

    def ranks(column: str) -> DataFrame:
        values = running_sums(cells.groupBy(*keys, column).agg(F.sum("m").alias("_n")), keys, column, ["_n"], descending=False, few=True)
        return values.select(*keys, column, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(f"_{column}"))

    ranked = cells.join(ranks("x"), [*keys, "x"]).join(ranks("y"), [*keys, "y"]).join(F.broadcast(one), list(keys))
    off = {c: F.col(f"_{c}") - (F.col("n") + 1) / 2 for c in "xy"}  # average ranks have this mean
    product = lambda a, b: F.sum(F.col("m") * off[a] * off[b])
    rho = product("x", "y") / F.nullif(F.sqrt(product("x", "x") * product("y", "y")), F.lit(0.0))
    found = ranked.groupBy(*keys, "n", "pearson").agg(rho.alias("spearman"))
    both = F.explode(F.array(F.struct("tool_a", "tool_b"), F.struct(F.col("tool_b").alias("tool_a"), F.col("tool_a").alias("tool_b"))))
    return found.select(both.alias("p"), "n", "pearson", "spearman").select("p.tool_a", "p.tool_b", "n", "pearson", "spearman")


def kendall_within(rows: DataFrame, keys: tuple[str, ...], x: str = "score", y: str = "efficacy") -> DataFrame:
    """keys and tau_b among the rows of each group: the counts of ``kendall``, level by level, in windows of the groups."""
    rows = rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    cells = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    by = W.Window.partitionBy(*keys)
    # Pairs with an equal y and x are summed over cells: what has the same value, less one, times a half.
    tied = lambda c: F.col("n").cast("double") * (F.sum("n").over(W.Window.partitionBy(*keys, c)) - 1) / 2
    cells = cells.withColumn("ty", tied("y")).withColumns({"tx": tied("x"), "rank": F.dense_rank().over(by.orderBy("x")) - 1, "m": F.sum("n").over(by)})
    bits = F.greatest(F.ceil(F.log2(F.max("rank").over(by) + 1)), F.lit(1)).cast("int")
    levels = cells.withColumn("bits", bits).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    levels = levels.withColumns({"block": F.expr("shiftright(rank, level + 1)"), "half": F.expr("shiftright(rank, level) & 1")})
    levels = levels.withColumn("left", F.when(F.col("half") == 0, F.col("n")).otherwise(0))
    block = W.Window.partitionBy(*keys, "level", "block")
    lower = F.coalesce(F.sum("left").over(block.orderBy("y").rangeBetween(W.Window.unboundedPreceding, 0)), F.lit(0))
    levels = levels.withColumns({"upto": lower, "equal": F.sum("left").over(W.Window.partitionBy(*keys, "level", "block", "y")), "whole": F.sum("left").over(block)})
    right = F.when(F.col("half") == 1, F.col("n").cast("double")).otherwise(0.0)
    once = lambda c: F.sum(F.when(F.col("level") == 0, F.col(c)).otherwise(0.0)).alias(c)
    one = levels.groupBy(*keys).agg(F.sum(right * (F.col("upto") - F.col("equal"))).alias("c"), F.sum(right * (F.col("whole") - F.col("upto"))).alias("d"), once("tx"), once("ty"), F.max("m").cast("double").alias("m"))
    one = one.withColumn("all", F.col("m") * (F.col("m") - 1) / 2)
    return one.select(*keys, ((F.col("c") - F.col("d")) / F.nullif(F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty"))), F.lit(0.0))).alias("tau_b"))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t: the regularised incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t^2).

    By the continued fraction of Lentz, for whole arrays at once.
    """
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    turned = x >= (a + 1) / (a + b + 2)  # there the fraction of the other side converges fast
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    ln_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return np.where(turned, 1 - front * h, front * h)


def spearman_p(correlations: DataFrame, rho: str = "spearman") -> DataFrame:
    """Adds the two-sided p of (rho, n) by Student's t with n - 2 degrees of freedom; null for n < 3, 0 for rho of 1 or -1."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_tail(t.to_numpy(), df.to_numpy()))

    df = (F.col("n") - 2).cast("double")
    t = F.col(rho) * F.sqrt(df / F.nullif(1 - F.col(rho) * F.col(rho), F.lit(0.0)))
    safe = F.when((F.col("n") > 2) & t.isNotNull(), t).otherwise(0.0)
    p = F.when(F.col("n") > 2, F.when(t.isNull() & F.col(rho).isNotNull(), 0.0).when(F.col(rho).isNotNull(), tail(safe, F.greatest(df, F.lit(1.0)))))
    return correlations.withColumn("p", p)


def poor_detection(long: DataFrame, poor: Column) -> DataFrame:
    """Predicted poor: score at or below the quantile (linear) at the true share of poor rows; rates of that."""
    rows = long.withColumn("poor", poor).where("score is not null and poor is not null")
    share = rows.groupBy("tool").agg(F.avg(F.col("poor").cast("int")).alias("share"), F.array_sort(F.collect_set("poor")).alias("_"))
    cells = running_sums(rows.groupBy("tool", "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("poor").cast("long")).alias("p")), ("tool",), "score", ["n"], descending=False, few=True)
    whole = cells.groupBy("tool").agg(F.sum("n").alias("rows"), F.sum("p").alias("pos"))
    at = cells.join(F.broadcast(share.drop("_")), "tool").join(F.broadcast(whole), "tool").withColumn("place", F.col("share") * (F.col("rows") - 1))
    low = at.where(F.col("cum_n") > F.floor("place")).groupBy("tool").agg(F.min("score").alias("low"))
    high = at.where(F.col("cum_n") > F.ceil("place")).groupBy("tool").agg(F.min("score").alias("high"))
    place = at.groupBy("tool").agg(F.first("place").alias("place"))
    threshold = low.join(high, "tool").join(place, "tool").select("tool", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("threshold"))
    hit = at.join(F.broadcast(threshold), "tool").where(F.col("score") <= F.col("threshold") + 1e-12)
    c = hit.groupBy("tool", "threshold", "rows", "pos").agg(F.sum("n").alias("called"), F.sum("p").alias("tp"))
    c = c.withColumns({"precision": F.col("tp") / F.col("called"), "recall": F.col("tp") / F.nullif("pos", F.lit(0)), "accuracy": (F.col("rows") - F.col("called") - F.col("pos") + 2 * F.col("tp")) / F.col("rows")})
    return c.select("tool", "threshold", "precision", "recall", (2 * F.col("tp") / (F.col("called") + F.col("pos"))).alias("f1"), "accuracy")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval; 0 and 0 without trials."""
    p = successes / F.nullif(n, F.lit(0))
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda v: F.when(n > 0, v / (1 + z * z / n)).otherwise(0.0)
    return bound(centre - spread), bound(centre + spread)
