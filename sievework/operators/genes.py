"""Within-gene evaluation and balancing of guide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievework.operators import metrics as M


def drop_one_class_genes(df: DataFrame, gene: str = "gene", bucket: str = "bucket") -> DataFrame:
    """Keep the genes with more than one class."""
    kept = df.groupBy(gene).agg(F.count_distinct(bucket).alias("_n")).where("_n > 1").select(gene)
    return df.join(kept, gene, "left_semi")


def gap_genes(df: DataFrame, gap: float, efficacy: str = "efficacy", bucket: str = "bucket") -> DataFrame:
    """(gene, max_good, min_poor) of genes with both classes whose best good lies more than ``gap`` above the worst poor."""
    good, poor = F.when(F.col(bucket) == "good", F.col(efficacy)), F.when(F.col(bucket) != "good", F.col(efficacy))
    g = df.groupBy("gene").agg(F.max(good).alias("max_good"), F.min(poor).alias("min_poor"))
    return g.where(F.col("max_good") - F.col("min_poor") > gap)


def class_counts(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Per gene: rows, rows in the margin, good, poor and the margin's share."""
    n = lambda k: F.count_if(F.col(bucket) == k)
    g = df.groupBy("gene").agg(F.count(F.lit(1)).alias("total"), n("ignore").alias("margin"), n("good").alias("good"), n("poor").alias("poor"))
    return g.withColumn("margin_share", F.col("margin") / F.col("total"))


def smallest_class(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest"))


def seeded(column: str, seed: int) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(column)))


def balanced_sample(df: DataFrame, seed: int = 42, gene: str = "gene", bucket: str = "bucket", key: str = "guide_id") -> DataFrame:
    """Within each gene as many rows of either class as the smaller one has; genes with one class give none."""
    sizes = df.groupBy(gene, bucket).agg(F.count(F.lit(1)).alias("_n")).groupBy(gene).agg(F.min("_n").alias("_k"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    rank = F.row_number().over(W.Window.partitionBy(gene, bucket).orderBy(seeded(key, seed), key))
    return df.join(sizes, gene).withColumn("_r", rank).where("_r <= _k").drop("_k", "_c", "_r")


def undersampled(df: DataFrame, seed: int = 42, bucket: str = "bucket", key: str = "guide_id") -> DataFrame:
    """As many rows of each class as the smallest has. The cut is found over ranges of the hash, not by one long sort."""
    hashed = df.withColumn("_h", seeded(key, seed)).withColumn("_cell", F.substring("_h", 1, 3))
    cells = hashed.groupBy(bucket, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    least = cells.groupBy(bucket).agg(F.sum("_n").alias("n")).agg(F.min("n").alias("_k"))
    before = W.Window.partitionBy(bucket).orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, -1)
    ahead = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.Window.partitionBy(bucket, "_cell").orderBy("_h", key))
    placed = hashed.join(F.broadcast(ahead), [bucket, "_cell"]).crossJoin(F.broadcast(least)).where("_before < _k")
    return placed.withColumn("_r", rank + F.col("_before")).where("_r <= _k").drop("_h", "_cell", "_before", "_k", "_r")


def six_to_four(df: DataFrame, seed: int = 42, bucket: str = "bucket", key: str = "guide_id") -> DataFrame:
    """Two good and two poor rows of each gene with the shapes 3/3, 4/2 or 2/4; other genes give none."""
    good, poor = F.count_if(F.col(bucket) == "good"), F.count_if(F.col(bucket) == "poor")
    shapes = df.groupBy("gene").agg(good.alias("_g"), poor.alias("_p")).where("(_g = 3 and _p = 3) or (_g = 4 and _p = 2) or (_g = 2 and _p = 4)").select("gene")
    rank = F.row_number().over(W.Window.partitionBy("gene", bucket).orderBy(seeded(key, seed), key))
    return df.where(F.col(bucket).isin("good", "poor")).join(shapes, "gene", "left_semi").withColumn("_r", rank).where("_r <= 2").drop("_r")


def kept_status(df: DataFrame, kept: DataFrame, gene: str = "gene") -> DataFrame:
    """Per gene the rows before and after a selection, and whether it was kept."""
    before, after = df.groupBy(gene).agg(F.count(F.lit(1)).alias("before")), kept.groupBy(gene).agg(F.count(F.lit(1)).alias("after"))
    joined = before.join(after, gene, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("after") > 0, "kept").otherwise("dropped"))


def bad_counts(df: DataFrame, bad: Column) -> DataFrame:
    """Per gene the guides and the bad ones."""
    return df.groupBy("gene").agg(F.count(F.lit(1)).alias("total"), F.sum(bad.cast("long")).alias("bad"))


def one_bad_of(df: DataFrame, bad: Column, total: int = 4) -> DataFrame:
    """The guides of genes with ``total`` guides of which exactly one is bad."""
    genes = bad_counts(df, bad).where((F.col("total") == total) & (F.col("bad") == 1)).select("gene")
    return df.join(genes, "gene", "left_semi")


def lowest_scored(long: DataFrame) -> DataFrame:
    """Per tool and gene the row with the lowest score; a null score is the lowest."""
    rank = F.row_number().over(W.Window.partitionBy("tool", "gene").orderBy(F.col("score").asc_nulls_first(), "guide_id"))
    return long.withColumn("_r", rank).where("_r = 1").drop("_r")


def _ends(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows with what top_and_bottom orders by, and its columns for a group of a tool and a gene."""
    rows = rows.withColumns({"_both": F.col("score").isNotNull() & F.col("efficacy").isNotNull(), "_back": F.translate("guide_id", "0123456789abcdef", "fedcba9876543210")})
    by = lambda k, tie: F.when(F.col("_both"), F.struct(F.col(k), F.col(tie)))
    top = [F.max_by("guide_id", by(k, "_back")).alias(f"top_{k}") for k in ("score", "efficacy")]
    bottom = [F.min_by("guide_id", by(k, "guide_id")).alias(f"bottom_{k}") for k in ("score", "efficacy")]
    return rows, [*top, *bottom, F.count_if("_both").alias("n")]


def top_and_bottom(long: DataFrame) -> DataFrame:
    """Per tool and gene the best and the worst guide by score and by efficacy; nulls are skipped, ties to the smaller id.

    Like all that follows by tool and gene: rows that lie together by gene (columns.to_long) are not shuffled again.
    """
    rows, ends = _ends(long)
    return rows.groupBy("tool", "gene").agg(*ends).where("n > 0")


def problem_guides(long: DataFrame, bad: Column) -> DataFrame:
    """Per tool: bad guides, those that do not have their gene's lowest score, and their share."""
    low = F.min("score").over(W.Window.partitionBy("tool", "gene"))
    rows = long.withColumns({"_low": low, "_bad": bad}).where("_bad")
    c = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("bad"), F.count_if(F.col("score") > F.col("_low")).alias("problems"))
    return c.withColumn("failed_share", F.col("problems") / F.col("bad"))


def ranks_within(df: DataFrame, keys: tuple[str, ...], column: str, name: str, descending: bool = True) -> DataFrame:
    """Average ranks within small groups."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    ties = F.count(F.lit(1)).over(W.Window.partitionBy(*keys, column))
    return df.withColumn(name, F.rank().over(W.Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2)


def _fit(long: DataFrame, least: int) -> DataFrame:
    """Adds ``_fit``: whether the row's tool and gene have enough guides, two distinct values on either side, and no null."""
    of = lambda f, c: f(c).over(W.Window.partitionBy("tool", "gene"))
    n = of(F.count, F.lit(1))
    whole = (of(F.count, "score") == n) & (of(F.count, "efficacy") == n)
    return long.withColumn("_fit", (n >= least) & F.coalesce(whole & (of(F.min, "score") < of(F.max, "score")) & (of(F.min, "efficacy") < of(F.max, "efficacy")), F.lit(False)))


def _ranked_within(long: DataFrame, least: int) -> tuple[DataFrame, list[Column]]:
    """Rows with average ranks within tool and gene, the mean of a value's first and last place, and the columns ``spearman`` and
    ``fit`` of a group; groups that don't fit have no correlation."""
    by = W.Window.partitionBy("tool", "gene")
    place = lambda c: (F.rank().over(by.orderBy(c)) + F.count(F.lit(1)).over(by.orderBy(c).rangeBetween(W.Window.unboundedPreceding, 0))) / 2
    rows = _fit(long.withColumn("_x", place("score")), least).withColumn("_y", place("efficacy"))
    return rows, [F.corr(F.when(F.col("_fit"), F.col("_x")), "_y").alias("spearman"), F.bool_or("_fit").alias("fit")]


def spearman_within(long: DataFrame, least: int = 3) -> DataFrame:
    """(tool, gene, n, spearman) of genes with enough guides and two distinct values on either side, none of them null."""
    rows, found = _ranked_within(long, least)
    return rows.where("_fit").groupBy("tool", "gene").agg(F.count(F.lit(1)).alias("n"), *found).drop("fit")


def agreement_within(long: DataFrame, least: int = 3) -> DataFrame:
    """Per tool over the genes of spearman_within: mean Spearman, mean Kendall tau-b, share of genes with the same best and
    the same worst guide by score and by efficacy. Kendall's tau is a pass of its own, which meets the other in a row a tool."""
    placed, found = _ranked_within(long, least)
    rows, ends = _ends(placed.where("_fit"))
    same = lambda x: F.avg((F.col(f"{x}_score") == F.col(f"{x}_efficacy")).cast("int"))
    one = rows.groupBy("tool", "gene").agg(*ends, *found).groupBy("tool").agg(F.count(F.lit(1)).alias("genes"), F.avg("spearman").alias("mean_spearman"), same("top").alias("best_agreement"), same("bottom").alias("worst_agreement"))
    tau = M.kendall_within(_fit(long, least).where("_fit"), ("tool", "gene")).groupBy("tool").agg(F.avg("tau_b").alias("mean_kendall"))
    return one.join(tau, "tool").select("tool", "genes", "mean_spearman", "mean_kendall", "best_agreement", "worst_agreement")


def within_gene_ranking(long: DataFrame, least: float = 0.5) -> DataFrame:
    """Per tool over genes of several guides: shares with the same top, the same bottom and a Spearman above ``least``."""
    placed, found = _ranked_within(long, 2)
    rows, ends = _ends(placed)
    same = lambda x: F.avg((F.col(f"{x}_score") == F.col(f"{x}_efficacy")).cast("int"))
    a = rows.groupBy("tool", "gene").agg(*ends, *found).where("n > 1").groupBy("tool").agg(
        F.count(F.lit(1)).alias("genes"), same("top").alias("top_agreement"), same("bottom").alias("bottom_agreement"), F.count_if(F.col("fit") & (F.round("spearman", 9) > least)).alias("_high")
    )
    return a.select("tool", "genes", "top_agreement", "bottom_agreement", (F.col("_high") / F.col("genes")).alias("high_spearman_share"))


def strict_auroc(long: DataFrame, positive: Column) -> DataFrame:
    """(tool, gene, guides, auroc): share of pairs in which the positive is strictly above; null without both classes.

    By counts at each distinct score of a gene and a running sum over them, not by pairs.
    """
    s = M.steps(long, positive, ("tool", "gene"))
    below = F.sum("n").over(W.Window.partitionBy("tool", "gene").orderBy("score").rowsBetween(W.Window.unboundedPreceding, -1))
    s = s.withColumn("_w", F.col("p") * F.coalesce(below, F.lit(0)))
    g = s.groupBy("tool", "gene").agg(F.sum("_w").alias("w"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return g.select("tool", "gene", (F.col("pos") + F.col("neg")).alias("guides"), (F.col("w") / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))).alias("auroc"))


def integrity_offenders(df: DataFrame, allowed: tuple[int, ...] = (2, 4, 6), bucket: str = "bucket") -> DataFrame:
    """Genes whose number of guides is not allowed, or whose classes are not of equal size."""
    g = df.groupBy("gene").agg(F.count(F.lit(1)).alias("guides"), F.count_if(F.col(bucket) == "good").alias("good"))
    return g.where(~F.col("guides").isin(*allowed) | (F.col("good") * 2 != F.col("guides")))


def bad_guide_detection(long: DataFrame, bad: Column, z: float = 1.96) -> DataFrame:
    """Per tool: genes, those whose lowest-scored guide is bad, rate, Wilson interval and standard error."""
    c = lowest_scored(long.withColumn("_bad", bad)).groupBy("tool").agg(F.count(F.lit(1)).alias("genes"), F.sum(F.col("_bad").cast("long")).alias("found"))
    low, high = M.wilson(F.col("found"), F.col("genes"), z)
    rate = F.col("found") / F.col("genes")
    return c.withColumns({"rate": rate, "low": low, "high": high, "standard_error": F.sqrt(rate * (1 - rate) / F.col("genes"))})


def guides_per_gene(df: DataFrame) -> DataFrame:
    return df.groupBy("gene").agg(F.count(F.lit(1)).alias("guides")).groupBy("guides").agg(F.count(F.lit(1)).alias("genes"))


def two_proportions(rates: DataFrame, best: int = 3) -> DataFrame:
    """z of each pair among the tools with the best rates (found of genes), the better one first."""
    top = rates.orderBy(F.col("rate").desc(), "tool").limit(best).select("tool", "found", "genes", "rate")
    a, b = (top.select(*[F.col(c).alias(f"{c}_{x}") for c in top.columns]) for x in "ab")
    ahead = (F.col("rate_a") > F.col("rate_b")) | ((F.col("rate_a") == F.col("rate_b")) & (F.col("tool_a") < F.col("tool_b")))
    pooled = (F.col("found_a") + F.col("found_b")) / (F.col("genes_a") + F.col("genes_b"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("genes_a") + 1 / F.col("genes_b")))
    z = (F.col("rate_a") - F.col("rate_b")) / F.nullif(error, F.lit(0.0))
    stars = F.when(z > 3.290527, "***").when(z > 2.575829, "**").when(z > 1.959964, "*").otherwise("ns")
    return a.join(F.broadcast(b), ahead).select("tool_a", "tool_b", z.alias("z"), stars.alias("stars"))
