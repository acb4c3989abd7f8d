"""Running sums over an order that is too long for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Buckets of a key: as many as the session has shuffle partitions, within these bounds.
LEAST_BUCKETS, MOST_BUCKETS = 64, 512


def sent_out(df: DataFrame, few: bool) -> DataFrame:
    """df, a row or a bucket's row for each key, marked for broadcast where the caller knows that there are few keys.

    Otherwise Spark decides by the size it finds at run time.
    """
    return F.broadcast(df) if few else df


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], descending: bool = True, few: bool = False) -> DataFrame:
    """Adds ``cum_<v>`` for each value: its sum over rows of the same keys up to this row and its equals in the order.

    Rows are cut into buckets by approximate quantiles of the order within the keys, summed within buckets, and each
    bucket gets the total of those before it. ``few`` says that there are few keys, which only the caller can know (names of columns, levels). The result does not depend on the number of buckets.
    """
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)]).alias("_cuts"))
    bucketed = df.join(sent_out(cuts, few), list(keys), "left").withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    by = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = W.Window.partitionBy(*keys).orderBy(by).rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = W.Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rangeBetween(W.Window.unboundedPreceding, 0)
    summed = bucketed.withColumns({f"_s_{v}": F.sum(v).over(inside) for v in values})
    joined = summed.join(sent_out(offsets, few), [*keys, "_bucket"])
    return joined.withColumns({f"cum_{v}": F.col(f"_s_{v}") + F.col(f"_o_{v}") for v in values}).drop("_bucket", *[f"_{k}_{v}" for v in values for k in "so"])


def medians(df: DataFrame, keys: Sequence[str], value: str, few: bool = False) -> DataFrame:
    """keys and ``median`` of the values that are not null: exact, from running counts over distinct values.

    The mean of the two middle values of an even number. No task holds all values of a key.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = cells.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at = running_sums(cells, keys, value, ["_n"], descending=False, few=few).join(sent_out(whole, few), list(keys))
    upper = lambda place: F.min(F.when(F.col("cum__n") >= place, F.col(value)))
    low, high = upper(F.floor((F.col("_all") + 1) / 2)), upper(F.ceil((F.col("_all") + 1) / 2))
    return at.groupBy(*keys).agg(((low + high) / 2).alias("median"))
