"""Column rules, filters and class buckets of a guide table (projections, predicates, bucketing)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

# --- projections ---------------------------------------------------------------------------------------------------


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are there."""
    return df.withColumnsRenamed(dict(names))


def cast_present(df: DataFrame, columns: Iterable[str], kind: str = "double") -> DataFrame:
    """Cast those of the columns that are there; values that do not parse become null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {kind})") for c in columns if c in df.columns})


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself; ValueError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def tool_columns(df: DataFrame, blocked_parts: Sequence[str] = (), blocked: Sequence[str] = ()) -> list[str]:
    """Numeric columns whose lower-cased names have none of ``blocked_parts`` and are not in ``blocked``."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in numeric if c not in blocked and not any(p in c.lower() for p in blocked_parts)]


def strip_parenthesised(column: Column) -> Column:
    """Without a trailing parenthesised suffix."""
    return F.regexp_replace(column, r"\s*\([^)]*\)$", "")


def split_alignment(column: Column) -> dict[str, Column]:
    """chromosome, position and strand of ``chr_pos_strand``."""
    parts = F.split(column, "_")
    return {"chromosome": F.get(parts, 0), "position": F.get(parts, 1).try_cast("long"), "strand": F.get(parts, 2)}


def split_first(column: Column, mark: str = "_") -> tuple[Column, Column]:
    """What stands before and after the first mark."""
    parts = F.split(column, mark, 2)
    return F.get(parts, 0), F.get(parts, 1)


def strand_window(position: Column, strand: Column) -> tuple[Column, Column]:
    """Start and end of the base before the cut: 16 and 15 upstream on the plus strand, else 5 and 4."""
    plus = strand == "+"
    return F.when(plus, position - 16).otherwise(position - 5), F.when(plus, position - 15).otherwise(position - 4)


def cut_site(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", start + 17).otherwise(end - 6)


def depletion_efficacy(effect: Column) -> Column:
    """A negative effect (down to -10) as 0 to 100; other effects 0."""
    return F.when(effect < 0, effect / -10 * 100).otherwise(F.lit(0.0))


def with_prefix(column: Column, prefix: str = "chr") -> Column:
    return F.when(column.startswith(prefix), column).otherwise(F.concat(F.lit(prefix), column))


def upper_sequences(df: DataFrame, parts: Sequence[str] = ("sgrna", "sequence", "pam")) -> DataFrame:
    """Upper-case every column whose name has one of the parts."""
    return df.withColumns({c: F.upper(c) for c in df.columns if any(p in c.lower() for p in parts)})


def row_key(df: DataFrame, columns: Sequence[str], name: str = "guide_id") -> DataFrame:
    """A stable key from the natural key, whatever the order of rows."""
    return df.withColumn(name, F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])))


def min_max_100(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale to 0..100 over the table; a constant column gives 0, null stays null."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    share = (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")) * 100
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(F.col("_high") > F.col("_low"), share).when(F.col(column).isNotNull(), 0.0)).drop("_low", "_high")


def z_scores(df: DataFrame, columns: Sequence[str], suffix: str = "_z", floor: float = 1e-9) -> DataFrame:
    """(x - mean) / standard deviation (n - 1), the latter at least ``floor``."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({c + suffix: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(floor)) for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def to_long(df: DataFrame, ids: Sequence[str], tools: Sequence[str], name: str = "tool", value: str = "score", together: str | None = None) -> DataFrame:
    """One row for each id and tool. With ``together``, rows of the same value of that column, which is in ``ids``, come into one
    task before they are multiplied: what groups by it and others needs no further shuffle."""
    if together is None:
        return df.unpivot(list(ids), list(tools), name, value)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias(name), F.col(t).alias(value)) for t in tools]))
    parts = len(tools) * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not joined by their size before rows are multiplied
    return df.select(*ids, *tools).repartition(parts, together).select(*ids, each.alias("_x")).select(*ids, f"_x.{name}", f"_x.{value}")


def to_wide(df: DataFrame, ids: Sequence[str], tools: Sequence[str], name: str = "tool", value: str = "score") -> DataFrame:
    """A column for each tool; of several values the least."""
    return df.groupBy(*ids).agg(*[F.min(F.when(F.col(name) == t, F.col(value))).alias(t) for t in tools])


# --- filters -------------------------------------------------------------------------------------------------------

#: The conditions that name a viability screen.
VIABILITY = ("viability", "viability after 36 days")


def viability_screens(df: DataFrame, condition: str = "condition", final: str = "rc_final") -> DataFrame:
    return df.where(F.col(condition).isin(*VIABILITY) & F.col(final).isNotNull())


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def without_margin(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    return df.where(F.col(bucket) != "ignore")


def groups_of_at_least(df: DataFrame, group: str, k: int) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(W.Window.partitionBy(group))).where(F.col("_n") >= k).drop("_n")


def within(column: Column, low: float, high: float) -> Column:
    return column.between(low, high)


def at_most(column: Column, most: int) -> Column:
    """Not above most; -1 takes everything."""
    return F.lit(True) if most == -1 else column <= most


def starts_with_dinucleotide(column: Column, pattern: str) -> Column:
    """The first two bases match a pattern in which N is any base."""
    options = [a + b for a in ("ACGT" if pattern[0] == "N" else pattern[0]) for b in ("ACGT" if pattern[1] == "N" else pattern[1])]
    return F.substring(column, 1, 2).isin(*options)


def tools_with_points(long: DataFrame, least: int = 10) -> DataFrame:
    """The tools with at least so many scored rows, with their number."""
    return long.where("score is not null").groupBy("tool").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# --- buckets -------------------------------------------------------------------------------------------------------


def two_classes(efficacy: Column, cutoff: float) -> Column:
    return F.when(efficacy >= cutoff, "good").otherwise("other")


def margin_classes(efficacy: Column, low: float, high: float) -> Column:
    """Below low poor, above high good, edges and nulls ignore."""
    return F.when(efficacy < low, "poor").when(efficacy > high, "good").otherwise("ignore")


def three_classes(efficacy: Column, poor: float = 60, good: float = 90) -> Column:
    return F.when(efficacy < poor, "Poor").when(efficacy >= good, "Good").when(efficacy.isNotNull(), "Moderate")


def three_bins(efficacy: Column, poor: float = 60, moderate: float = 90) -> Column:
    """Right-closed bins, which differ from three_classes at the edges."""
    return F.when(efficacy <= poor, "Poor").when(efficacy <= moderate, "Moderate").when(efficacy.isNotNull(), "Good")


#: The least efficacy of each named band.
BANDS = ((90.0, "Severe"), (70.0, "Strong"), (40.0, "Moderate"), (20.0, "Weak"))


def efficacy_band(efficacy: Column) -> Column:
    out = F.when(efficacy >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(efficacy >= least, name)
    return out.when(efficacy > 0, "Minimal").otherwise("None")


def decile(efficacy: Column) -> Column:
    return F.least(F.floor(efficacy / 10), F.lit(9)).cast("long")


def even_bin(efficacy: Column, width: float = 2.0, top: float = 100.0) -> Column:
    """Right-open bins of a width; the last one takes its end too."""
    return F.least(F.floor(efficacy / width) * width, F.lit(top - width)).cast("double")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) over the column's own range, the last bin closed; a constant column falls into the first bin."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
