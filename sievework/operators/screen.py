"""From replicate counts to guide efficacy, and repair outcomes."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sievework.operators.prefix import running_sums, sent_out


def efficacy_from_lfc(lfc: Column) -> Column:
    """Piecewise linear: 0 for no depletion, up to 100; null stays null."""
    x = F.abs(lfc)
    return (
        F.when(lfc >= 0, 0.0)
        .when(x >= 3, 90 + 10 * F.least((x - 3) / 3, F.lit(1.0)))
        .when(x >= 2, 80 + 10 * (x - 2))
        .when(x >= 1, 60 + 20 * (x - 1))
        .when(x >= 0.585, 20 + 40 * (x - 0.585) / 0.415)
        .when(lfc.isNotNull(), 1 + 19 * x / 0.585)
    )


def first_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in a stated order."""
    return df.withColumn("_k", F.row_number().over(W.Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


#: Experiments up to which a table with a row for each of them is broadcast.
FEW_EXPERIMENTS = 10_000


def _few(long: DataFrame, experiment: str) -> bool:
    return long.select(experiment).distinct().limit(FEW_EXPERIMENTS + 1).count() <= FEW_EXPERIMENTS


def _by_guide(long: DataFrame, experiment: str) -> DataFrame:
    """A row a guide with its counts (sample, count) in a list, as many as it has samples: shuffled once for all that follows."""
    return long.groupBy(experiment, "guide_id").agg(F.array_sort(F.collect_list(F.struct("sample", "count"))).alias("counts"))


def _factors(guides: DataFrame, long: DataFrame, experiment: str, few: bool) -> DataFrame:
    need = long.groupBy(experiment).agg(F.count_distinct("sample").alias("need"))
    above = F.filter("counts", lambda c: c["count"] > 0)
    g = F.aggregate(above, F.lit(0.0), lambda a, c: a + F.ln(c["count"])) / F.size(above)
    whole = guides.join(sent_out(need, few), experiment).where((F.size(above) == F.col("need")) & (F.size(above) > 0))
    ratio = F.explode(F.transform("counts", lambda c: F.struct(c["sample"].alias("sample"), (c["count"] / F.exp("g")).alias("ratio"))))
    rows = whole.select(experiment, "counts", g.alias("g")).select(experiment, ratio.alias("x")).select(experiment, "x.*")
    return rows.groupBy(experiment, "sample").agg(F.percentile("ratio", 0.5).alias("factor"))


def size_factors(long: DataFrame, experiment: str = "experiment") -> DataFrame:
    """Per experiment and sample the median of count / geometric mean over guides with counts in all samples."""
    return _factors(_by_guide(long, experiment), long, experiment, _few(long, experiment))


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Probability of a standard normal value of z at most: a series near 0, a continued fraction beyond; NaN stays."""
    x = np.abs(z)
    near = np.minimum(x, 3.0)
    term = near.copy()
    total = near.copy()
    for k in range(1, 60):
        term = term * near * near / (2 * k + 1)
        total = total + term
    far = np.maximum(x, 3.0)
    tail = far.copy()
    for k in range(60, 0, -1):
        tail = far + k / tail
    with np.errstate(under="ignore"):
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        upper = np.where(x <= 3, 0.5 - total * density, density / tail)
    return np.where(z < 0, upper, 1 - upper)


def depletion(long: DataFrame, control: Sequence[str], treated: Sequence[str], experiment: str = "experiment") -> DataFrame:
    """experiment, guide_id, lfc, p, fdr for rows (experiment, guide_id, sample, count), all experiments in one job.

    Counts over size factors; lfc = log2 of mean ratio with 1 added; the variance of a guide is mean + exp(a) * mean^b,
    fitted over guides whose control variance exceeds the mean; one-sided normal tail; Benjamini-Hochberg within the
    experiment, by p-value ranks over buckets of p and a running minimum from above.
    """
    few, guides = _few(long, experiment), _by_guide(long, experiment)
    factors = _factors(guides, long, experiment, few).groupBy(experiment).agg(F.map_from_entries(F.collect_list(F.struct("sample", "factor"))).alias("factors"))
    of = lambda names: F.filter("counts", lambda c: c["sample"].isin(*names) & F.map_contains_key("factors", c["sample"]) & c["count"].isNotNull())
    scaled = lambda cs: F.transform(cs, lambda c: c["count"] / F.greatest(F.element_at("factors", c["sample"]), F.lit(1e-9)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = lambda xs: total(xs) / F.nullif(F.size(xs), F.lit(0))
    every = F.filter("counts", lambda c: F.map_contains_key("factors", c["sample"]) & c["count"].isNotNull())
    rows = guides.join(sent_out(factors, few), experiment).where(F.exists("counts", lambda c: F.map_contains_key("factors", c["sample"])))
    rows = rows.select(experiment, "guide_id", scaled(of(control)).alias("c"), scaled(of(treated)).alias("r"), scaled(every if len(control) < 2 else of(control)).alias("s"))
    rows = rows.select(experiment, "guide_id", mean(F.col("c")).alias("mc"), mean(F.col("r")).alias("mt"), "s", mean(F.col("s")).alias("ms"))
    squares = F.transform("s", lambda x: (x - F.col("ms")) * (x - F.col("ms")))
    g = rows.select(experiment, "guide_id", "mc", "mt", F.when(F.size("s") > 1, total(squares) / (F.size("s") - 1)).alias("v"))
    over = F.when((F.col("v") > F.col("mc")) & (F.col("mc") > 0), F.ln(F.col("v") - F.col("mc")))
    fit = g.withColumns({"ly": over, "lx": F.when(over.isNotNull(), F.ln("mc"))}).groupBy(experiment).agg(F.regr_slope("ly", "lx").alias("b"), F.regr_intercept("ly", "lx").alias("a"))
    m = g.join(sent_out(fit, few), experiment)
    var = F.greatest(F.col("mc") + F.coalesce(F.exp("a") * F.pow(F.greatest("mc", F.lit(1e-9)), F.col("b")), F.lit(0.0)), F.lit(1e-9))
    m = m.select(experiment, "guide_id", F.log2((F.col("mt") + 1) / (F.col("mc") + 1)).alias("lfc"), ((F.col("mt") - F.col("mc")) / F.sqrt(var)).alias("z"))

    @F.pandas_udf("double")
    def lower_tail(z: pd.Series) -> pd.Series:
        return pd.Series(normal_tail(z.to_numpy(float)))

    return with_fdr(m.withColumn("p", lower_tail("z")).drop("z"), "p", experiment, few=few)


def with_fdr(df: DataFrame, p: str, key: str, buckets: int = 64, few: bool = False) -> DataFrame:
    """Benjamini-Hochberg within a key, over distinct p values: ranks by running sums, minimum from above by buckets."""
    values = df.where(F.col(p).isNotNull()).groupBy(key, p).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(values, (key,), p, ["n"], descending=False, few=few)
    total = values.groupBy(key).agg(F.sum("n").alias("m"))
    raw = ranked.join(sent_out(total, few), key).withColumn("q", F.least(F.col(p) * F.col("m") / F.col("cum_n"), F.lit(1.0)))
    raw = raw.withColumn("_b", F.floor(F.col("cum_n") * buckets / (F.col("m") + 1)))
    least = raw.groupBy(key, "_b").agg(F.min("q").alias("_q")).withColumn("_later", F.min("_q").over(W.Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(W.Window.unboundedPreceding, -1)))
    own = F.min("q").over(W.Window.partitionBy(key, "_b").orderBy(F.col(p).desc()).rowsBetween(W.Window.unboundedPreceding, 0))
    done = raw.withColumn("_own", own).join(least.drop("_q"), [key, "_b"]).select(key, p, F.least("_own", "_later").alias("fdr"))
    return df.join(done, [key, p], "left")


def library_sizes(wide: DataFrame, samples: Sequence[str]) -> DataFrame:
    return wide.unpivot([], list(samples), "sample", "count").groupBy("sample").agg(F.sum("count").alias("reads"))


def null_counts(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = wide.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "nulls")


def depletion_check(wide: DataFrame, control: Sequence[str], treated: Sequence[str]) -> DataFrame:
    """One row: guides with a finite fold change, those below a half, below a quarter and at zero, and their shares."""
    mean = lambda cs: sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs)
    fold = F.when(mean(control) > 0, mean(treated) / F.nullif(mean(control), F.lit(0.0)))
    one = wide.select(fold.alias("f")).agg(F.count("f").alias("finite"), F.count_if(F.col("f") < 0.5).alias("half"), F.count_if(F.col("f") < 0.25).alias("quarter"), F.count_if(F.col("f") == 0).alias("gone"))
    return one.withColumn("half_share", F.col("half") / F.nullif("finite", F.lit(0)))


def predicted(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Batch inference: the callable gets batches of df and returns keyed predictions."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield predict(pdf)

    return df.mapInPandas(task, schema)


# --- repair outcomes: rows (guide, category del/ins, len, freq) ------------------------------------------------------


def outcome_statistics(outcomes: DataFrame) -> DataFrame:
    """Per guide: precision 1 - H / ln n, share of insertions, frame shares, greatest frequency, expected length."""
    f = F.col("freq")
    shift = F.pmod(F.when(F.col("category") == "del", -F.col("len")).otherwise(F.col("len")), F.lit(3))
    g = outcomes.groupBy("guide").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(f > 0, -f * F.ln(f)).otherwise(0.0)).alias("h"), F.sum(F.when(F.col("category") == "ins", f).otherwise(0.0)).alias("insertions"),
        *[F.sum(F.when(shift == k, f).otherwise(0.0)).alias(f"frame_{k}") for k in range(3)], F.max(f).alias("highest"), F.sum(f * F.col("len")).alias("expected_length"),
    )
    return g.withColumn("precision", F.when(F.col("n") > 1, 1 - F.col("h") / F.ln("n")).otherwise(1.0)).drop("n", "h")


def length_distribution(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("guide", "category", "len").agg(F.sum("freq").alias("freq"))


def mixed_outcomes(scored: DataFrame, insertion_share: Column) -> DataFrame:
    """Frequencies exp(score - 0.25 * len), normalised by guide and category, categories mixed by the insertion share."""
    w = F.exp(F.col("score") - 0.25 * F.col("len"))
    share = w / F.sum(w).over(W.Window.partitionBy("guide", "category"))
    return scored.withColumn("freq", share * F.when(F.col("category") == "ins", insertion_share).otherwise(1 - insertion_share))


def homology_masks(sites: DataFrame, most: int = 59) -> DataFrame:
    """(guide, seq, cut, length, mask) for each deletion length at a cut: rows (guide, seq, cut). The mask has the bases that
    both sides of the deletion share, place by place, and ``-`` where they differ."""
    lengths = F.sequence(F.lit(1), F.least(F.lit(most), F.length("seq") - F.col("cut"), F.col("cut")))
    rows = sites.where((F.col("cut") > 0) & (F.length("seq") > F.col("cut"))).select("guide", "seq", "cut", F.explode(lengths).alias("length"))
    base = lambda at: F.substring("seq", at, F.lit(1))
    shared = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.when(base(F.col("cut") - F.col("length") + i + 1) == base(F.col("cut") + i + 1), base(F.col("cut") + i + 1)).otherwise("-"))
    return rows.withColumn("mask", F.array_join(shared, ""))


def _runs(mask: str) -> Column:
    """Where the runs of shared bases of a mask start: no row for each base, no shuffle."""
    places = F.sequence(F.lit(0), F.length(mask) - 1)
    return F.filter(places, lambda i: (F.substring(mask, i + 1, F.lit(1)) != "-") & ((i == 0) | (F.substring(mask, i, F.lit(1)) == "-")))


#: Guides whose outcomes are made at once in a task.
OUTCOME_ROWS = 1024


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
    """Rows (seq, cut, and others) of sequences of one length that are cut at one place, with a matrix of their letters."""
    for whole in batches:
        for at in range(0, whole.num_rows, OUTCOME_ROWS):
            rows = whole.slice(at, OUTCOME_ROWS)
            texts, alike = [x.encode() for x in rows.column("seq").to_pylist()], {}
            for i, (x, c) in enumerate(zip(texts, rows.column("cut").to_pylist())):
                alike.setdefault((len(x), c), []).append(i)
            for (size, cut), found in alike.items():
                yield rows.take(pa.array(found)), np.frombuffer(b"".join(texts[i] for i in found), np.uint8).reshape(len(found), size), cut


def _gc_counts(seq: np.ndarray) -> np.ndarray:
    """How many G and C stand before each place."""
    return np.cumsum(np.hstack([np.zeros((len(seq), 1), np.int32), np.isin(seq, list(b"GC"))]), 1, dtype=np.int32)


def _shared(seq: np.ndarray, cut: int, n: int) -> tuple[np.ndarray, ...]:
    """Where the sides of a deletion of n bases are the same, and row, first and last place of each run of such bases."""
    same = seq[:, cut - n : cut] == seq[:, cut : cut + n]
    edge = np.zeros((len(seq), 1), bool)
    start = np.nonzero(same & ~np.hstack([edge, same[:, :-1]]))[1]
    row, end = np.nonzero(same & ~np.hstack([same[:, 1:], edge]))
    return same, row, start, end


def _cut_sites(sites: DataFrame) -> DataFrame:
    return sites.select("guide", "seq", F.col("cut").cast("int").alias("cut")).where((F.col("cut") > 0) & (F.length("seq") > F.col("cut")))


def microhomologies(sites: DataFrame, most: int = 59) -> DataFrame:
    """(guide, length, start, mh_len, gc) of the runs of equal bases for each deletion length at a cut: rows (guide, seq, cut).

    All runs of a batch of guides are found at once, and a guide's are one array until they are rows of their own.
    """
    kind = "array<struct<length: int, start: int, mh_len: bigint, gc: double>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, seq, cut in _alike(batches):
            gc, found = _gc_counts(seq), []
            for n in range(1, min(most, seq.shape[1] - cut, cut) + 1):
                _, row, start, end = _shared(seq, cut, n)
                found.append((row, np.full(len(row), n), start, end + 1 - start, (gc[row, cut + end + 1] - gc[row, cut + start]) / (end + 1 - start)))
            row, length, start, size, share = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(row, kind="stable")
            ends = np.append(0, np.bincount(row, minlength=len(seq)).cumsum()).astype(np.int32)
            cells = [pa.array(length[order].astype(np.int32)), pa.array(start[order].astype(np.int32)), pa.array(size[order].astype(np.int64)), pa.array(share[order])]
            runs = pa.StructArray.from_arrays(cells, names=["length", "start", "mh_len", "gc"])
            yield pa.RecordBatch.from_arrays([rows.column("guide"), pa.ListArray.from_arrays(pa.array(ends), runs)], names=["guide", "runs"])

    asked = _cut_sites(sites)
    found = asked.mapInArrow(task, T.StructType([asked.schema["guide"], *T.StructType.fromDDL(f"runs {kind}")]))
    return found.select("guide", F.inline("runs"))


#: Layers of a network: (matrix of inputs by outputs, offsets); all but the last are followed by the logistic function.
Layers = Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]


def forward(layers: Layers, x: np.ndarray) -> np.ndarray:
    """The network's only output for each row of x."""
    for k, (w, b) in enumerate(layers):
        x = x @ np.asarray(w, float) + np.asarray(b, float)
        if k < len(layers) - 1:
            x = 1 / (1 + np.exp(-x))
    return x[:, 0]


def deletion_outcomes(sites: DataFrame, run_layers: Layers, length_layers: Layers, most: int = 59) -> DataFrame:
    """(guide, seq, cut, mask, length, position, mh_len, freq, total): deletions at each cut with their frequencies, which add up to 1.

    A run of shared bases weighs exp(score - length / 4), the score being a network's of the run's length and GC share; a
    run over the whole deletion weighs what a deletion without one of this length does on top, and a length without
    such a run has that as a row of its own, of no position. ``total`` is the sum of a guide's weights. Networks come from the caller; they are asked
    once for each length and GC count that there is, ``most`` * (most + 3) / 2 rows at most.
    """
    spark = sites.sparkSession
    inputs = [(n, g) for n in range(1, most + 1) for g in range(n + 1)]
    scores = forward(run_layers, np.array([(n, g / n) for n, g in inputs], float))
    runs = spark.createDataFrame([(n, g, float(v)) for (n, g), v in zip(inputs, scores)] + [(0, 0, None)], "mh_len int, _gc int, _run double")
    alone = spark.createDataFrame([(n, float(v)) for n, v in zip(range(1, most + 1), forward(length_layers, np.arange(1.0, most + 1)[:, None]))], "length int, _alone double")
    run = lambda at: F.substring_index(F.substring("mask", at + 1, F.length("mask")), "-", 1)
    found = F.transform(_runs("mask"), lambda at: F.struct((at + F.length(run(at))).alias("position"), F.length(run(at)).alias("mh_len"), F.length(F.regexp_replace(run(at), "[^GC]", "")).alias("_gc")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.lit(0).alias("mh_len"), F.lit(0).alias("_gc")))
    rows = homology_masks(sites, most).withColumn("x", F.explode(F.when(F.contains("mask", F.lit("-")), F.concat(found, none)).otherwise(found))).select("guide", "seq", "cut", "mask", "length", "x.*")
    rows = rows.join(F.broadcast(runs), ["mh_len", "_gc"]).join(F.broadcast(alone), "length")
    part = lambda score: F.exp(F.col(score) - 0.25 * F.col("length"))
    weight = F.when(F.col("mh_len") == 0, part("_alone")).when(F.col("mh_len") == F.col("length"), part("_run") + part("_alone")).otherwise(part("_run"))
    rows = rows.withColumn("weight", weight).withColumn("total", F.sum("weight").over(W.Window.partitionBy("guide")))
    return rows.select("guide", "seq", "cut", "mask", "length", "position", "mh_len", (F.col("weight") / F.col("total")).alias("freq"), "total")


def with_insertions(deletions: DataFrame, rate: Mapping[str, float], bases: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(guide, seq, cut, mask, category, length, position, mh_len, inserted, freq): deletion_outcomes with insertions of one base.

    The share of insertions among all is logistic in what ``rate`` weighs: ``intercept``, ``precision`` (of the deletions of 1 to 28
    bases, 1 less their entropy over its greatest), ``log_total``, and ``5A`` to ``3T``, the bases on either side of the cut; of its
    odds, ``bases`` gives each inserted base its part by the base before the cut. All of a guide's frequencies add up to 1.
    """
    short = F.when(F.col("length") <= 28, F.col("freq"))
    lengths = deletions.groupBy("guide", "seq", "cut", "total", "length").agg(F.sum(short).alias("f"))
    entropy = F.ln(F.sum("f")) - F.sum(F.col("f") * F.ln("f")) / F.sum("f")  # of the shares f / sum(f)
    g = lengths.groupBy("guide", "seq", "cut", "total").agg((1 - entropy / math.log(28)).alias("precision"))
    five, three = F.expr("substring(seq, cut, 1)"), F.expr("substring(seq, cut + 1, 1)")
    side = lambda col, n: sum((F.when(col == b, float(rate.get(f"{n}{b}", 0.0))).otherwise(0.0) for b in "ACGT"), F.lit(0.0))
    odds = F.exp(float(rate.get("intercept", 0.0)) + float(rate.get("precision", 0.0)) * F.col("precision") + float(rate.get("log_total", 0.0)) * F.ln("total") + side(five, 5) + side(three, 3))
    share = F.create_map(*[x for b, v in bases.items() for x in (F.lit(b), F.array(*[F.struct(F.lit(i).alias("inserted"), F.lit(float(p)).alias("part")) for i, p in v.items()]))])
    made = g.withColumn("odds", odds).select("guide", "seq", "cut", "odds", F.explode(share[five]).alias("x"))
    insertions = made.select("guide", "seq", "cut", F.lit(None).cast("string").alias("mask"), F.lit("ins").alias("category"), F.lit(1).alias("length"), F.lit(None).cast("int").alias("position"), F.lit(0).alias("mh_len"), "x.inserted", (F.col("odds") * F.col("x.part")).alias("freq"))
    cut = deletions.select("guide", "seq", "cut", "mask", F.lit("del").alias("category"), "length", "position", "mh_len", F.lit(None).cast("string").alias("inserted"), "freq")
    both = cut.unionByName(insertions)
    return both.withColumn("freq", F.col("freq") / F.sum("freq").over(W.Window.partitionBy("guide")))


def outcome_genotypes(outcomes: DataFrame) -> DataFrame:
    """(guide, category, length, position, mh_len, name, genotype, freq): outcomes of with_insertions, each with what is left.

    A deletion without a position is split over the positions where neither side shares a base: in equal parts over
    the first place, the last one, and all those between together, as far as there are such. Where there is none it
    stays as it is, without a genotype. A guide's frequencies still add up to 1.
    """
    differs = lambda i: F.substring("mask", i, F.lit(1)) == "-"
    head, tail = F.when(differs(F.lit(1)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(differs(F.col("length")), F.array(F.col("length"))).otherwise(F.array().cast("array<int>"))
    middle = F.when(F.col("length") > 1, F.filter(F.sequence(F.lit(1), F.col("length") - 1), lambda i: differs(i) & differs(i + 1))).otherwise(F.array().cast("array<int>"))
    open_ = (F.col("category") == "del") & F.col("position").isNull()
    rows = outcomes.withColumns({"_head": F.when(open_, head), "_tail": F.when(open_, tail), "_middle": F.when(open_, middle)})
    kinds = F.size("_head") + F.size("_tail") + F.least(F.size("_middle"), F.lit(1))
    each = lambda places, n: F.transform(places, lambda p: F.struct(p.alias("position"), (F.col("freq") / kinds / n).alias("freq")))
    whole = F.array(F.struct("position", "freq"))
    parts = F.when(~open_ | (kinds == 0), whole).otherwise(F.concat(each(F.col("_head"), F.lit(1)), each(F.col("_tail"), F.lit(1)), each(F.col("_middle"), F.size("_middle"))))
    rows = rows.withColumn("x", F.explode(parts)).select("guide", "seq", "cut", "category", "length", "mh_len", "inserted", "x.*")
    at = F.col("cut") - F.col("length") + F.col("position")
    text = lambda a, n: F.substring("seq", a, n)
    cut_out = text(at + 1, F.col("length"))
    name = F.when(F.col("category") == "ins", F.concat(F.lit("ins"), "inserted")).when(F.col("position").isNull(), F.concat(F.lit("del"), F.col("length").cast("string"))).otherwise(F.concat(F.lit("del"), cut_out))
    left = F.when(F.col("category") == "ins", F.concat(F.expr("left(seq, cut)"), "inserted", F.expr("substring(seq, cut + 1)"))).when(F.col("position").isNotNull(), F.concat(text(F.lit(1), at), text(F.col("cut") + F.col("position") + 1, F.length("seq"))))
    return rows.select("guide", "category", "length", "position", "mh_len", name.alias("name"), left.alias("genotype"), "freq")


def _crc_shifts(most: int) -> np.ndarray:
    """For 0 to ``most`` bytes, what each of the four bytes of a CRC-32 becomes once so many more follow, of zeros: that of a text
    followed by another is this of the first, and the other's, each bit added without carry."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])]
    for _ in range(most):
        out.append((out[-1] >> 8) ^ one[out[-1] & 255])
    return np.array(out)


def _followed(crc: np.ndarray, shifts: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    return shifts[by, 0, crc & 255] ^ shifts[by, 1, crc >> 8 & 255] ^ shifts[by, 2, crc >> 16 & 255] ^ shifts[by, 3, crc >> 24]


def _scores(run_layers: Layers, length_layers: Layers, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What the networks give for each length of a run by its count of G and C, and for each length of a deletion."""
    run = np.zeros((most + 1, most + 1))
    inputs = [(n, g) for n in range(1, most + 1) for g in range(n + 1)]
    run[tuple(np.array(inputs).T)] = forward(run_layers, np.array([(n, g / n) for n, g in inputs], float))
    return run, forward(length_layers, np.arange(1.0, most + 1)[:, None])


def _odds(seq: np.ndarray, cut: int, by_length: np.ndarray, rate: Mapping[str, float]) -> np.ndarray:
    """The odds of insertions that with_insertions gives, from the weights of deletions by length."""
    total = by_length.sum(0)
    f = by_length[:28] / total
    entropy = np.log(f.sum(0)) - (f * np.log(np.where(f > 0, f, 1.0))).sum(0) / f.sum(0)
    side = lambda at, n: np.array([float(rate.get(f"{n}{chr(b)}", 0.0)) if b in b"ACGT" else 0.0 for b in seq[:, at].tolist()])
    return np.exp(float(rate.get("intercept", 0.0)) + float(rate.get("precision", 0.0)) * (1 - entropy / math.log(28)) + float(rate.get("log_total", 0.0)) * np.log(total) + side(cut - 1, 5) + side(cut, 3))


def outcome_sums(sites: DataFrame, run_layers: Layers, length_layers: Layers, rate: Mapping[str, float], bases: Mapping[str, Mapping[str, float]], most: int = 59) -> DataFrame:
    """(guide, category, length, inserted, n, freq, highest, homology): with_insertions of deletion_outcomes, summed by kind, length and
    inserted base for each row of sites (guide, seq, cut): how many there are, their frequency, the highest one, and the sum of
    position times mh_len. A row's outcomes are made at once, as in genotype_sums.
    """
    run, alone = _scores(run_layers, length_layers, most)
    schema = T.StructType.fromDDL("category string, length int, inserted string, n long, freq double, highest double, homology long")

    def deletions(seq: np.ndarray, gc: np.ndarray, cut: int, n: int) -> tuple[np.ndarray, ...]:
        """For each row how many deletions of n bases there are, their weight, the greatest one, and position times mh_len."""
        same, row, start, end = _shared(seq, cut, n)
        size, upto, own = end - start + 1, cut - n + end + 1, np.exp(alone[n - 1] - 0.25 * n)
        weight = np.exp(run[size, gc[row, upto] - gc[row, upto - size]] - 0.25 * n) + np.where(size == n, own, 0.0)
        lone = np.where(same.all(1), 0.0, own)
        highest = lone.copy()
        np.maximum.at(highest, row, weight)
        add = lambda x: np.bincount(row, x, len(seq))
        return np.bincount(row, minlength=len(seq)) + (lone > 0), add(weight) + lone, highest, add((end + 1) * size).astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, seq, cut in _alike(batches):
            count, gc, guide = len(seq), _gc_counts(seq), rows.column("guide")
            cuts = [deletions(seq, gc, cut, n) for n in range(1, min(most, seq.shape[1] - cut, cut) + 1)]
            by_length = np.array([weight for _, weight, _, _ in cuts])
            odds, own = _odds(seq, cut, by_length, rate), [bases.get(chr(b), {}) for b in seq[:, cut - 1].tolist()]
            whole = 1 + odds * np.array([float(sum(x.values())) for x in own])
            scale = by_length.sum(0) * whole
            for n, (m, weight, highest, homology) in enumerate(cuts, 1):
                made = [pa.array(["del"] * count), pa.array(np.full(count, n, np.int32)), pa.nulls(count, pa.string()), pa.array(m), pa.array(weight / scale), pa.array(highest / scale), pa.array(homology)]
                yield pa.RecordBatch.from_arrays([guide, *made], names=["guide", *schema.names])
            inserted = [(r, i, p) for r, x in enumerate(own) for i, p in x.items()]
            row, k = np.array([r for r, _, _ in inserted], np.int64), len(inserted)
            freq = pa.array((odds / whole)[row] * np.array([p for _, _, p in inserted], float))
            made = [pa.array(["ins"] * k, pa.string()), pa.array(np.ones(k, np.int32)), pa.array([i for _, i, _ in inserted], pa.string()), pa.array(np.ones(k, np.int64)), freq, freq, pa.array(np.zeros(k, np.int64))]
            yield pa.RecordBatch.from_arrays([guide.take(pa.array(row)), *made], names=["guide", *schema.names])

    asked = _cut_sites(sites)
    return asked.mapInArrow(task, T.StructType([asked.schema["guide"], *schema]))


def genotype_sums(sites: DataFrame, run_layers: Layers, length_layers: Layers, rate: Mapping[str, float], bases: Mapping[str, Mapping[str, float]], most: int = 59) -> DataFrame:
    """(guide, category, length, n, freq, names, genotypes): outcome_genotypes of with_insertions of deletion_outcomes, summed by kind
    and length for each row of sites (guide, seq, cut): how many there are, their frequency, CRC-32 of names and of genotypes (none: 0).

    A row's outcomes are made at once from the bases on either side of its cut, so no outcome is a row that is shuffled or sorted.
    """
    run, alone = _scores(run_layers, length_layers, most)
    schema = T.StructType.fromDDL("category string, length int, n long, freq double, names long, genotypes long")

    def deletions(seq: np.ndarray, gc: np.ndarray, cut: int, n: int) -> tuple[np.ndarray, ...]:
        """row, position (-1: none) and weight of each deletion of n bases."""
        same, row, start, end = _shared(seq, cut, n)
        size = end - start + 1
        own = np.exp(alone[n - 1] - 0.25 * n)
        upto = cut - n + end + 1
        weight = np.exp(run[size, gc[row, upto] - gc[row, upto - size]] - 0.25 * n) + np.where(size == n, own, 0.0)
        apart = ~same
        places = np.hstack([apart[:, :1], apart[:, :-1] & apart[:, 1:], apart[:, -1:]])
        inner = places[:, 1:-1].sum(1)
        kinds = places[:, [0, -1]].sum(1) + np.minimum(inner, 1)
        which, at = np.nonzero(places)
        part = own / kinds[which] / np.where((at > 0) & (at < n), inner[which], 1)
        whole = np.nonzero(apart.any(1) & (kinds == 0))[0]
        return np.concatenate([row, which, whole]), np.concatenate([end + 1, at, np.full(len(whole), -1)]), np.concatenate([weight, part, np.full(len(whole), own)])

    def sums(rows: pa.RecordBatch, seq: np.ndarray, cut: int) -> Iterator[pa.RecordBatch]:
        """Those of guides with sequences of one length that are cut at one place."""
        count, size = seq.shape
        gc = _gc_counts(seq)
        cuts = [deletions(seq, gc, cut, n) for n in range(1, min(most, size - cut, cut) + 1)]
        by_length = np.array([np.bincount(row, weight, count) for row, _, weight in cuts])
        total, odds = by_length.sum(0), _odds(seq, cut, by_length, rate)
        own = [bases.get(chr(b), {}) for b in seq[:, cut - 1].tolist()]
        share = np.array([float(sum(x.values())) for x in own])
        # CRC-32 of the bases before each place, and from it on: a genotype is a part of either kind, one after the other.
        shifts = _crc_shifts(size)
        heads = np.zeros((count, size + 1), np.uint32)
        for i in range(size):
            heads[:, i + 1] = ~(shifts[1, 0, (~heads[:, i] ^ seq[:, i]) & 255] ^ (~heads[:, i] >> 8))
        tails = heads[:, -1:] ^ _followed(heads, shifts, size - np.arange(size + 1))
        code = lambda text: np.uint32(zlib.crc32(text))

        def batch(category: str, n: int, row: np.ndarray, freq: np.ndarray, names: np.ndarray, genotypes: np.ndarray) -> pa.RecordBatch:
            add = lambda x: pa.array(np.bincount(row, x, count).astype(np.int64))  # noqa: E731  whole numbers below 2^53
            made = [pa.array([category] * count), pa.array(np.full(count, n, np.int32)), pa.array(np.bincount(row, minlength=count)), pa.array(np.bincount(row, freq, count).astype(float)), add(names), add(genotypes)]
            return pa.RecordBatch.from_arrays([rows.column("guide"), *made], names=["guide", *schema.names])

        for n, (row, position, weight) in enumerate(cuts, 1):
            there, at = position >= 0, np.maximum(position, 0) + cut - n
            head, end = heads[row, at], at + n
            names = np.where(there, _followed(code(b"del"), shifts, n) ^ heads[row, end] ^ _followed(head, shifts, n), code(b"del%d" % n))
            genotypes = np.where(there, _followed(head, shifts, size - end) ^ tails[row, end], 0)
            yield batch("del", n, row, weight / (total * (1 + odds * share))[row], names, genotypes)
        inserted = [(r, i.encode(), p) for r, x in enumerate(own) for i, p in x.items()]
        row = np.array([r for r, _, _ in inserted], np.int64)
        freq = (odds / (1 + odds * share))[row] * np.array([p for _, _, p in inserted], float)
        letters = np.array([zlib.crc32(i) for _, i, _ in inserted], np.uint32)
        sizes = np.array([len(i) for _, i, _ in inserted], np.int64)
        more = _crc_shifts(int(sizes.max(initial=0)))
        genotypes = _followed(_followed(heads[row, cut], more, sizes) ^ letters, shifts, size - cut) ^ tails[row, cut]
        yield batch("ins", 1, row, freq, _followed(code(b"ins"), more, sizes) ^ letters, genotypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, seq, cut in _alike(batches):
            yield from sums(rows, seq, cut)

    asked = _cut_sites(sites)
    return asked.mapInArrow(task, T.StructType([asked.schema["guide"], *schema])).where("n > 0")


# --- sequence features ------------------------------------------------------------------------------------------------


def nucleotide_features(guides: DataFrame, order: int = 2) -> DataFrame:
    """(guide, feature, value): position-dependent k-mers such as ``GG_18`` and counts such as ``GG``, k up to ``order``."""
    parts = None
    for k in range(1, order + 1):
        at = F.when(F.length("seq") >= k, F.sequence(F.lit(1), F.length("seq") - k + 1)).otherwise(F.array().cast("array<int>"))
        one = guides.select("guide", F.explode(at).alias("i"), "seq").select("guide", "i", F.substring("seq", F.col("i"), F.lit(k)).alias("word"))
        both = one.select("guide", F.explode(F.array(F.concat_ws("_", "word", (F.col("i") - 1).cast("string")), F.col("word"))).alias("feature"))
        parts = both if parts is None else parts.union(both)
    return parts.groupBy("guide", "feature").agg(F.count(F.lit(1)).alias("value"))


def one_hot(s: Column) -> Column:
    """An array of four flags for each base; N lights all four."""
    return F.transform(F.split(s, ""), lambda b: F.array(*[((b == x) | (b == "N")).cast("int") for x in "ACGT"]))


def percentile_against(df: DataFrame, reference: DataFrame, column: str = "score") -> DataFrame:
    """Share of the reference's scores at or below each score: ranks over the union, no pairs."""
    both = df.select(F.col(column).alias("s"), F.lit(0).alias("r")).unionByName(reference.select(F.col(column).alias("s"), F.lit(1).alias("r"))).where("s is not null")
    cells = running_sums(both.groupBy("s").agg(F.sum("r").cast("long").alias("r")).withColumn("k", F.lit(1)), ("k",), "s", ["r"], descending=False, few=True)
    total = reference.agg(F.count(column).alias("total"))
    share = cells.crossJoin(F.broadcast(total)).select(F.col("s").alias(column), (F.col("cum_r") / F.col("total")).alias("percentile"))
    return df.join(share, column, "left")


#: Molecular weights of the bases in a strand, and what the ends take off.
BASE_WEIGHTS = {"A": 313.21, "C": 289.18, "G": 329.21, "T": 304.2}


def molecular_weight(s: Column) -> Column:
    return sum((F.length(F.regexp_replace(s, f"[^{b}]", "")) * w for b, w in BASE_WEIGHTS.items()), F.lit(-61.96))


#: Published nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K) of DNA dinucleotides.
NEIGHBOURS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
#: Enthalpy and entropy of an end by its base.
ENDS = {"A": (2.3, 4.1), "T": (2.3, 4.1), "C": (0.1, -2.8), "G": (0.1, -2.8)}


def melting_temperature(s: Column, concentration_nm: float = 50.0, sodium_mm: float = 50.0) -> Column:
    """Nearest-neighbour melting temperature in Celsius with the entropy's salt term; null below two bases or beyond ACGT."""
    table = lambda k: F.create_map(*[x for w, v in NEIGHBOURS.items() for x in (F.lit(w), F.lit(v[k]))])
    ends = lambda k: F.create_map(*[x for w, v in ENDS.items() for x in (F.lit(w), F.lit(v[k]))])
    steps = F.sequence(F.lit(1), F.length(s) - 1)

    def total(k: int) -> Column:
        inner = F.aggregate(steps, F.lit(0.0), lambda a, i: a + table(k)[F.substring(s, i, F.lit(2))])
        return inner + ends(k)[F.substring(s, 1, 1)] + ends(k)[F.substring(s, -1, 1)]

    entropy = total(1) + 0.368 * (F.length(s) - 1) * math.log(sodium_mm * 1e-3)
    t = 1000 * total(0) / (entropy + 1.987 * math.log(concentration_nm * 1e-9 / 4)) - 273.15
    return F.when((F.length(s) >= 2) & s.rlike("^[ACGT]+$"), t)


#: Letters of all k-mers of one and two bases.
_MERS = {k: ["".join(x) for x in itertools.product("ACGT", repeat=k)] for k in (1, 2)}
#: Stretches of the protospacer (0-based, end left out) whose melting temperature is a feature of its own.
_PARTS = {"tm": (0, 30), "tm_near": (19, 24), "tm_middle": (11, 19), "tm_far": (6, 11)}


def feature_names() -> list[str]:
    """The dictionary of the features of a target with its context, 30 bases: place and name."""
    placed = [f"{m}_{i}" for k in (1, 2) for i in range(21 - k) for m in _MERS[k]]
    return [*placed, *_MERS[1], *_MERS[2], "gc", "gc_high", "gc_low", *(f"nggx_{m}" for m in _MERS[2]), *_PARTS, "weight"]


def _feature_block(texts: list[bytes]) -> np.ndarray:
    """The features of texts of 30 bases, a row each; not a number where there is none."""
    place = {n: i for i, n in enumerate(feature_names())}
    digit = np.full(256, 4, np.int64)
    digit[list(b"ACGT")] = range(4)
    bases = digit[np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), 30)]
    pairs = np.where((bases[:, :-1] < 4) & (bases[:, 1:] < 4), bases[:, :-1] * 4 + bases[:, 1:], -1)
    out = np.zeros((len(texts), len(place)))
    for k, words in ((1, np.where(bases < 4, bases, -1)[:, 4:24]), (2, pairs[:, 4:23])):
        row, at = np.nonzero(words >= 0)
        word = words[row, at]
        out[row, place[f"{_MERS[k][0]}_0"] + at * 4**k + word] = 1.0
        first = place[_MERS[k][0]]
        out[:, first : first + 4**k] = np.bincount(row * 4**k + word, minlength=len(texts) * 4**k).reshape(-1, 4**k)
    gc = ((bases[:, 4:24] == 1) | (bases[:, 4:24] == 2)).sum(1)
    out[:, place["gc"]], out[:, place["gc_high"]], out[:, place["gc_low"]] = gc, gc > 10, gc < 10
    beside = np.nonzero((bases[:, 24] < 4) & (bases[:, 27] < 4))[0]
    out[beside, place["nggx_AA"] + bases[beside, 24] * 4 + bases[beside, 27]] = 1.0
    inner, ends = np.array([NEIGHBOURS[m] for m in _MERS[2]]), np.array([*(ENDS[m] for m in "ACGT"), (np.nan, np.nan)])
    for name, (a, b) in _PARTS.items():
        enthalpy, entropy = (inner[pairs[:, a : b - 1]].sum(1) + ends[bases[:, a]] + ends[bases[:, b - 1]]).T
        tm = 1000 * enthalpy / (entropy + 0.368 * (b - a - 1) * math.log(50.0 * 1e-3) + 1.987 * math.log(50.0 * 1e-9 / 4)) - 273.15
        out[:, place[name]] = np.where((bases[:, a:b] < 4).all(1), tm, np.nan)
    out[:, place["weight"]] = sum(((bases == i).sum(1) * BASE_WEIGHTS[b] for i, b in enumerate("ACGT")), -61.96)
    return out


def feature_vectors(targets: DataFrame) -> DataFrame:
    """(guide, places, values): a sparse vector over feature_names() for each target (guide, seq of 30 bases), no shuffle.

    Bases and pairs of bases by their place in the protospacer and their counts, GC count and flags, the bases beside the
    PAM's GG, melting temperatures of the whole and of three parts, and the molecular weight. Letters beyond ACGT have no
    features of their own; a temperature is null there. A batch's vectors are made at once.
    """
    schema = T.StructType([targets.schema["guide"], *T.StructType.fromDDL("places array<int>, values array<double>")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUTCOME_ROWS):
                rows = whole.slice(at, OUTCOME_ROWS)
                block = _feature_block([x.encode() for x in rows.column("seq").to_pylist()])
                row, place = np.nonzero(block)  # not a number is not zero
                ends = pa.array(np.append(0, np.bincount(row, minlength=len(block)).cumsum()).astype(np.int32))
                value = pa.array(block[row, place], from_pandas=True)  # not a number: null
                yield pa.RecordBatch.from_arrays([rows.column("guide"), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, value)], names=schema.names)

    return targets.select("guide", "seq").mapInArrow(task, schema)


def _entries(vectors: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value (null: not a number) of what is not zero in a batch of sparse vectors."""
    sizes = vectors.column("places").value_lengths().to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), vectors.column("places").flatten().to_numpy(), vectors.column("values").flatten().to_numpy(zero_copy_only=False).astype(float)


def feature_statistics(vectors: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and standard deviation (n - 1) of each feature, in one pass over what is not zero; an error if a value is null.

    A task gives a row a feature: how many there are, their mean and squared distances from it, which add up without loss.
    """
    size = len(feature_names())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, nulls, n, mean, m2 = 0, np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size)
        for batch in batches:
            _, place, value = _entries(batch)
            rows, there = rows + batch.num_rows, ~np.isnan(value)
            nulls += np.bincount(place[~there], minlength=size)
            place, value = place[there], value[there]
            more = np.bincount(place, minlength=size).astype(float)
            own = np.bincount(place, value, size) / np.maximum(more, 1)
            apart, both = own - mean, np.maximum(n + more, 1)
            m2 += np.bincount(place, (value - own[place]) ** 2, size) + apart**2 * n * more / both
            mean, n = mean + apart * more / both, n + more
        made = [np.append(np.arange(size), -1).astype(np.int32), np.append(n, rows).astype(np.int64), np.append(mean, 0.0), np.append(m2, 0.0), np.append(nulls, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["place", "n", "mean", "m2", "nulls"])

    parts = vectors.select("places", "values").mapInArrow(task, "place int, n long, mean double, m2 double, nulls long").where("n > 0 or nulls > 0")

    def merged(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    each = F.filter(F.collect_list(F.struct("n", "mean", "m2")), lambda x: x["n"] > 0)  # a row a task
    found = {r["place"]: r for r in parts.groupBy("place").agg(F.aggregate(each, none, merged).alias("x"), F.sum("nulls").alias("nulls")).collect()}  # a row a feature at most
    n = found.pop(-1)["x"]["n"] if -1 in found else 0
    mean, std = [0.0] * size, [0.0] * size
    for p, r in sorted(found.items()):
        if r["nulls"]:
            raise ValueError(f"{r['nulls']} null values of {feature_names()[p]}")
        m, a = r["x"]["n"], r["x"]["mean"]
        mean[p] = a * m / n
        std[p] = math.sqrt(max(0.0, (r["x"]["m2"] + a * a * m * (n - m) / n) / (n - 1))) if n > 1 else 0.0
    return mean, std


def z_sums(vectors: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """(guide, filled, z_sum, z_squares) of z_scored: how many features that vary are not zero, the sum of a guide's z-scores and of
    their squares, from what is not zero; no dense vector and no shuffle."""
    varies = np.array(std) > 1e-9
    slope = np.where(varies, 1 / np.where(varies, std, 1.0), 0.0)
    base = -np.array(mean) * slope
    schema = T.StructType([vectors.schema["guide"], *T.StructType.fromDDL("filled long, z_sum double, z_squares double")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, value = _entries(batch)
            add = lambda x: np.bincount(row, x, batch.num_rows)
            up = value * slope[place]
            made = [add(varies[place]).astype(np.int64), base.sum() + add(up), (base**2).sum() + add(up * (up + 2 * base[place]))]
            yield pa.RecordBatch.from_arrays([batch.column("guide"), *(pa.array(x) for x in made)], names=schema.names)

    return vectors.mapInArrow(task, schema)


def z_scored(vectors: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """(guide, z): the dense vector of z-scores; a feature that never varies is 0."""
    still = [s <= 1e-9 for s in std]
    base = F.array(*[F.lit(0.0 if f else -m / s) for m, s, f in zip(mean, std, still)])
    slope = F.array(*[F.lit(0.0 if f else 1 / s) for s, f in zip(std, still)])
    one = vectors.sparkSession.range(1).select(base.alias("_base"), slope.alias("_slope"))  # one row of two arrays
    given = F.map_from_arrays("places", "values")
    z = F.transform("_base", lambda v, i: v + F.coalesce(F.try_element_at(given, i), F.lit(0.0)) * F.get("_slope", i))
    return vectors.crossJoin(F.broadcast(one)).select("guide", z.alias("z"))
