"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are the lower-cased words of a text, weights their counts. For each sample k and term the hash of both gives
r and c, distributed as Gamma(2, 1), and b, uniform on (0, 1); with weight w the term's level is
t = floor(ln w / r + b), and the sample is the term and level with the least a = c * exp(-r * (t - b + 1)). Two texts
agree in a sample with a probability equal to their generalised Jaccard similarity (sum of the lesser weights
over sum of the greater ones).

A sample is stored as one long: the leading bits order by ln a, the rest tells (term, level) apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

SAMPLES = 32
SEED = 42
#: Documents that a task holds in order at a time.
BUCKET_DOCS = 2048
#: Buckets share tasks beyond this many.
MOST_PARTITIONS = 50_000
#: Ranges of ids, and ids with so many rows that each has ranges of its own, at most.
RANGES, MOST_HEAVY = 4096, 1000
#: The sample of a text without words.
NONE = (1 << 63) - 1
#: Bits of a sample that name the term and level; those above them order by ln a in steps of 2**-28.
NAME_BITS = 27
STEP_BITS = 28
#: An odd number that spreads levels over the bits of a name.
LEVEL_FACTOR = 0x9E3779B1


def _uniform(bits: str, width: int) -> str:
    """``width`` bits as a number within (0, 1)."""
    return f"((({bits}) + 0.5D) * {1 / (1 << width)!r}D)"


def sample_columns(count: int = SAMPLES, seed: int = SEED) -> list:
    """The sample for each k of a row with columns ``term`` (the term's hash) and ``lw`` (ln of its weight)."""
    out = []
    for k in range(count):
        h1, h2 = (f"xxhash64(term, {seed + 2 * k + i}L)" for i in range(2))
        part = lambda h, at: _uniform(f"shiftrightunsigned({h}, {at}) & {(1 << 25) - 1}L", 25)
        r = f"(-ln({part(h1, 0)} * {part(h1, 25)}))"
        c = f"(-ln({part(h2, 0)} * {part(h2, 25)}))"
        b = _uniform(f"shiftleft(shiftrightunsigned({h1}, 50), 14) | shiftrightunsigned({h2}, 50)", 28)
        t = f"floor(lw / {r} + {b})"
        order = f"(ln({c}) - {r} * ({t} - {b} + 1D))"
        # ln a lies within (-100, 100) but for chances below 1e-40; it is held in 36 bits with sign.
        high = f"shiftleft(cast(floor(greatest(least({order}, 100D), -100D) * {1 << STEP_BITS}D) as bigint), {NAME_BITS})"
        name = f"((term ^ ({t} * {LEVEL_FACTOR}L)) & {(1 << NAME_BITS) - 1}L)"
        out.append(F.expr(f"{high} | {name}"))
    return out


def least_samples(entries: DataFrame, keys: list[str], names: list[str], count: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """By keys, an array of the least samples for each name, over rows with term, lw and ``use``.

    Bit i of ``use`` tells whether the row counts for name i. Rows are reduced by (keys, use) first, so that each is
    sampled once whatever it counts for, and the samples are computed inside the aggregates, which Spark compiles
    to a method each; all of them in one projection would be too long a method for the JVM to compile.
    """
    least = entries.groupBy(*keys, "use").agg(*[F.min(x).alias(f"k{k}") for k, x in enumerate(sample_columns(count, seed))])
    shared = least.groupBy(*keys).agg(*[F.min(F.when(F.col("use").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"k{k}"))).alias(f"{name}_{k}") for i, name in enumerate(names) for k in range(count)])
    return shared.select(*keys, *[F.array(*[F.coalesce(f"{name}_{k}", F.lit(NONE)) for k in range(count)]).alias(name) for name in names])


def agreement(a, b):
    """Share of equal samples of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def as_text(sample_array):
    """Hexadecimal digits of the samples, 16 for each."""
    return F.lower(F.array_join(F.transform(sample_array, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def words(text):
    """The words between white space, lower-cased."""
    return F.split(F.translate(F.lower(text), "\t\n\r\f\u000b", "     "), " ")


def fingerprint(docs: DataFrame, count: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(id, samples) for rows of (id, text) with different ids: arrays of ``count`` longs."""
    terms = docs.select("id", F.explode(words(F.coalesce("text", F.lit(""))))).select("id", F.xxhash64("col").alias("term"), (F.col("col") != "").cast("int").alias("n"))
    counted = terms.groupBy("id", "term").agg(F.sum("n").alias("n"))
    entries = counted.select("id", "term", F.ln(F.greatest("n", F.lit(1))).alias("lw"), (F.col("n") > 0).cast("int").alias("use"))
    return least_samples(entries, ["id"], ["samples"], count, seed)


def _below(cuts: list[int], value) -> "F.Column":
    """How many of the ascending cuts are below a value: those of one block of 64 are compared after the blocks' first ones."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    lower = lambda array: F.size(F.filter(array, lambda c: c < value))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = lower(longs([b[0] for b in blocks]))
    return F.when(block > 0, (block - 1) * 64 + lower(F.element_at(F.array(*[longs(b) for b in blocks]), F.greatest(block, F.lit(1))))).otherwise(0)


def in_order(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Rows (bucket, place, copy, doc_id, text, next_text), each document with the text of the next lower doc_id.

    Documents are cut by doc_id into buckets of about ``bucket_docs``; a bucket is put in descending order in one task. The
    first document of a bucket also ends the one before it, as a copy that lends its text; the highest document of all
    ends the lowest bucket. Equal doc_ids follow one another by text; null ids come last. A lone document is its own
    next. Ids may be any longs: buckets are ranges between quantiles of the ids, at most RANGES, cut further into equal
    parts beyond RANGES * ``bucket_docs`` documents. An id, or null, with more than a thousandth of all rows
    and more than ``bucket_docs`` has ranges of its own, over a hash of each row's place in its input partition, and its rows
    follow one another by that hash; docs has to have the same partitions whenever it is read, as files have.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, nulls, low, high = ids.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    most = max(bucket_docs, n // MOST_HEAVY)
    heavy = {r["doc_id"]: r["n"] for r in ids.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()}  # at most MOST_HEAVY rows
    ranges = max(1, min(RANGES, math.ceil(n / bucket_docs)))
    light = ids.where(~F.col("doc_id").isin(*heavy)) if heavy else ids
    found = light.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 8 * RANGES)).first()[0] if ranges > 1 else None
    own = {x for h in heavy for x in (h - 1, h) if x >= -(1 << 63)}
    cuts = sorted({*(found or []), *own})
    low, high = (0, 0) if low is None else (low, high)
    # Nulls are range 0; range k + 1 has the ids above cut k - 1, up to cut k.
    edges = [low, *cuts, high]
    parts = [max(1, math.ceil(nulls / bucket_docs)) if nulls > most else 1]
    spread = [parts[0] > 1]
    for upper in edges[1:]:
        spread.append(upper in heavy)
        parts.append(math.ceil(heavy[upper] / bucket_docs) if upper in heavy else max(1, math.ceil(n / ranges / bucket_docs)))
    firsts = [0]
    for k in parts[:-1]:
        firsts.append(firsts[-1] + k)
    lows = [0.0, *map(float, edges[:-1])]
    spans = [1.0, *(max(1.0, float(b) - float(a)) for a, b in zip(edges, edges[1:]))]
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(cuts, F.col("doc_id")) + 1) + 1
    of = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("range"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.monotonically_increasing_id()).alias("hash"))
    rows = rows.withColumn("range", place.cast("int")).withColumn("tie", F.when(of(spread), F.col("hash")).otherwise(0))
    share = F.when(of(spread), F.col("hash").cast("double") / 2.0**64 + 0.5).otherwise((F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)) - of(lows)) / of(spans))
    part = F.least(F.floor(F.greatest(share, F.lit(0.0)) * of(parts)), (of(parts) - 1).cast("long")).cast("int")
    bucketed = rows.select("doc_id", "text", "tie", (of(firsts) + part).alias("bucket"))

    tops = bucketed.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top"))
    ring = W.Window.orderBy(F.col("bucket").desc())  # one row a bucket
    before = F.coalesce(F.lag("bucket").over(ring), F.first("bucket").over(W.Window.orderBy("bucket")))
    ends = tops.select(F.col("bucket").alias("of"), "top", before.alias("ends"))
    if n / bucket_docs <= 500_000:  # buckets, so rows
        ends = F.broadcast(ends)
    matched = bucketed.join(ends, (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("tie") == F.col("top.tie")), "left")
    copies = F.when(F.col("ends").isNull(), F.array(F.struct("bucket", F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(F.col("ends").alias("bucket"), F.lit(True).alias("copy")))
    )
    parts = max(1, min(MOST_PARTITIONS, math.ceil(n / bucket_docs)))
    rows = matched.select("doc_id", "text", "tie", F.explode(copies).alias("x")).select("x.*", "doc_id", "text", "tie").repartition(parts, "bucket")
    order = W.Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc_nulls_last())
    return rows.select("bucket", F.row_number().over(order).alias("place"), "copy", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited text shares its start with the text, so the terms of both are counted and sampled in one pass."""
    rows = in_order(common.table(spark, sf_dir, "documents"))
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    cut = F.floor(n / 3).cast("int")
    edited = F.when(F.col("copy"), F.lit("")).otherwise(F.concat(F.substring(text, F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)))
    rows = rows.select("bucket", "place", "copy", "doc_id", text.alias("text"), n.cast("long").alias("n_chars"), edited.alias("edited"))

    kinds = F.array(F.struct(F.lit(0).alias("kind"), words(F.col("text")).alias("w")), F.struct(F.lit(1).alias("kind"), words(F.col("edited")).alias("w")))
    both = rows.select("bucket", "place", F.explode(kinds).alias("x")).select("bucket", "place", "x.kind", F.explode("x.w").alias("word"))
    one = F.when(F.col("word") != "", 1.0).otherwise(0.0)
    terms = both.select("bucket", "place", F.xxhash64("word").alias("term"), F.when(F.col("kind") == 0, one).otherwise(0.0).alias("a"), F.when(F.col("kind") == 1, one).otherwise(0.0).alias("b"))
    counted = terms.groupBy("bucket", "place", "term").agg(F.sum("a").alias("wa"), F.sum("b").alias("wb"))
    entry = lambda w, use: F.struct(F.col(w).alias("w"), F.when(F.col(w) > 0, use).otherwise(0).alias("use"))
    weights = F.when(F.col("wa") == F.col("wb"), F.array(entry("wa", 3))).when(F.col("wb") == 0, F.array(entry("wa", 1)))
    weights = weights.when(F.col("wa") == 0, F.array(entry("wb", 2))).otherwise(F.array(entry("wa", 1), entry("wb", 2)))
    entries = counted.select("bucket", "place", "term", F.explode(weights).alias("x"))
    entries = entries.select("bucket", "place", "term", F.ln(F.greatest("x.w", F.lit(1.0))).alias("lw"), "x.use")
    arrays = least_samples(entries, ["bucket", "place"], ["a", "b"])

    facts = rows.select("bucket", "place", "copy", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    joined = facts.join(arrays, ["bucket", "place"])
    following = F.lead("a").over(W.Window.partitionBy("bucket").orderBy("place"))
    return (
        joined.withColumn("c", following)
        .where("not copy")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("a")).alias("fingerprint"),
            as_text(F.col("b")).alias("edited_fingerprint"),
            agreement("a", "b").alias("near_edited"),
            agreement("a", "c").alias("near_next"),
        )
    )
