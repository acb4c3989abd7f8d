"""Exact top-k search by inner product with vector-approximation files.

The approximation file holds, for each row and dimension, the number of one of 2**bits cells of equal width, a byte or
two instead of a long. Cells alone are dealt into blocks and meet the queries, which are dealt into groups; each pair of
block and group is a task.

1. A first scan of the cells gives each query the k-th best lower bound over all blocks.
2. A second scan keeps the rows whose upper bound reaches it.
3. Exact vectors are fetched by id in the order of the bounds, as joins: the k best first, whose k-th exact score
   is then what a bound must reach; then all rows that reach it. No other row can be among the best, so the result is certain.

Rows with the same vector have the same score, and ties go to the smaller vec_id, so the k + 1 smallest ids of a vector
stand for all of them (one may be the query's own).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

BLOCK_ROWS = 16_384
GROUP_QUERIES = 4_096
CELL_BITS = 8  # a cell is a byte
#: Scores beyond a long are held at its ends, and so are bounds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: A bound in floats of doubles is widened by this share of the sum of all products' sizes, far beyond what rounding loses.
ROUNDING = 1e-12


def integral(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component as a long; rows without a whole finite vector are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors of fewer dimensions are filled up with zeros."""
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


class Cells:
    """The grid of cells: a lower end and a width for each dimension."""

    def __init__(self, low: list[int], high: list[int], bits: int = CELL_BITS):
        self.kind = np.dtype("<u1" if bits <= 8 else "<u2")
        self.low = np.array(low, np.int64)
        self.width = np.array([max(1, -(-(b - a + 1) >> bits)) for a, b in zip(low, high)], np.uint64)
        self.reach = np.array([max(abs(a), abs(b)) + 1 for a, b in zip(low, high)], float)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of cells; a difference of two longs is right as an unsigned number."""
        return ((rows.view(np.uint64) - self.low.view(np.uint64)) // self.width).astype(self.kind)

    def middle(self, cells: np.ndarray) -> np.ndarray:
        return self.low + cells * self.width.astype(float) + (self.width.astype(float) - 1) / 2

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """How far a score may lie from that of the middle of its cell, for each query."""
        size = np.abs(queries.astype(float))
        return size @ (self.width.astype(float) - 1) / 2 + ROUNDING * (size @ self.reach) * max(1, size.shape[1])


def exact_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Row by row inner products of longs, held at the ends of a long."""
    size = [float(np.abs(x.astype(float)).max(initial=0)) for x in (rows, queries)]
    if size[0] * size[1] * max(1, rows.shape[1]) < 2.0**62:
        return np.einsum("ij,ij->i", rows, queries)
    found = (rows.astype(object) * queries.astype(object)).sum(1)
    return np.array([max(LEAST, min(MOST, int(x))) for x in found], np.int64)


def bounds(grid: Cells, cells: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """(query's number, scores of the middles of all cells, slack), a few queries at a time."""
    middle, slack = grid.middle(cells), grid.slack(queries)
    for at in range(0, len(queries), 256):
        centre = queries[at : at + 256].astype(float) @ middle.T
        for i in range(len(centre)):
            yield at + i, centre[i], float(slack[at + i])


def _held(x: np.ndarray) -> np.ndarray:
    return np.clip(x, float(LEAST), float(MOST))


def _grid(rows: DataFrame, bits: int) -> Cells:
    """From the least and greatest value of each dimension: a row a dimension; shorter vectors count as zeros there."""
    n = rows.count()
    ends = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    return Cells([min(r["low"], 0) if r["n"] < n else r["low"] for r in ends], [max(r["high"], 0) if r["n"] < n else r["high"] for r in ends], bits)


def top_k(rows: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES, bits: int = CELL_BITS) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, v) rows against (vec_id, v) queries; ties to the smaller vec_id.

    A row never meets a query of its own vec_id. Of repeated query ids the least vector is asked for. No rows or no
    queries give no result; with fewer than k candidates all are returned. Repeated rows are counted and each takes a
    rank. Vectors of fewer dimensions count as filled up with zeros. Other columns, whatever their names, are not read.
    """
    counted = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    of_vector = F.row_number().over(W.Window.partitionBy("v").orderBy("vec_id"))
    exact = counted.withColumn("r", of_vector).where(F.col("r") <= k + 1).select("vec_id", "v", F.least("n", F.lit(k)).cast("int").alias("n"))
    exact = common.keep(exact.withColumn("row", F.monotonically_increasing_id()))  # numbers stay once they are written
    asked = common.keep(queries.groupBy("vec_id").agg(F.min("v").alias("q")).select(F.col("vec_id").alias("query_id"), "q"))
    grid = _grid(exact, bits)
    dims = max(len(grid.low), asked.agg(F.max(F.size("q"))).first()[0] or 0)
    known = len(grid.low)  # beyond it all rows are zero
    blocks = max(1, math.ceil(exact.count() / block_rows))
    groups = max(1, math.ceil(asked.count() / group_queries))
    numbers = lambda size: F.sequence(F.lit(0), F.lit(size - 1))

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = grid.of(_matrix(pdf["v"], known)) if len(pdf) else []
            yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "cells": [c.tobytes() for c in cells]})

    file = exact.select("row", "vec_id", "v").mapInPandas(approximate, "row long, vec_id long, cells binary")
    file = common.keep(file.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    # A block's cells are sent once for each group of queries, and each group once for each block.
    left = file.select("block", F.explode(numbers(groups)).alias("group"), "row", "vec_id", "cells")
    left = left.groupBy("block", "group")

    def dealt(df: DataFrame) -> DataFrame:
        return df.select(F.explode(numbers(blocks)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), *df.columns).groupBy("block", "group")

    def scanned(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        ids = a["vec_id"].to_numpy()
        cells = np.frombuffer(b"".join(a["cells"]), grid.kind).reshape(len(a), known) if known else np.zeros((len(a), 0), grid.kind)
        asked_ids = b["query_id"].to_numpy()
        for i, centre, slack in bounds(grid, cells, _matrix(b["q"], dims)[:, :known]):
            yield i, np.flatnonzero(ids != asked_ids[i]), centre, slack

    def table(found: dict[str, list[np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in found.items()})

    def lowest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list[np.ndarray]] = {"query_id": [], "low": []}
        if len(a) and len(b):
            asked_ids = b["query_id"].to_numpy()
            for i, others, centre, slack in scanned(a, b):
                best = centre[others]
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[len(best) - k :]
                found["query_id"].append(np.full(len(best), asked_ids[i]))
                found["low"].append(_held(best - slack))
        return table(found)

    low = left.cogroup(dealt(asked)).applyInPandas(lowest, "query_id long, low double")
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.col("low").desc()))
    kth = low.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", "low")
    bounded = asked.join(kth, "query_id", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf"))))

    def reaching(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list[np.ndarray]] = {"query_id": [], "row": [], "high": []}
        if len(a) and len(b):
            row, asked_ids, least = (x.to_numpy() for x in (a["row"], b["query_id"], b["low"]))
            for i, others, centre, slack in scanned(a, b):
                high = _held(centre[others] + slack)
                some = high >= least[i]
                found["query_id"].append(np.full(some.sum(), asked_ids[i]))
                found["row"].append(row[others[some]])
                found["high"].append(high[some])
        return table(found)

    near = common.keep(left.cogroup(dealt(bounded)).applyInPandas(reaching, "query_id long, row long, high double"))
    by_bound = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.col("high").desc(), "row"))
    near = near.withColumn("place", by_bound)

    def scored(pairs: DataFrame) -> DataFrame:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                score = exact_scores(_matrix(pdf["v"], dims), _matrix(pdf["q"], dims)) if len(pdf) else np.zeros(0, np.int64)
                yield pdf[["query_id", "vec_id", "n"]].assign(score=score)

        both = pairs.select("query_id", "row").join(exact, "row").join(asked, "query_id")
        return both.select("query_id", "vec_id", "n", "v", "q").mapInPandas(task, "query_id long, vec_id long, n int, score long")

    first = common.keep(scored(near.where(F.col("place") <= k)))
    # With fewer than k there is nothing further.
    certain = first.groupBy("query_id").agg(F.min("score").cast("double").alias("certain"))
    rest = scored(near.where(F.col("place") > k).join(certain, "query_id").where("high >= certain"))
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = first.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integral(common.table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


OP4_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (select q.vec_id as query_id, r.vec_id, list_inner_product(q.v, r.v)::bigint as score from e q join e r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from k where rank <= 20
"""
