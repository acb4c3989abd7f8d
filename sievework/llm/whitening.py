"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers x, so their scatter n * sum(x x') - S S' (n vectors with the sums S, centred before
multiplying, n**2 times the covariance) is a matrix of whole numbers that no rounding touches:

(1) tasks add up the products of their rows, Spark adds up the cells, and the driver gets one matrix of d * d cells;
(2) its characteristic polynomial is found modulo primes below 2**31, each by reduction to Hessenberg form, one prime a
    row of a Spark job, and put together by Chinese remaindering with enough primes for the largest coefficient;
(3) all roots are real, so the sign changes of p(y + a) tell how many roots are above a, repeated ones
    included: bisection isolates the largest ones to a width of one in 2**PRECISION of the trace;
(4) a component is the null space of the scatter less its root, by inverse iteration in decimals of as many digits.

The projection of the rows is one pass over the table in doubles.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE = 256
COMPONENTS = 4
#: Bits after the trace's first one to which a root is isolated, and decimal digits of the inverse iteration.
PRECISION, DIGITS = 160, 100
#: Whole numbers are added up in this many parts of so many bits.
PARTS, PART_BITS = 5, 40


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) with x = floor(scale * c) of each entry c as a long; rows without a whole finite vector are left out.

    Entries beyond a long are held at its ends. Vectors of fewer dimensions are filled up with zeros.
    """
    c = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    longs = F.transform(c, lambda e: F.floor(e * scale).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", longs.alias("x"))


def filled(rows: DataFrame, dims: int) -> DataFrame:
    return rows.withColumn("x", F.when(F.size("x") < dims, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))).otherwise(F.col("x")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _products(x: np.ndarray) -> np.ndarray:
    """x'x of whole numbers, exactly: in doubles where these are exact, else in integers of any size."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if most * most * max(1, len(x)) < 2**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T @ x


def scatter(distinct: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and n * sum(x x') - S S' of the rows x, exactly."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dims)
                total = total + _products(np.hstack([x, np.ones((len(x), 1), np.int64)]))  # the last row and column: sums and count
        i, j = np.triu_indices(dims + 1)
        cells = total[i, j].tolist()
        mask = (1 << PART_BITS) - 1
        parts = [[v >> PART_BITS * k & mask for v in cells] for k in range(PARTS - 1)] + [[v >> PART_BITS * (PARTS - 1) for v in cells]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], ["i", "j", *(f"p{k}" for k in range(PARTS))])

    cells = distinct.select("x").mapInArrow(task, "i int, j int, " + ", ".join(f"p{k} long" for k in range(PARTS)))
    found = cells.groupBy("i", "j").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(PARTS)]).collect()  # (dims + 1)**2 / 2 rows
    g = np.zeros((dims + 1, dims + 1), object)
    for r in found:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = sum(r[f"p{k}"] << PART_BITS * k for k in range(PARTS))
    n, sums = int(g[dims, dims]), [int(v) for v in g[dims, :dims]]
    s = np.array(sums, object)
    return n, sums, n * g[:dims, :dims] - np.outer(s, s)


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below a limit of at most 2**32."""
    out, p = [], limit - 1
    while len(out) < count:
        if p > 2 and p % 2 and _is_prime(p):
            out.append(p)
        p -= 1
    return out


def _is_prime(n: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        if n == a:
            return True
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(yI - matrix) modulo a prime below 2**31, constant first, by reduction to Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        nonzero = np.flatnonzero(h[k + 1 :, k])
        if not len(nonzero):
            continue
        pivot = k + 1 + int(nonzero[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        after = np.zeros(d + 1, np.int64)
        after[1:] = polys[k, :-1]
        after = (after - h[k, k] * polys[k] % p) % p
        if k:
            t, chain = np.zeros(k, np.int64), 1
            for i in range(k - 1, -1, -1):
                chain = chain * int(h[i + 1, i]) % p
                t[i] = int(h[i, k]) * chain % p
            after = (after - (t[:, None] * polys[:k] % p).sum(0)) % p
        polys[k + 1] = after
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(yI - matrix), constant first, exactly, for a positive semidefinite matrix of whole numbers."""
    d = len(matrix)
    trace = sum(int(matrix[i, i]) for i in range(d))
    bits = d * (trace // d + 2).bit_length() + 2  # no coefficient is beyond (1 + trace / d)**d
    primes = primes_below(2**31, bits // 30 + 2)
    sent = spark.sparkContext.broadcast(matrix)  # d * d numbers

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"p": pdf["p"], "rest": [polynomial_modulo(sent.value, int(p)) for p in pdf["p"]]})

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInPandas(task, "p long, rest array<long>").collect()
    total = 1
    for r in rows:
        total *= r["p"]
    out = [0] * (d + 1)
    for r in rows:
        other = total // r["p"]
        factor = other * pow(other, -1, r["p"])
        for k, v in enumerate(r["rest"]):
            out[k] += v * factor
    return [v - total if (v := x % total) > total // 2 else v for x in out]


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots, repeated ones included, a polynomial with real roots only has above a: sign changes of p(y + a)."""
    c = coefficients[::-1]
    for end in range(len(c), 1, -1):  # repeated division by y - a
        for i in range(1, end):
            c[i] += a * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], most: int, trace: int) -> tuple[list[int], int]:
    """The largest positive roots, falling, as whole numbers r and a shift: a root lies in (r, r + 1] / 2**shift."""
    d = len(coefficients) - 1
    shift = max(0, PRECISION - trace.bit_length())
    c = [v << shift * (d - k) for k, v in enumerate(coefficients)]
    above = {0: roots_above(c, 0), trace << shift: 0}
    found: list[int] = []
    for i in range(1, min(most, above[0]) + 1):
        low = max(a for a, n in above.items() if n >= i)
        high = min(a for a, n in above.items() if n < i)
        while high - low > 1:
            middle = (low + high) // 2
            above[middle] = roots_above(c, middle)
            low, high = (middle, high) if above[middle] >= i else (low, middle)
        found.append(low)
    return found, shift


def null_vectors(matrix: np.ndarray, roots: list[int], shift: int) -> list[np.ndarray]:
    """Unit vectors that the matrix less each root takes to zero, by inverse iteration; those of one root stand at right angles."""
    d = len(matrix)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[decimal.Decimal(int(v)) for v in row] for row in matrix], object)
        out: list[np.ndarray] = []
        for k, r in enumerate(roots):
            root = (decimal.Decimal(2 * r + 1) / 2) / decimal.Decimal(1 << shift)
            lu, order = _factors(exact - np.diag([root] * d))
            same = [v for v, other in zip(out, roots) if abs(other - r) <= 2]
            v = np.array([decimal.Decimal(1 + (i * 7919 + k * 104729) % 1000) for i in range(d)], object)
            for _ in range(3):
                for w in same:
                    v = v - (v @ w) * w
                v = _solved(lu, order, v)
                v = v / max(abs(x) for x in v)
                for w in same:
                    v = v - (v @ w) * w
                v = v / sum(x * x for x in v).sqrt()
            out.append(v)
        return [np.array([float(x) for x in v]) for v in out]


def _factors(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Triangular factors with row exchanges; a pivot of zero becomes the least number that matters."""
    a, d = a.copy(), len(a)
    order = list(range(d))
    least = max((abs(x) for x in a.flat), default=decimal.Decimal(1)) * decimal.Decimal(10) ** (5 - DIGITS) or decimal.Decimal(1)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if abs(a[k, k]) < least:
            a[k, k] = least
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b[order].copy()
    d = len(x)
    for k in range(1, d):
        x[k] = x[k] - lu[k, :k] @ x[:k]
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] - (lu[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / lu[k, k]
    return x


def fit(distinct: DataFrame, dims: int, most: int = COMPONENTS) -> dict:
    """n, the sums, the components, their eigenvalues of the covariance (divisor n) and their shares of its trace."""
    n, sums, matrix = scatter(distinct, dims)
    trace = sum(int(matrix[i, i]) for i in range(dims))
    if not trace:
        return {"n": n, "sums": sums, "vectors": np.zeros((0, dims)), "values": [], "explained": []}
    roots, shift = largest_roots(characteristic_polynomial(distinct.sparkSession, matrix), most, trace)
    vectors = null_vectors(matrix, roots, shift)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        exact = [(decimal.Decimal(2 * r + 1) / 2) / decimal.Decimal(1 << shift) for r in roots]
        values = [float(v / n / n) for v in exact]
        explained = [float(v / trace) for v in exact]
    return {"n": n, "sums": sums, "vectors": np.array(vectors), "values": values, "explained": explained}


def project(rows: DataFrame, model: dict) -> DataFrame:
    """The columns of rows with ``deviation`` and ``w``, an array with the whitened value of each component."""
    n, sums = model["n"], model["sums"]
    matrix = (model["vectors"] / np.sqrt(np.array(model["values"]))[:, None] / n).T
    dims = len(sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dims)
            most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
            if most * most * dims < 2**63:
                off = n * x - s.astype(np.int64)
                deviation = pa.array((off * off).sum(1), pa.int64())
            else:
                off = n * x.astype(object) - s
                deviation = pa.array([v if v < 2**63 else None for v in (off * off).sum(1)], pa.int64())
            w = off.astype(np.float64) @ matrix
            array = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            kept = [batch.column(c) for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*kept, deviation, array], [*(c for c in batch.schema.names if c != "x"), "deviation", "w"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "x")
    return rows.mapInArrow(task, f"{kept}deviation long, w array<double>")


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of (vec_id, embedding) and component.

    Rows whose vector is null or holds a null or a number that is not finite are left out. Null and repeated ids are
    rows like any other; a vector that is there more than once counts once in the fit. Other columns are not read. A
    deviation beyond a long is null. Only components of positive variance are returned: none, so no rows, where all vectors
    are equal, and for an empty table.
    """
    rows = whole(vectors)
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = filled(rows, dims)
    distinct = common.keep(rows.select("x").distinct())
    model = fit(distinct, dims, most)
    if not model["values"]:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    k = len(model["values"])
    w = [F.col("w")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spread = project(distinct, model).agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(v) for v in model["explained"]])
    out = project(rows, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
