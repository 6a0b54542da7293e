"""Whitening of embeddings: MLlib's singular values of the centred rows, rescaled by their number.

The fit sees each distinct vector of integers once. Its sums are exact, the centred rows are a distributed RowMatrix, and the
total variance comes from exact deviations, so that it owes nothing to the decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, ship, stored

SCALE, COMPONENTS = 256, 4
#: A component whose share of the total variance is smaller has no direction of its own; it is rounding.
LEAST_SHARE = 1e-12
#: Different lengths of vectors that a table may hold; each is a space of its own.
LENGTHS = 16
#: Entries of a batch that are turned to numbers at a time.
ENTRIES = 1 << 20


def matrix(lists: pa.ListArray, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def cuts(batch: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, ENTRIES // d)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n * x - S) ** 2 for every row, exact at any size."""
    wide = pa.decimal128(38)
    far = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, sums), default=0)
    if far * far * max(1, x.shape[1]) < 1 << 63:
        y = x * n - np.array(sums, np.int64)
        return pa.array(np.einsum("ij,ij->i", y, y)).cast(wide)
    return pa.array([Decimal(sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))) for row in x.tolist()], wide)


class Whitening:
    """n distinct vectors with exact sums per dimension, and unit eigenvectors of their covariance by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums, self.vectors, self.values = n, sums, np.zeros((len(sums), 0)), np.zeros(0)
        self.trace = self.error = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        # S is split into whole and rest, so that nothing is lost where x and the mean are large
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.vectors / np.sqrt(self.values)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension; every batch sends one number for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            for part in cuts(batch, d):
                x = matrix(part.column(0), d)
                n += len(x)
                # halves of 32 bits add up without overflow
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low, strict=True)]
        wide = pa.decimal128(38)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], wide)], names=["at", "v"])

    got = dict(fit.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect())
    return int(got.get(-1, 0)), [int(got.get(k, 0)) for k in range(d)]


def _decomposed(fit: DataFrame, w: Whitening, most: int) -> None:
    """Eigenvectors from MLlib: all singular values are asked for, so that it takes LAPACK's, to double precision."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    d = len(w.sums)
    whole, rest = [s // w.n for s in w.sums], [(s % w.n) / w.n for s in w.sums]
    at = lambda kind, v: F.lit(v).cast(f"array<{kind}>")
    centred = F.zip_with(F.zip_with("x", at("bigint", whole), lambda a, b: (a - b).cast("double")), at("double", rest), lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")), "row")
    svd = RowMatrix(rows, w.n, d).computeSVD(d, computeU=False)
    values = svd.s.toArray() ** 2 / w.n
    vectors = svd.V.toArray()[:, : len(values)]
    keep = [k for k in range(min(most, len(values))) if values[k] > LEAST_SHARE * values[0]]
    vectors = vectors[:, keep]
    # either sign is right; the largest entry is made positive so that runs agree
    top = np.abs(vectors).argmax(0)
    w.vectors, w.values = vectors * np.where(vectors[top, range(len(keep))] < 0, -1.0, 1.0), values[keep]


def _measured(fit: DataFrame, w: Whitening) -> None:
    """Total variance from exact deviations, and how far the whitened fit list's covariance is from the identity."""
    d, k = len(w.sums), len(w.values)
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, d):
                x = matrix(part.column(0), d)
                yield pa.RecordBatch.from_arrays([deviations(x, w.n, w.sums), *(pa.array(c) for c in w.project(x).T)], names=["dev", *names])

    pairs = list(combinations_with_replacement(names, 2))
    shape = ", ".join(["dev decimal(38,0)", *(f"{c} double" for c in names)])
    got = fit.select("x").mapInArrow(run, shape).agg(F.sum("dev").cast("decimal(38,0)").alias("dev"), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    w.trace = float(int(got.dev)) / float(w.n) ** 3
    w.error = max((abs(got[f"{a}_{b}"] - (a == b)) for a, b in pairs), default=0.0)


def fitted(rows: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """The fit over rows with a column x of d whole numbers; each distinct x counts once."""
    fit = stored(rows.select("x").distinct())
    n, sums = _sums(fit, d)
    w = Whitening(n, sums)
    if n > 1:
        _decomposed(fit, w, most)
        _measured(fit, w)
    discard(fit)
    return w


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and each of the first components.

    Vectors that are null or hold null or non-finite entries are dropped; each other entry c becomes floor(scale * c). The fit
    takes every distinct vector of these once; n is their number. deviation is the exact sum over dimensions of
    (n * x - S) ** 2, a decimal of 38 digits. Covariances have divisor n. Components are unit eigenvectors by falling
    eigenvalue, of which the largest entry is positive; there are no more than dimensions, and none without variance: one
    distinct vector, or empty ones, give no rows. Vectors of different length are spaces with fits of their own, LENGTHS at
    most, beyond which it raises. Repeated rows and rows without vec_id each count for themselves in the result. scale * c has
    to fit a long. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(column(vectors, vec_id, "long").alias("vec_id"), column(vectors, embedding, "array<double>").alias("e"))
    odd = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = own.where((F.size("e") > 0) & ~odd).select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    sizes = sorted(r.d for r in rows.select(F.size("x").alias("d")).distinct().limit(LENGTHS + 1).collect())
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    shape = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], shape)
    for d in sizes:
        of = rows.where(F.size("x") == d) if len(sizes) > 1 else rows
        w = fitted(of, d, components)
        if len(w.values):
            out = out.unionByName(of.mapInArrow(_given(w), shape)) if len(sizes) > 1 else of.mapInArrow(_given(w), shape)
    return out


def _given(w: Whitening):
    d, k = len(w.sums), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = w.values / w.trace
        for batch in batches:
            for part in cuts(batch, d):
                x, m = matrix(part.column(1), d), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                ids, dev = part.column(0).take(each), deviations(x, w.n, w.sums).take(each)
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), dev, pa.array(w.project(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, w.error))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
