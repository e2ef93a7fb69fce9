"""Embedding whitening by exact covariances: digit-slice products.

1. Entries become integers, ``x = floor(256 c)``; the fit list holds each distinct vector once.
2. Its count n and sums S are exact; ``y = n x - S`` is the centred vector, n times as long, in integers.
3. The sums of ``y_i y_j`` are exact too: y is cut into limbs of 20 bits, and the product of two slices of limbs over at
   most 8192 rows stays below 2**53, so that float64 matrix products have no rounding. A task recombines the slices'
   products as big integers and cuts its sums into digits of 24 bits; the digits of all tasks are added by entry of the
   matrix, as long numbers. One row an entry reaches the driver, which puts the digits together and decomposes the matrix.
4. Every row is projected on the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, table

SCALE = 256
LIMB_BITS = 20
#: Rows of a product: 2**13 products of two limbs of 20 bits stay below 2**53.
ROWS = 1 << 13
#: Products whose sums are held as 64-bit integers before they are recombined.
HELD = 512
DIGIT_BITS = 24
#: Bits of a long number that hold a sum or a product.
SAFE = 62
OUT = "row_id {kind}, component int, n long, deviation long, whitened double, explained double"


@dataclass
class Fit:
    """n, the sums S, the components' unit vectors as columns, their eigenvalues and shares of the variance."""

    n: int
    sums: list[int]
    least: int
    greatest: int
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None

    @property
    def widest(self) -> int:
        """No entry of y is farther from zero."""
        return max(max(abs(self.n * self.least - s), abs(self.n * self.greatest - s)) for s in self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, in 64-bit integers where all of it fits and in Python's otherwise."""
        reach = self.n * max(abs(self.least), abs(self.greatest)) + max(map(abs, self.sums))
        if reach.bit_length() <= SAFE:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _slices(y: np.ndarray) -> list[np.ndarray]:
    """y as limbs, least first, each with y's sign: ``y = sum of limbs[k] << LIMB_BITS * k``."""
    sign, left = np.where(y < 0, -1, 1), np.abs(y)
    out = []
    while not out or (left != 0).any():
        out.append((sign * (left & ((1 << LIMB_BITS) - 1))).astype(np.float64))
        left = left >> LIMB_BITS
    return out


class Products:
    """Exact sums of ``y_i y_j`` over rows."""

    def __init__(self, width: int):
        self.total = np.zeros((width, width), object)
        self.held: dict[int, np.ndarray] = {}
        self.count = 0

    def add(self, y: np.ndarray) -> None:
        for k in range(0, len(y), ROWS):
            slices = _slices(y[k : k + ROWS])
            for a, left in enumerate(slices):
                for b, right in enumerate(slices[a:], a):
                    p = (left.T @ right).astype(np.int64)
                    p = p if a == b else p + p.T
                    self.held[a + b] = self.held[a + b] + p if a + b in self.held else p
            self.count += len(slices)
            if self.count >= HELD:
                self.settle()

    def settle(self) -> np.ndarray:
        """Recombines what is held as big integers."""
        for shift, p in self.held.items():
            self.total = self.total + p.astype(object) * (1 << LIMB_BITS * shift)
        self.held, self.count = {}, 0
        return self.total


def _digits(value: int, n: int) -> list[int]:
    """``n`` digits, least first, each with the value's sign."""
    sign, left = (-1, -value) if value < 0 else (1, value)
    return [sign * (left >> DIGIT_BITS * k & ((1 << DIGIT_BITS) - 1)) for k in range(n)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by dimension, in two long digits: ``(i, high, low)``."""
    total = None
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            x = _matrix(batch.column("x").slice(k, ROWS))
            high, low = (x >> 32).sum(0).astype(object), (x & 0xFFFFFFFF).sum(0).astype(object)
            own = high * 2**32 + low
            total = own if total is None else total + own
    if total is not None:
        parts = [divmod(int(v), 2**40) for v in total]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(parts)), pa.int32()), "high": pa.array([p[0] for p in parts], pa.int64()), "low": pa.array([p[1] for p in parts], pa.int64())})


def _products(fit: Fit, n_digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                y = fit.centred(_matrix(batch.column("x").slice(k, ROWS)))
                products = products or Products(y.shape[1])
                products.add(y)
        if products is not None:
            total = products.settle()
            for i in range(len(total)):
                digits = [_digits(int(v), n_digits) for v in total[i, i:]]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(digits), pa.int32()), pa.array(range(i, len(total)), pa.int32()), *(pa.array([d[k] for d in digits], pa.int64()) for k in range(n_digits))], names=["i", "j", *(f"d{k}" for k in range(n_digits))])

    return run


def integers(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows ``(row_id, x)`` with a vector whose entries are all finite numbers."""
    v = F.col("v")
    own = vectors.select(F.col(id_column).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = own.where(v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return finite.select("row_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def fitted(x: DataFrame, components: int) -> Fit | None:
    """The fit over the distinct vectors of ``x``, a written table of vectors of one length; None if there are none."""
    n, least, greatest = x.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return None
    sums = x.mapInArrow(_sums, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    fit = Fit(n, [r.high * 2**40 + r.low for r in sums.sort("i").collect()], least, greatest)
    n_digits = max(1, -(-(n * fit.widest**2).bit_length() // DIGIT_BITS))
    names = [f"d{k}" for k in range(n_digits)]
    entries = x.mapInArrow(_products(fit, n_digits), "i int, j int, " + ", ".join(f"{d} long" for d in names))
    width = len(fit.sums)
    total = np.zeros((width, width), object)
    for r in entries.groupBy("i", "j").agg(*(F.sum(d).alias(d) for d in names)).collect():
        total[r.i, r.j] = total[r.j, r.i] = sum(int(r[d]) << DIGIT_BITS * k for k, d in enumerate(names))
    # the covariance is total / n**3; true division of Python's integers rounds once
    trace = sum(total[i, i] for i in range(width))
    cube = n**3
    scale = max(1, trace)
    values, columns = np.linalg.eigh(np.array([[total[i, j] / scale for j in range(width)] for i in range(width)], np.float64))
    top = np.argsort(-values, kind="stable")[:components]
    fit.explained = np.where(values[top] > width * np.finfo(float).eps, values[top], 0)
    fit.values = fit.explained * (trace / cube)
    fit.vectors = columns[:, top]
    return fit


def _projected(fit: Fit, y: np.ndarray) -> np.ndarray:
    """Whitened entries by component; without a value where the component's variance is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = y.astype(np.float64) @ fit.vectors / fit.n / np.sqrt(fit.values)
    out[:, fit.values == 0] = np.nan
    return out


def _whitened(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (len(fit.sums) * fit.widest**2).bit_length() <= SAFE
        m = len(fit.values)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                y = fit.centred(_matrix(part.column("x")))
                far = (y**2 if small else y.astype(object) ** 2).sum(1)
                far = far if small else np.array([v if v < 2**63 else None for v in far], object)
                rows = np.repeat(np.arange(len(y)), m)
                w = _projected(fit, y).ravel()
                ids = part.column("row_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, m + 1), len(y)).astype(np.int32)), pa.array(np.full(len(rows), fit.n)), pa.array(far[rows], pa.int64()), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(fit.explained, len(y)))], names=["row_id", "component", "n", "deviation", "whitened", "explained"])

    return run


def _wide(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                w = _projected(fit, fit.centred(_matrix(batch.column("x").slice(k, ROWS))))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in range(w.shape[1])], names=[f"w{c}" for c in range(w.shape[1])])

    return run


def identity_error(x: DataFrame, fit: Fit) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components of variance
    above zero; None if there is none."""
    some = np.flatnonzero(fit.values > 0).tolist()
    if not some:
        return None
    wide = x.mapInArrow(_wide(fit), ", ".join(f"w{c} double" for c in range(len(fit.values))))
    pairs = [(a, b) for a in some for b in some if a <= b]
    cov = wide.agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(cov, pairs, strict=True))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per row of ``vectors`` and component up to ``components``: id, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds an entry that is null, not a number or infinite are dropped; so are empty vectors,
    and vectors of another length than most have (the longer of equals). Entries beyond a long number's reach are the
    nearest long. Repeated vectors weigh once in the fit and all have their rows; ids may be null or repeated. A component
    without variance has share 0 and no ``whitened``; without any, ``identity_error`` is null. A ``deviation`` beyond a long
    number is null. Vectors of fewer entries have fewer components. Other columns aren't read. No rows give no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = integers(vectors, id_column, vector)
    width = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).where("width > 0").sort(F.desc("n"), F.desc("width")).first()
    empty = spark.createDataFrame([], f"{OUT.format(kind=kind)}, identity_error double")
    if width is None:
        return empty.withColumnRenamed("row_id", id_column)
    rows = rows.where(F.size("x") == width.width)
    fit_list = table(rows.select("x").distinct(), "fit")
    fit = fitted(fit_list, components)
    error = identity_error(fit_list, fit)
    drop(fit_list)
    return rows.mapInArrow(_whitened(fit), OUT.format(kind=kind)).withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("row_id", id_column)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` whitened on the first four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
