"""Embedding whitening by a bit-sliced scatter.

Entries are integers. Each dimension is shifted to start at 0 and cut into bit planes; a plane of a batch of rows is
packed into 64-bit words, one bit a row. The cross-product of two dimensions is then the sum over pairs of their
planes of 2^(a + b) times the bits set in the AND of the two, which is exact at every size. The scatter is centred
as integers, n * sum(x y) - sum(x) * sum(y), and only then becomes the doubles that eigh is given.

Counts that leave a task are split in two decimals, so that no sum overflows; d * d numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import store

#: Entry c becomes floor(SCALE * c) + SHIFT. Components returned, at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows whose bits are packed at a time: a multiple of 64.
ROWS = 4096
#: Integer products below this are exact in a long.
LONG = 2**62
#: Entries beyond this have no long.
LIMIT = (2**63 - 2 * SHIFT) // SCALE


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums (of x) and lows (least x a dimension); components (k, d) scaled by 1 / sqrt(eigenvalue)."""

    n: int
    sums: list[int]
    lows: list[int]
    widest: int
    matrix: np.ndarray
    explained: np.ndarray


def usable(vector: Column) -> Column:
    """Not null or empty, and every component a finite number whose long exists."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.abs(c.cast("double")) < float(LIMIT)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def as_longs(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _ranges(d: int):
    """Rows, and least, greatest and summed entry of each dimension, of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, np.zeros(d, object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                n += len(x)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
                least = int(np.abs(x.astype(np.float64)).max()) + 1
                total = total + (x.sum(axis=0) if least * len(x) < LONG else x.astype(object).sum(axis=0)).astype(object)
        if n:
            sums = pa.array([int(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(low), pa.array(high), sums], ["dim", "n", "low", "high", "total"])

    return run, "dim int, n long, low long, high long, total decimal(38,0)"


def bit_planes(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Planes of u (rows, d; from 0), dimension by dimension and bit by bit, each as 64-bit words of one bit a row."""
    rows = -len(u) % 64
    u = np.concatenate((u, np.zeros((rows, u.shape[1]), u.dtype))) if rows else u
    columns = np.ascontiguousarray(u.T)
    planes = np.concatenate([((columns[j] >> np.arange(b, dtype=u.dtype)[:, None]) & 1).astype(bool) for j, b in enumerate(bits)])
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


def scatter(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sums of products of the columns of u (rows, d; from 0), as Python integers (d, d), by AND-popcounts of planes."""
    d, first = u.shape[1], np.concatenate(([0], np.cumsum(bits)))
    planes = bit_planes(u, bits)
    exact = np.int64 if len(u) << int(2 * bits.max()) < LONG else object
    weight = np.array([1 << a for b in bits for a in range(b)], dtype=object).astype(exact)
    out = np.zeros((d, d), dtype=exact)
    at = first[:-1]
    for i in range(d):
        for a in range(bits[i]):
            row = first[i] + a
            counts = np.bitwise_count(planes[row] & planes[at[i] :]).sum(axis=1, dtype=np.int64).astype(exact)
            out[i, i:] += weight[row] * np.add.reduceat(counts * weight[at[i] :], at[i:] - at[i])
    return out.astype(object)


def _scatter(lows: np.ndarray, bits: np.ndarray):
    """Sums of products of pairs of dimensions in a task, shifted, as high * 2^64 + low."""
    d = len(lows)
    used = np.flatnonzero(bits)  # a constant dimension has no bits and no products
    i, j = (used[x] for x in np.triu_indices(len(used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used), len(used)), object)
        held: list[np.ndarray] = []
        seen = False

        def put() -> None:
            nonlocal total, held
            u = np.concatenate(held)
            for a in range(0, len(u), ROWS):
                total = total + scatter(u[a : a + ROWS], bits[used])
            held = []

        for batch in batches:
            seen |= batch.num_rows > 0
            # wraps where a dimension is wider than a long, and is right as unsigned
            if len(used):
                held.append((_matrix(batch, d) - lows).view(np.uint64)[:, used])
            if sum(map(len, held)) >= ROWS:
                put()
        if held:
            put()
        if seen and len(used):
            flat = [int(v) for v in total[np.triu_indices(len(used))]]
            parts = [pa.array([f(v) for v in flat], pa.decimal128(38, 0)) for f in (lambda v: v >> 64, lambda v: v & (2**64 - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *parts], ["i", "j", "high", "low"])

    return run, "i int, j int, high decimal(38,0), low decimal(38,0)"


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors as rows; those that are zero in doubles left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1].T[:k]
    kept = values > len(covariance) * np.finfo(float).eps * max(np.abs(np.linalg.eigvalsh(covariance)).max(), 0)
    return values[kept], vectors[kept]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors (a column x: arrays of d longs); None without rows."""
    f, schema = _ranges(d)
    ranges = store.map_arrow(vectors, f, schema).groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    ranges = sorted(ranges.collect())  # one row a dimension
    if not ranges:
        return None
    n, lows, sums = ranges[0]["n"], [r["low"] for r in ranges], [int(r["total"]) for r in ranges]
    bits = np.array([(r["high"] - r["low"]).bit_length() for r in ranges])
    f, schema = _scatter(np.array(lows, np.int64), bits)
    products = store.map_arrow(vectors, f, schema).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # one row a pair of dimensions
    shifted = [s - n * low for s, low in zip(sums, lows)]
    covariance = np.zeros((d, d))
    for r in products:
        centred = n * ((int(r["high"]) << 64) + int(r["low"])) - shifted[r["i"]] * shifted[r["j"]]
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = centred / n**2  # of integers, so rounded once
    values, axes = principal(covariance, components)
    return Whitening(n, sums, lows, max(r["high"] - r["low"] for r in ranges), axes / np.sqrt(values)[:, None], values / covariance.trace() if len(values) else values)


def _centred(x: np.ndarray, w: Whitening) -> np.ndarray:
    """n * x - sums, exactly: as longs where they fit, else as Python integers."""
    exact = np.int64 if w.n * (w.widest + 1) < LONG else object
    u = (x - np.array(w.lows, np.int64)).view(np.uint64).astype(exact)
    return w.n * u - np.array([s - w.n * low for s, low in zip(w.sums, w.lows)], dtype=object).astype(exact)


def _project(centred: np.ndarray, w: Whitening) -> np.ndarray:
    return (centred.astype(np.float64) / w.n) @ w.matrix.T


def _moments(d: int, w: Whitening):
    """Sums of products of whitened components in a task."""
    k = len(w.matrix)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            y = _project(_centred(_matrix(batch, d), w), w)
            total, sums, n = total + y.T @ y, sums + y.sum(axis=0), n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(sums[i]), pa.array(sums[j])], ["i", "j", "xy", "x", "y"])

    return run, "i int, j int, xy double, x double, y double"


def identity_error(vectors: DataFrame, d: int, w: Whitening) -> float:
    """Largest entry, in size, of the covariance of the whitened vectors minus the identity, measured over them all."""
    f, schema = _moments(d, w)
    sums = store.map_arrow(vectors, f, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y")]).collect()  # one row a pair of components
    return max((abs(r["xy"] / w.n - r["x"] / w.n * r["y"] / w.n - (r["i"] == r["j"])) for r in sums), default=0.0)


def _whiten(d: int, w: Whitening, error: float):
    k = len(w.matrix)
    wide = len(w.lows) * (w.n * (w.widest + 1)) ** 2 >= LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            centred = _centred(_matrix(batch, d), w)
            squares = ((centred.astype(object) if wide else centred) ** 2).sum(axis=1)
            deviation = [v if v < 2**63 else None for v in squares.tolist()]
            again = lambda a: a.take(pa.array(np.repeat(np.arange(n), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    again(batch.column("vec_id")), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, w.n)), again(pa.array(deviation, pa.int64())),
                    pa.array(_project(centred, w).ravel()), pa.array(np.tile(w.explained, n)), pa.array(np.full(n * k, error)), again(pa.array([str(v) for v in squares.tolist()], pa.string())),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of every usable row.

    vectors: vec_id, embedding (array of float or double). Rows take no part whose vector is null, empty, of another
    size than most (of equally common sizes the greater counts), or holds null, non-finite entries or ones beyond the
    range of a long. Equal vectors are fitted once; rows that repeat one, or have a null id, are all returned. A
    deviation beyond a long is null, and whole as text in deviation_exact. Components whose eigenvalue is zero in
    doubles cannot be whitened and are left out: one vector, or equal ones only, give no rows. No rows give none.
    """
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), as_longs(F.col("embedding")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    rows = rows.where(F.size("x") == d)
    fitted = store.table(rows.select("x").distinct(), "fit_list")
    w = fit(fitted, d, components)
    w = w or Whitening(0, [0] * d, [0] * d, 0, np.zeros((0, d)), np.zeros(0))
    error = identity_error(fitted, d, w) if w.n else 0.0
    store.drop(fitted)
    f, schema = _whiten(d, w, error)
    return store.map_arrow(rows, f, schema)


def digest(vectors: DataFrame) -> DataFrame:
    """The first 16 whitened components of every usable row."""
    return whiten(vectors.select("vec_id", "embedding"))
