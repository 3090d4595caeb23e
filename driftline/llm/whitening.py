"""Embedding whitening from an exact integer scatter (operator 13).

Entries become integers, so sums and cross-products are exact whatever the order in which tasks
add them.  A task subtracts a shift near its own rows, multiplies in blocks that floating
point holds without rounding (or in longer integers where it can't), and adds in Python's
integers; the shift is put back exactly when the task ends.  Its numbers leave as limbs of 32
bits, which Spark sums by (row, column) with partial aggregates.  The driver gets one
number for each pair of dimensions, whatever the number of rows, forms n * XtX - S * St exactly
and only then divides and decomposes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.textblocks import lean, lists, stored

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Rows multiplied at a time.
BLOCK_ROWS = 8192
#: Limbs of a sum: 7 of 32 bits hold the squares of 65-bit numbers over 2**60 rows.
LIMBS, LIMB_BITS = 7, 32
#: Dimensions at most: the scatter that the driver decomposes has their square.
MOST_DIMENSIONS = 4096
LONGS = range(-(2**63), 2**63)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(c: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset as 64-bit integers; what does not fit becomes the nearest that does."""
    with np.errstate(over="ignore"):
        y = np.floor(c * scale)
    small = np.abs(y) < 2.0**62
    x = np.where(small, y, 0).astype(np.int64) + offset
    if not small.all():
        x[~small] = [min(max(int(v) + offset, LONGS[0]), LONGS[-1]) for v in np.clip(y[~small], -(2.0**64), 2.0**64)]
    return x


def less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, in Python's integers where 64 bits may not hold it."""
    top = max(abs(int(f(a))) for f in (np.min, np.max) for a in (x, shift))
    return x - shift if top < 1 << 61 else x.astype(object) - shift.astype(object)


def cross_products(y: np.ndarray) -> np.ndarray:
    """yT @ y, exact, as Python's integers."""
    top = max(abs(int(y.min())), abs(int(y.max())), 1)
    rows = (1 << 53) // (top * top)
    if rows >= min(len(y), 256):  # so many products can be added in doubles without rounding
        total = np.zeros((y.shape[1],) * 2, object)
        for low in range(0, len(y), rows):
            f = y[low : low + rows].astype(float)
            total += (f.T @ f).astype(np.int64).astype(object)
        return total
    if top * top * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    y = y.astype(object)
    return y.T @ y


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Python's integers as limbs, lowest first; the last one has the sign."""
    mask = (1 << LIMB_BITS) - 1
    return [np.array([int(v >> LIMB_BITS * k) & mask if k < LIMBS - 1 else int(v >> LIMB_BITS * k) for v in values], np.int64) for k in range(LIMBS)]


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: rows, exact sums, and the first components with their variances.

    ``components`` has one column each; ``flat`` marks directions without variance.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    flat: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def dimension(rows: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length of the usable vectors, the longer of two; 0 without any."""
    v = F.col(f"`{vector}`")
    found = rows.where(usable(v)).groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if found and found["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    return found["d"] if found else 0


def _part(rows: DataFrame, vector: str, d: int) -> DataFrame:
    v = F.col(f"`{vector}`")
    return rows.where(usable(v) & (F.size(v) == d))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, d)


def scatter(rows: DataFrame, d: int, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of the usable vectors of length ``d`` as integers, exact."""

    def run(batches: Iterator[pa.RecordBatch]):
        n, shift = 0, np.zeros(0, np.int64)
        sums, cross = np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            x = integers(_matrix(b.column(0), d), scale, offset)
            for low in range(0, len(x), BLOCK_ROWS):
                block = x[low : low + BLOCK_ROWS]
                if not n:
                    shift = np.clip(np.round(block.astype(float).mean(0)), -(2.0**62), 2.0**62).astype(np.int64)
                y = less(block, shift)
                n += len(y)
                sums += y.astype(object).sum(0) if y.dtype == object or abs(y).max() > (1 << 62) // len(y) else y.sum(0).astype(object)
                cross += cross_products(y)
        if not n:
            return
        m = shift.astype(object)
        cross += np.outer(m, sums) + np.outer(sums, m) + n * np.outer(m, m)
        sums += n * m
        i, j = np.triu_indices(d)
        places = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
        numbers = limbs(np.concatenate([np.array([n], object), sums, cross[i, j]]))
        yield pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int32)) for p in places), *map(pa.array, numbers)], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    kinds = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = _part(rows, vector, d).select(F.col(f"`{vector}`").cast("array<double>")).mapInArrow(lean(run), kinds)
    n, sums, cross = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, *own in parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect():  # d * (d + 3) / 2 + 1 rows
        value = sum(limb << LIMB_BITS * k for k, limb in enumerate(own))
        if j < 0:
            n = value
        elif i < 0:
            sums[j] = value
        else:
            cross[i][j] = cross[j][i] = value
    return n, sums, cross


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening of all usable vectors of the most frequent length; None without any.

    The covariance has divisor n.  Components are unit eigenvectors by falling eigenvalue; the entry
    of each that is largest in size is positive.
    """
    d = dimension(rows, vector)
    if not d:
        return None
    n, sums, cross = scatter(rows, d, vector, scale, offset)
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact])  # quotients of integers, rounded once
    trace = sum(exact[i][i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), vectors, values, values / trace if trace else np.full(len(values), np.nan), values <= trace * d * 2.0**-50)


def transform(rows: DataFrame, model: Whitening, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, deviation decimal(38,0), whitened array<double> and the columns in ``keep`` of each usable vector of the model's length.

    ``deviation`` is the sum of (n * x - S)**2, exact (null from 10**38 on).  ``whitened`` has (x - S / n)
    projected on each component over the root of its variance; null where a direction has no variance.
    """
    d, n = model.dimensions, model.n
    middle = [(2 * s + n) // (2 * n) for s in model.sums]  # the integer nearest the mean
    rest = [s - n * m for s, m in zip(model.sums, middle, strict=True)]
    shared = rows.sparkSession.sparkContext.broadcast((np.array(middle, np.int64), rest, model.components, model.values, model.flat))
    own = _part(rows, vector, d).select(F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{id}`").alias(id), *(F.col(f"`{c}`") for c in keep))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]):
        middle, rest, components, values, flat = shared.value
        for b in batches:
            for low in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(low, BLOCK_ROWS)
                y = less(integers(_matrix(part.column(0), d), scale, offset), middle)
                top = max(abs(int(y.min())), abs(int(y.max()))) * n + max(map(abs, rest))
                apart = y.astype(object) * n - np.array(rest, object) if top >= 1 << 62 else y * n - np.array(rest, np.int64)
                if top * top * d < 1 << 63:
                    deviation = pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (apart.astype(object) ** 2).sum(1)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                white = (apart / n).astype(float) @ components / np.sqrt(np.where(flat, 1.0, values))
                values_of = pa.array(white.ravel(), mask=np.tile(flat, len(white)))
                ends = pa.array(np.arange(0, white.size + 1, len(values), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], deviation, pa.ListArray.from_arrays(ends, values_of)], [*part.schema.names[1:], "deviation", "whitened"])

    return own.mapInArrow(lean(run), f"{kinds}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest entry, by size, of the covariance of ``whitened`` (centred, divisor n) minus the identity; null without varying directions."""
    some = [k for k in range(len(model.values)) if not model.flat[k]]
    pairs = [(a, b) for a in some for b in some if a <= b]
    if not pairs:
        return None
    at = lambda k: F.get("whitened", F.lit(k))
    found = whitened.agg(*(F.covar_pop(at(a), at(b)) for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n, deviation, whitened, explained (an array of shares of the trace), identity_error, and the columns in ``keep``.

    Vectors that are null or empty, or hold null or non-finite entries, take no part, nor do those of
    another length than the most frequent one.  Repeated rows and rows with a null id count like
    any others.  An entry whose integer does not fit in 64 bits takes the nearest that does.
    No usable vector: no row.  One vector, or equal ones: no direction varies, so whitened entries,
    explained and identity_error are null.  Columns that are not asked for are ignored.
    """
    model = fit(rows, vector, components, scale, offset)
    if model is None:
        source = rows.where("false").select(F.col(f"`{id}`").alias(id), *(F.col(f"`{c}`") for c in keep))
        kinds = {"n": "long", "deviation": "decimal(38,0)", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
        return source.select("*", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    out = stored(transform(rows, model, id, vector, scale, offset, keep), "whitened")
    error = identity_error(out, model)
    explained = F.array(*(F.lit(None if np.isnan(v) else float(v)).cast("double") for v in model.explained))
    return out.select(id, *keep, F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
