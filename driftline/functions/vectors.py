"""Vector functions as Catalyst expressions; sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z = lambda: F.lit(0.0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), Z(), lambda s, x: s + x)


def int_dot(a: Column, b: Column) -> Column:
    """Exact inner product of quantised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once: what stands in a lambda's body is evaluated anew for each element, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), Z(), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return bound(norm(v), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v)))


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), F.abs))


def scale_of(v: Column) -> Column:
    """The step of 8-bit quantisation: largest absolute value / 127."""
    return max_abs(v) / F.lit(127.0)


def quantize(v: Column) -> Column:
    """Components in steps of ``scale_of``, rounded half away from zero and held within +-127; all zero for a zero vector."""
    clamp = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x))
    return bound(scale_of(v), lambda s: F.transform(doubles(v), lambda x: F.when(s > 0, clamp(F.round(x / s))).otherwise(F.lit(0.0)).cast("tinyint")))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def is_finite(v: Column) -> Column:
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_query(v: Column, dim: int) -> Column:
    """A vector that a request may carry: of the index's dimension, finite; zero vectors mean no taste yet."""
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(is_finite(v), F.lit(False))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(raw):
    """Little-endian 32-bit floats from bytes (no built-in reinterprets bytes); null if the length is no multiple of four."""
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def encode_f32(v):
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.BinaryType())
def encode_i8(v):
    return v.map(lambda x: None if x is None else np.asarray(x, "i1").tobytes())


def heat_limit(v: Column) -> Column:
    """The 98th percentile of absolute values by place: element floor(0.98 n) of the sorted ones, else the largest, else 1."""

    def limit(a: Column) -> Column:
        at, top = F.get(a, F.floor(F.size(a) * 0.98).cast("int")), F.array_max(a)
        return F.coalesce(F.when(at > 0, at), F.when(top > 0, top), F.lit(1.0))

    return bound(F.array_sort(F.transform(doubles(v), F.abs)), limit)


def clipped(v: Column) -> Column:
    """How many components are beyond ``heat_limit``."""
    return bound(heat_limit(v), lambda top: F.size(F.filter(doubles(v), lambda x: F.abs(x) > top)))
