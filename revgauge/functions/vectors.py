"""Vectors are arrays of numbers, computed in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from revgauge.functions.binding import once


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_vector_text(text) -> Column:
    """``"[0.1 0.2 ...]"``, also over several lines, to an array of doubles."""
    flat = F.translate(_col(text), "[]\n\r\t", "     ")
    return F.array_remove(F.split(flat, r"\s+"), "").try_cast("array<double>")


def format_vector(v) -> Column:
    return F.concat(F.lit("["), F.array_join(_col(v).cast("array<string>"), " "), F.lit("]"))


def dot(a, b) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scale(v, factor) -> Column:
    """A missing factor gives a missing vector."""
    factor = F.lit(float(factor)) if isinstance(factor, (int, float)) else _col(factor)
    v = _col(v)
    return once(factor, lambda f: F.when(f.isNotNull(), F.transform(v, lambda x: x.cast("double") * f)))


def unit(v) -> Column:
    """Length 1; a zero vector has no direction and becomes NULL."""
    return once(v, lambda w: scale(w, F.try_divide(F.lit(1.0), l2_norm(w))))


def matrix_of(array: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one matrix; an empty or missing list is a row of NaN."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    lengths = np.asarray(array.value_lengths().fill_null(0))
    if len(lengths) and not np.isin(lengths, (0, width)).all():
        raise ValueError(f"vectors must have {width} numbers")
    out = np.full((len(array), width), np.nan)
    out[lengths > 0] = array.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)
    return out


def list_array(matrix: np.ndarray, missing: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype="int32") * width
    values = pa.array(np.ascontiguousarray(matrix).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(missing))


def dots_with(v, fixed: np.ndarray) -> Column:
    """Dot products with each row of a small fixed matrix, as an array in row order.

    A missing vector, or one with NaN, has no products (NULL). One matrix product per Arrow batch; measured several times faster than nested array functions on 384 numbers.
    """
    width = fixed.shape[1]
    right = np.ascontiguousarray(fixed.T, dtype="float64")

    @arrow_udf("array<double>")
    def product(vectors: pa.Array) -> pa.Array:
        rows = matrix_of(vectors, width)
        return list_array(rows @ right, np.isnan(rows).any(axis=1))

    return product(_col(v))
