"""Vector expressions. All but the half-precision codec are built-in Spark functions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def safe_norm(v: Column) -> Column:
    """Euclidean norm, with 1 in place of 0 so that a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of ``v`` in double precision; a zero vector stays zero."""
    # The norm enters through a one-element array so that it is computed once per row
    # and not once per element.
    scaled = F.transform(
        F.array(safe_norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)
    )
    return F.element_at(scaled, 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b), in [0, 2]; a zero vector is at distance 1 from everything."""
    return F.lit(1.0) - dot(a, b) / (safe_norm(a) * safe_norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)


def to_float32(v: Column) -> Column:
    return v.cast("array<float>")


def vector_literal(values) -> Column:
    """A query vector as an array<float> literal."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<float>")


def half_encode(v: Column) -> Column:
    """array<float> to little-endian IEEE half floats, two bytes per element; null stays null."""

    def encode(column: pa.Array) -> pa.Array:
        known = column.drop_null()
        halves = as_matrix(known).astype("<f2")
        if not column.null_count:
            return as_binary(halves)
        place = np.cumsum(np.asarray(column.is_valid())) - 1
        return as_binary(halves).take(pa.array(place, mask=np.asarray(column.is_null())))

    return F.arrow_udf(encode, "binary")(v)


def half_decode(b: Column) -> Column:
    """The floats of half_encode; null stays null."""

    def decode(column: pa.Array) -> pa.Array:
        known = column.drop_null()
        if not len(known):
            return pa.nulls(len(column), pa.list_(pa.float32()))
        flat = fixed_width(known, len(known[0].as_py()))
        lists = as_lists(flat.view("<f2").astype(np.float32))
        if not column.null_count:
            return lists
        place = np.cumsum(np.asarray(column.is_valid())) - 1
        return lists.take(pa.array(place, mask=np.asarray(column.is_null())))

    return F.arrow_udf(decode, "array<float>")(b)


# -- Arrow <-> NumPy, for use inside tasks -------------------------------------------


def as_matrix(column) -> np.ndarray:
    """Arrow list column (no nulls, equal lengths) as an [n, dim] array without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        raise ValueError("a null vector cannot stand in a matrix")
    flat = column.flatten()
    ends = column.offsets.to_numpy()
    if n and (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("vectors in one table must all have the same dimension")
    if flat.null_count:
        raise ValueError("a vector holds null components")
    return flat.to_numpy(zero_copy_only=False).reshape(n, len(flat) // n if n else 0)


def fixed_width(column: pa.Array, width: int) -> np.ndarray:
    """Binary column of equal lengths (no nulls) as an [n, width] byte array, from its buffers."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError("codes in one table must all have the same length")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros((len(column), width), np.uint8)
    return np.frombuffer(data, np.uint8, len(column) * width, int(offsets[0])).reshape(-1, width)


def as_binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(matrix), buffers)


def with_vectors(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
    """The rows whose vector is not null. Done inside the task, since a filter on a column
    made by a Python encoder would run the encoder a second time."""
    column = batch.column(place)
    return batch.filter(column.is_valid()) if column.null_count else batch


def as_lists(matrix: np.ndarray) -> pa.Array:
    n, dim = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * dim
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def unit_rows(matrix: np.ndarray, dtype=np.float64) -> np.ndarray:
    m = matrix.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", m, m))
    lengths[lengths == 0] = 1.0
    m /= lengths[:, None]
    return m.astype(dtype, copy=False)


def screen_margin(dim: int) -> float:
    """Bound on the error of a float32 inner product of two unit vectors.

    Screening in float32 with this slack and re-checking in double loses no row.
    """
    return (dim + 16) * 2.0**-23


def cosine_distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the unit rows a[i] and b[j] in double, a bounded number at a time.

    Rounded to twelve decimals, so that copies tie exactly whatever block they fall in.
    """
    out = np.empty(len(i))
    for lo in range(0, len(i), 8192):
        part = slice(lo, lo + 8192)
        out[part] = 1.0 - np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    return np.round(out, 12) + 0.0
