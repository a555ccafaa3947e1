"""Vectors in transit: unit vectors as short integers with one scale, so a shuffle moves a half or a quarter of the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key string, vector): rows with a key and a vector that has a direction.

    Null keys, null or empty vectors, vectors with null, NaN or infinite parts and zero vectors are left out.
    """
    return df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("vec")).where("id IS NOT NULL AND size(vec) > 0")


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be compared, their unit vectors as float32) of a list column; lists of another length than most are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if not len(lengths) or lengths.max() == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.float32)
    dim = int(np.bincount(lengths[lengths > 0]).argmax())
    rows = np.flatnonzero(lengths == dim)
    if len(rows) != len(column):
        column = column.take(pa.array(rows))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    norm = np.linalg.norm(flat.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (flat[good] / norm[good, None]).astype(np.float32)


def pack(unit: np.ndarray, bits: int) -> pa.Array:
    """Rows as binary: a float32 scale, then integers of 8 or 16 bits. The error of a cosine is about 5e-4 or 2e-6."""
    kind, top = (np.int8, 127) if bits == 8 else (np.int16, 32767)
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-12).astype(np.float32)
    body = np.rint(unit / scale[:, None] * top).astype(kind)
    joined = np.concatenate([scale[:, None].view(np.uint8).reshape(len(unit), 4), body.view(np.uint8).reshape(len(unit), -1)], axis=1)
    width = joined.shape[1]
    offsets = pa.py_buffer((np.arange(len(unit) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(unit), [None, offsets, pa.py_buffer(np.ascontiguousarray(joined).tobytes())])


def unpack(column: pa.Array, bits: int) -> np.ndarray:
    """The unit vectors of a packed column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = int(offsets[1] - offsets[0])
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)
    body = np.ascontiguousarray(raw[:, 4:]).view(np.int8 if bits == 8 else np.int16).astype(np.float32)
    return body / np.maximum(np.linalg.norm(body, axis=1, keepdims=True), 1e-12)


def bounded_sample(df: DataFrame, n: int, most: int, seed: int = 42) -> np.ndarray:
    """Unit vectors of about ``most`` rows, never more, chosen and ordered by a hash of the id; ``n``: rows of ``df``.

    Rows are drawn for a fiftieth less than ``most``, so that hardly ever one has to be left out; no row is shuffled.
    """
    share = min(1.0, 0.98 * most / max(n, 1))
    mark = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    got = df.select(mark.alias("mark"), "vec").where(F.col("mark") < int(share * (1 << 40)) + 1).toArrow()
    order = np.argsort(got.column("mark").to_numpy(), kind="stable")[:most]
    return matrix(got.column("vec").take(pa.array(order)))[1]
