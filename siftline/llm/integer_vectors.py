"""Vectors as exact integers: the common ground of code compression and clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Components beyond this, scaled, would let squared distances of 64 components outgrow 63 bits.
LARGEST = 1 << 27
#: Values that a task looks at in one go.
_VALUES = 1 << 19


def largest(width: int | None) -> int:
    """The largest scaled component of vectors of a length: halved once for every fourfold of 64 components."""
    return LARGEST >> ((-(-(width or 1) // 64) - 1).bit_length() + 1) // 2


def integers(vector: Column, width: int | None = None) -> Column:
    """``floor(1024 * x)`` of every component as ``array<int>``; null where the vector can't be used.

    That is a null or empty vector, one with a null, NaN or infinite component, one of another length than ``width``,
    and one with a component beyond ``largest(width)``, whose distances wouldn't fit a long.
    """
    known = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < largest(width) / SCALE, F.lit(False)))  # false for NaN, too
    fits = F.size(vector) == width if width is not None else F.size(vector) > 0
    return F.when(vector.isNotNull() & fits & known, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int | None, *more: Column) -> DataFrame:
    """``(vec, ints, ...)`` of the usable rows."""
    made = vectors.select(F.col(id_col).cast("bigint").alias("vec"), integers(F.col(vector_col), width).alias("ints"), *more)
    return made.where("ints is not null")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of ``array<int>`` as 64-bit integers, a row for each vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def chunks(batch: pa.RecordBatch, width: int):
    """A batch in parts of bounded numbers of components."""
    step = max(1, _VALUES // max(1, width))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def sums_of(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of the rows of each group; a chunk's sums stay far below 2**53."""
    return np.stack([np.bincount(group, weights=column, minlength=groups) for column in rows.T], 1).astype(np.int64)


def joined(rows: np.ndarray) -> str:
    """All components in order, in decimal, joined by commas."""
    return ",".join(map(str, rows.ravel().tolist()))
