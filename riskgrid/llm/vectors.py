"""What the vector operators share: which vectors count, and how arrays come from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from riskgrid.llm.shared import ship


def usable(vector: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row's bytes."""
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


def unpacked(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The inverse of ``packed``."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1) if cells else np.zeros((0, 0), dtype)


ship(__name__)
