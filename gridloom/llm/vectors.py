"""Vector tables as fixed-width binary rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of float64 rows as a matrix."""
    from .common import text_buffer

    return text_buffer(column)[0].view(np.float64).reshape(-1, width)


def dense(df: DataFrame, id_col: str, vec_col: str, change: Callable[[np.ndarray], np.ndarray] | None = None, drop_zero: bool = False) -> tuple[DataFrame, int]:
    """(uid, id, v) and the width: v holds the vector's doubles, padded with zeros to the longest vector.

    Vectors that are null, or hold null or non-finite components, take no part (``drop_zero``: zero ones neither). ``uid``
    is only stable once written. ``change`` maps the matrix before it is stored.
    """
    width = df.agg(F.max(F.size(vec_col))).first()[0] or 0
    width = max(1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rows.flatten().cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
            full = np.zeros((len(rows), width))
            full[np.arange(width)[None, :] < lengths[:, None]] = values
            good = np.isfinite(full).all(1) & rows.is_valid().to_numpy(zero_copy_only=False)
            if drop_zero:
                good &= full.any(1)
            full = full[good]
            if change:
                full = np.ascontiguousarray(change(full), np.float64)
            at = pa.array(np.flatnonzero(good))
            offsets = np.arange(len(full) + 1, dtype=np.int32) * (8 * width)
            v = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(full.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), v], names=["uid", "id", "v"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, f"uid long, id {kind}, v binary")
    return out, width


def nodes_of(vectors: DataFrame) -> DataFrame:
    """v, node: each distinct vector of vectors (uid, id, v) with its least uid."""
    return vectors.groupBy("v").agg(F.min("uid").alias("node"))


def members_of(vectors: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, uid, id: of each distinct vector's rows the ``n`` with the least ids; no others can be among n results."""
    by_id = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last(), "uid")
    return vectors.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= n).join(nodes, "v").select("node", "uid", "id")


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer-valued matrices, exactly, held to the range of a long."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    out = [min(max(sum(int(x) * int(y) for x, y in zip(r, s, strict=True)), -(2**63)), 2**63 - 1) for r, s in zip(a, b, strict=True)]
    return np.array(out, np.int64)
