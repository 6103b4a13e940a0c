"""Integer grids of embedding columns, shared by the vector operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2.0**28  # of a scaled component, so that integer arithmetic on a part of 32 components stays exact


def on_grid(vectors: DataFrame, scale: int, shift: int = 0, vector: str = "embedding", limit: float = LIMIT) -> DataFrame:
    """Column ``x`` of longs floor(scale * component) + shift beside ``vec_id`` and ``label``; others are left out.

    Rows whose vector is null, empty, or holds a null or non-finite component take no part; neither do
    vectors with a scaled component beyond ``limit`` (a value no embedding has, whose squares leave 64 bits),
    and vectors of another length than the table's most frequent one (the shorter of equally frequent ones).
    """
    c = F.col(vector)
    fit = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double") * scale) < F.lit(limit), F.lit(False)))
    keep = [F.col(n) for n in ("vec_id", "label") if n in vectors.columns]
    rows = vectors.where(c.isNotNull() & (F.size(c) > 0) & fit)
    sizes = rows.groupBy(F.size(c).alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    k = sizes[0].k if sizes else 0
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale) + F.lit(shift).cast("long"))
    return rows.where(F.size(c) == k).select(*keep, x.alias("x"))


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Rows of a list column as one matrix of longs (all lists have one length)."""
    col = batch.column(batch.schema.get_field_index(name))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), dtype=np.int64)
