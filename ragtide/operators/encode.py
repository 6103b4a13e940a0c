"""Text encoders: deterministic feature hashing (default) and a pluggable model hook.

The default encoder is *lexical*: tokens ``[a-z0-9]+`` of the lower-cased text are
hashed (first 8 hex digits of md5, mod ``dim``) and counted.  It is reproducible in
any SQL engine, so retrieval over it can be checked exactly; it does not capture
meaning the way a trained sentence model does.

Plan shape: the dense count vector is computed in an Arrow-batched pandas UDF
that hashes each distinct token of a batch once (per-token hashing inside a SQL
lambda is interpreted, not code-generated, and was 5x slower); it is narrow, so
encoding a corpus is one scan with no shuffle.  The sparse long form
``(id, bucket, weight)`` stays relational: explode + hash aggregate whose partial
aggregate collapses each row's tokens before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384
TOKEN_PATTERN = "[a-z0-9]+"


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), F.lit(0))


def bucket_of(tok: Column, dim: int = DIM) -> Column:
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint") % F.lit(dim)


def buckets(text, dim: int = DIM) -> Column:
    return F.transform(tokens(text), lambda t: bucket_of(t, dim))


def sparse_vectors(df: DataFrame, ids: list[str], text: str = "text", dim: int = DIM) -> DataFrame:
    """E1 long form: (ids..., bucket, weight) with weight = token count in that bucket."""
    e = df.select(*ids, F.explode(tokens(text)).alias("_tok")).select(*ids, bucket_of(F.col("_tok"), dim).alias("bucket"))
    return e.groupBy(*ids, "bucket").agg(F.count(F.lit(1)).alias("weight"))


TEXTS_AT_ONCE = 256  # texts whose tokens a worker holds


def _hashed_counts(texts: pd.Series, dim: int) -> np.ndarray:
    """Token counts (texts x dim) of one Arrow batch, by slices: tokens take many times the room of their text."""
    parts = [_hashed_slice(texts.iloc[lo:lo + TEXTS_AT_ONCE], dim) for lo in range(0, len(texts), TEXTS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros((0, dim), dtype=np.int64)


def _hashed_slice(texts: pd.Series, dim: int) -> np.ndarray:
    """Token counts (texts x dim) of some texts; null has no tokens.

    Tokens are found with the same pattern on the lower-cased text; every distinct
    token of them is hashed once (md5, first 8 hex digits, mod ``dim``), then one
    ``np.bincount`` over (row, bucket) builds all vectors.
    """
    import hashlib
    import re

    tok = re.compile(TOKEN_PATTERN)
    per_row = [tok.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for row in per_row for w in row), dtype=np.int64)
    ub = np.fromiter((int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % dim for w in codes),
                     dtype=np.int64, count=len(codes))
    rows = np.repeat(np.arange(len(per_row), dtype=np.int64), [len(r) for r in per_row])
    flat = np.bincount(rows * dim + ub[ids], minlength=len(per_row) * dim) if len(ids) else \
        np.zeros(len(per_row) * dim, dtype=np.int64)
    return flat.reshape(len(per_row), dim)


def _hashing_udf(dim: int):
    """Dense count vector per text in one Arrow batch pass."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _dense(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_hashed_counts(texts, dim).astype(np.float64)))

    return _dense.asNondeterministic()  # called so, a filter on the vectors doesn't have them made a second time


def sparse_arrays(text: str = "text", dim: int = DIM) -> Column:
    """E1 sparse form within the row: struct of ``buckets`` (ascending) and ``weights`` (their token counts)."""

    @F.pandas_udf("buckets array<smallint>, weights array<int>")
    def _sparse(texts: pd.Series) -> pd.DataFrame:
        m = _hashed_counts(texts, dim)
        rows, cols = np.nonzero(m)
        cut = np.searchsorted(rows, np.arange(1, len(m)))
        return pd.DataFrame({"buckets": np.split(cols.astype(np.int16), cut), "weights": np.split(m[rows, cols].astype(np.int32), cut)})

    return _sparse.asNondeterministic()(F.col(text))  # as in ``_hashing_udf``


def count_vectors(df: DataFrame, text: str = "text", out: str = "vec", dim: int = DIM) -> DataFrame:
    """E1/E2 dense form: adds ``out`` = ARRAY<DOUBLE> of token counts per bucket (not normalised).

    Same tokens and buckets as ``sparse_vectors`` (checked against SQL through the
    retrieval queries).  Cosine over count vectors is dot / (|a| |b|), computed the
    same way in every engine.
    """
    return df.withColumn(out, _hashing_udf(dim)(F.col(text)))


def encode(df: DataFrame, text: str = "text", out: str = "vec",
           encoder: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Pluggable encoder: ``encoder(df, text, out)`` must add an ARRAY<DOUBLE> column ``out``.

    A trained model plugs in as an iterator pandas UDF that loads the model once per
    Python worker; the default is ``count_vectors``.  Questions and chunks must go
    through the same function so that they share one vector space (E2).
    """
    return (encoder or count_vectors)(df, text, out)
