"""Chunks cut where their content says so, and vectors reused by content.

A cut falls after a place where a rolling hash of the last ``WINDOW`` letters has its low bits zero, at least ``MIN_SIZE``
letters after the cut before it, and at ``MAX_SIZE`` letters at the latest.  The hash sees only those letters, so an
insertion moves the cuts in its neighbourhood and the rest of the document keeps its chunks.  A chunk is known by its
text's hash: only chunks that no document had before are encoded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, MIN_SIZE, MAX_SIZE = 32, 200, 1000
MASK = (1 << 8) - 1  # one place in 256 is a candidate
_CHUNKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


def candidates(text: str) -> np.ndarray:
    """Places (letters before the cut) whose last WINDOW letters ask for a cut."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(letters) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[j: j + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    return np.flatnonzero((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) & np.uint64(MASK) == 0) + WINDOW


def cut_points(text: str) -> list[int]:
    """Ends of the chunks of a text; the last one is its length."""
    places, at, cuts = candidates(text), 0, []
    while len(text) - at > MAX_SIZE:
        i = int(np.searchsorted(places, at + MIN_SIZE))
        at = int(places[i]) if i < len(places) and places[i] <= at + MAX_SIZE else at + MAX_SIZE
        cuts.append(at)
    return [*cuts, len(text)] if len(text) > at else cuts


def chunk_by_content(docs: DataFrame, *, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, chunk_no, start, text, chunk_id): the chunks of a document put together are its text; a null or empty
    text has none.  Narrow: no shuffle."""

    @F.pandas_udf(_CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            ends = cut_points(t) if t else []
            return [{"start": a, "text": t[a:b]} for a, b in zip([0, *ends], ends)]

        return texts.map(one)

    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(cut(F.col(text))).alias("chunk_no", "c"))
    return rows.select("doc", "chunk_no", F.col("c.start").alias("start"), F.col("c.text").alias("text"), F.sha2("c.text", 256).alias("chunk_id"))


def unseen_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, text) of chunks that ``vectors`` (chunk_id, embedding) lacks, each once."""
    return chunks.select("chunk_id", "text").join(vectors.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The index: every chunk with the vector of its content."""
    return chunks.join(vectors, "chunk_id")
