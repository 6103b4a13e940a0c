"""Chunking: recursive character split (Arrow UDF), fixed windows (native), ids, stats, invariants.

Both splitters are narrow stages: every document is chunked in the task that
reads it; nothing is shuffled.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions.relational import with_scalars

# Fixed values that must equal the reference: chunk size 1000 characters, overlap 200,
# separators tried in this order: "\n\n", "\n", ".", " ", "".
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", ".", " ", ""]

CHUNK_TYPE = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("text", T.StringType()),
]))


# ------------------------------------------------------------------ recursive splitter

def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                separators: list[str] = SEPARATORS) -> list[tuple[int, int]]:
    """C1 contract as (start, end) spans of the text, blank ends cut off, blank spans left out.

    A stretch is cut before each occurrence of the first separator that it holds.  Pieces shorter
    than ``size`` are packed; a longer one is a stretch of its own for the remaining separators.
    """
    spans: list[tuple[int, int]] = []
    stretches = [(0, len(text), 0)]  # those still to cut, the next one last
    while stretches:
        a, b, level = stretches.pop()
        while level < len(separators) - 1 and separators[level] and text.find(separators[level], a, b) < 0:
            level += 1
        edges = _edges(text, a, b, separators[level])
        long = next((k for k in range(len(edges) - 1) if edges[k + 1] - edges[k] >= size), None)
        if long is None:
            spans += _packed(edges, size, overlap)
            continue
        spans += _packed(edges[: long + 1], size, overlap)
        if edges[long + 1] < b:  # what follows the long piece is cut by the same separator
            stretches.append((edges[long + 1], b, level))
        if level < len(separators) - 1:
            stretches.append((edges[long], edges[long + 1], level + 1))
        else:
            spans.append((edges[long], edges[long + 1]))
    return [x for x in (_without_blank_ends(text, a, b) for a, b in spans) if x[0] < x[1]]


def _edges(text: str, a: int, b: int, separator: str) -> list[int]:
    """Where the pieces of text[a:b] begin, and b."""
    if not separator:
        return list(range(a, b + 1))
    edges, at = [a], text.find(separator, a, b)
    while at >= 0:
        if at > a:
            edges.append(at)
        at = text.find(separator, at + len(separator), b)
    return edges + [b] if b > a else edges


def _packed(edges: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of neighbouring pieces of at most ``size``; the next run goes back by at most ``overlap``."""
    out, first = [], 0
    for k in range(1, len(edges)):
        if edges[k] - edges[first] > size and k - 1 > first:
            out.append((edges[first], edges[k - 1]))
            back = max(edges[k - 1] - overlap, edges[k] - size)
            first = min(k - 1, bisect.bisect_left(edges, back, first))
    if len(edges) > 1:
        out.append((edges[first], edges[-1]))
    return out


def _without_blank_ends(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip())


def chunk_recursive(docs: DataFrame, *, doc: str = "doc_id", text: str = "text",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """C1 over a document table -> chunks(doc, chunk_no, start, text, n_chars).

    An Arrow-batched pandas UDF returns ARRAY<STRUCT<start, text>> per document;
    ``posexplode`` turns it into rows.  Narrow: no shuffle.
    """
    @F.pandas_udf(CHUNK_TYPE)
    def _split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else
                         [{"start": a, "text": t[a:b]} for a, b in chunk_spans(t, size, overlap)])

    exploded = docs.select(F.col(doc).alias("doc"), F.posexplode(_split(F.col(text))).alias("chunk_no", "c"))
    return exploded.select("doc", "chunk_no", F.col("c.start").alias("start"), F.col("c.text").alias("text"),
                           F.length("c.text").alias("n_chars"))


def chunk_invariants(docs: DataFrame, chunks: DataFrame, *, doc: str = "doc_id", text: str = "text",
                     size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Violation counts of the C1 contract (all must be 0), checked with Spark expressions.

    Per chunk: longer than ``size``; not the substring of its document at its start;
    start not after the previous start; overlap with the previous chunk above ``overlap``;
    a non-blank character in the gap before it.  Per document: non-blank text after the
    last chunk, or a non-blank document with no chunk.  Chunk numbers are consecutive
    (``posexplode``), so neighbours are found by equi-joins.
    """
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("_t"))
    # previous / next chunk by equi-joins on (doc, chunk_no -/+ 1) rather than a window
    # partitioned by document, so AQE can split one very large document across tasks
    prev = chunks.select("doc", (F.col("chunk_no") + 1).alias("chunk_no"),
                         F.col("start").alias("_ps"), F.col("n_chars").alias("_pl"))
    nxt = chunks.select("doc", (F.col("chunk_no") - 1).alias("chunk_no"), F.lit(True).alias("_has_next"))
    c = (chunks.join(prev, ["doc", "chunk_no"], "left").join(nxt, ["doc", "chunk_no"], "left")
         .withColumn("_last", F.col("_has_next").isNull()))
    j = c.join(d, "doc")
    prev_end = F.coalesce(F.col("_ps") + F.col("_pl"), F.lit(0))
    gap = F.when(F.col("start") > prev_end, F.substring("_t", prev_end + 1, F.col("start") - prev_end)).otherwise("")
    tail = F.when(F.col("_last"), F.substring("_t", F.col("start") + F.col("n_chars") + 1, F.lit(1 << 30))).otherwise("")
    blank = r"^[\t\n\f\r ]*$"
    per_chunk = j.agg(
        F.count_if(F.col("n_chars") > size).alias("too_long"),
        F.count_if(F.substring("_t", F.col("start") + 1, F.col("n_chars")) != F.col("text")).alias("not_substring"),
        F.count_if(F.col("_ps").isNotNull() & (F.col("start") <= F.col("_ps"))).alias("not_increasing"),
        F.count_if(F.col("_ps").isNotNull() & (prev_end - F.col("start") > overlap)).alias("overlap_too_big"),
        F.count_if(~gap.rlike(blank) | ~tail.rlike(blank)).alias("uncovered"),
        F.count_if(F.col("text").rlike(blank)).alias("blank_chunks"),
    )
    chunked = chunks.select("doc").distinct()
    unchunked = d.join(chunked, "doc", "left_anti").agg(F.count_if(~F.col("_t").rlike(blank)).alias("docs_lost"))
    return with_scalars(per_chunk, unchunked)


# ------------------------------------------------------------------ fixed windows

def chunk_fixed(docs: DataFrame, *, doc: str = "doc_id", text: str = "text",
                size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` code points every ``size - overlap``; blank windows dropped.

    Pure expressions (sequence + substring + posexplode): no Python, no shuffle.  A chunk's row holds its own
    window only: rows that carry their whole document pile up in the queues of Python functions.
    """
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.length(F.col(text)), F.lit(1)), F.lit(step))
    windows = F.transform(starts, lambda s: F.substring(F.col(text), s, F.lit(size)))
    e = docs.select(F.col(doc).alias("doc"), F.posexplode(windows).alias("chunk_no", "text"))
    out = e.select("doc", "chunk_no", (F.col("chunk_no") * step).alias("start"), "text")
    return out.where(F.trim(F.col("text")) != "").withColumn("n_chars", F.length("text"))


# ------------------------------------------------------------------ ids, stats, balance

def chunk_id(doc="doc", chunk_no="chunk_no", text="text") -> F.Column:
    """C4: stable chunk identity, sha256 of (doc, chunk_no, text) joined by the unit separator."""
    return F.sha2(F.concat_ws("\u001f", F.col(doc).cast("string"), F.col(chunk_no).cast("string"), F.col(text)), 256)


def chunk_stats(docs: DataFrame, chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Total chunks and mean per document; documents without chunks count in the mean.

    Per-document counts are a partial aggregate; the left join keeps empty documents.
    """
    per_doc = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"))
    all_docs = docs.select(F.col(doc).alias("doc")).join(per_doc, "doc", "left")
    n = F.coalesce("_n", F.lit(0))
    return all_docs.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(n).alias("n_chunks"),
                        F.round(F.avg(n), 6).alias("chunks_per_document"),
                        F.count_if(n == 0).alias("documents_without_chunks"))


def exact_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of identical texts: keeper = smallest id, copies = the others.

    Hash aggregate on sha256(text): the partial aggregate runs before the shuffle, so a
    text copied a million times still moves one row per map task.
    """
    return docs.groupBy(F.sha2(F.col(text), 256).alias("text_sha256")).agg(
        F.min(doc).alias("keep_doc"), F.count(F.lit(1)).alias("n_copies")
    ).where(F.col("n_copies") > 1)
