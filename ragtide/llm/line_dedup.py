"""Line deduplication over a whole corpus by sorted hashes.

Method: every line key is hashed to 128 bits; the (hash, document) rows are
range-partitioned by hash and document with a secondary sort, so that even one line
found in a third of all documents spreads over many tasks.  Each task streams its
sorted rows, keeps the first document of every key and emits the line positions that
the other documents lose.  Keys whose rows continue in a neighbouring partition (at
most two per partition) are settled by a table of partition edges.  What travels is
never text: documents get back a zlib-compressed bitmap of the lines they keep.

Defined results: a null or empty text is one empty line; repeated rows of one id count
as one document and each keeps its own bitmap; a row with a null id neither counts nor
loses lines; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import ASCII_LOWER, column, flushed, materialize, record, row_key, shielded

BLANKS = "\t\n\x0b\x0c\r "
_ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()),
                   ("n", pa.int64()), ("at", pa.binary())])
_EDGE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("first", pa.int64())])
_DROP = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("at", pa.binary())])


def line_key(line: str) -> str:
    return line.strip(BLANKS).translate(ASCII_LOWER)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per (line key, document): 128-bit hash and the positions of the line there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for doc, row, text in zip(column(batch, "doc"), column(batch, "row"), column(batch, "text")):
                lines = text.split("\n")
                found: dict[str, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        found.setdefault(key, []).append(i)
                for key, at in found.items():
                    h = struct.unpack("<qq", hashlib.blake2b(key.encode(), digest_size=16).digest())
                    out.append((*h, doc, row, len(lines), np.array(at, "<u4").tobytes()))
            yield from flushed(out, _ROWS, 1)

    plain = docs.where("doc is not null and text is not null").select("doc", "row", "text")
    return plain.mapInArrow(run, "h1 long, h2 long, doc long, row long, n long, at binary")


def _runs(batch: pa.RecordBatch):
    """Start and stop of each run of equal hashes; distinct documents in each."""
    h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    new_key = np.ones(len(h1), bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(new_key)
    return h1, h2, doc, start, np.append(start[1:], len(h1)), np.add.reduceat(new_doc.astype(np.int64), start)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition: documents counted here, first document."""
    first = last = None
    last_doc = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, start, stop, docs = _runs(batch)
        for k in dict.fromkeys((0, len(start) - 1)):
            key = (int(h1[start[k]]), int(h2[start[k]]))
            if last and last[0] == key:
                last[1] += int(docs[k]) - (k == 0 and int(doc[start[k]]) == last_doc)
            else:
                if last and first is None:
                    first = last
                last = [key, int(docs[k]), int(doc[start[k]])]
        last_doc = int(doc[-1])
    got = [x for x in (first, last) if x]
    yield record(_EDGE, [x[0][0] for x in got], [x[0][1] for x in got], [x[1] for x in got], [x[2] for x in got])


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Sort, stream the first occurrences, and return what the other documents lose."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    # the streams run twice over one fixed layout, so it is written once (lineage ends here too)
    ordered = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order, "row"))
    spec = "h1 long, h2 long, docs long, first long"
    shared = (ordered.select("h1", "h2", "doc").mapInArrow(_edges, spec)
              .groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("first").alias("first")))
    # at most two rows per partition, whatever the input: safe to hand to every task
    edge = {(r.h1, r.h2): (r.docs, r.first) for r in shared.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open key's rows while it has fewer than min_docs documents
        known: tuple | None = None  # the open key once it has that many: (key, first document)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            h1, h2, doc, start, stop, docs = _runs(batch)
            drop = np.zeros(len(doc), bool)
            for k in np.flatnonzero((docs >= min_docs)).tolist():
                drop[start[k]:stop[k]] = doc[start[k]:stop[k]] != doc[start[k]]
            for k in dict.fromkeys((0, len(start) - 1)):
                a, b, key = start[k], stop[k], (int(h1[start[k]]), int(h2[start[k]]))
                if key in edge:
                    total, top = edge[key]
                    drop[a:b] = (doc[a:b] != top) if total >= min_docs else False
                elif known and known[0] == key:
                    drop[a:b] = doc[a:b] != known[1]
                elif k == len(start) - 1:
                    if docs[k] >= min_docs:
                        known = (key, int(doc[a]))
                    else:
                        held = batch.slice(int(a))
            if drop.any():
                yield batch.filter(pa.array(drop)).select(["doc", "row", "n", "at"]).cast(_DROP)

    return ordered.mapInArrow(run, "doc long, row long, n long, at binary")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, keep) of every document that loses lines; ``keep`` is a zlib-compressed
    bitmap, one bit per line, set where the line stays.  ``row`` is ``row_key(text)``."""

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, dropped in zip(column(batch, "n"), column(batch, "gone")):
                bits = np.ones(n, np.uint8)
                for at in dropped:
                    bits[np.frombuffer(at, "<u4")] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.binary())], names=["doc", "row", "keep"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc"), row_key(text_col).alias("row"),
                        F.col(text_col).alias("text"))
    # range borders are sampled, so the hashes are written first rather than made twice
    lost = dropped_lines(materialize(hashed_lines(plain, min_chars)), min_docs)
    return (lost.dropDuplicates(["doc", "row", "at"]).groupBy("doc", "row")
            .agg(F.first("n").alias("n"), F.collect_list("at").alias("gone"))
            .select("doc", "row", "n", "gone").mapInArrow(bitmaps, "doc long, row long, keep binary"))


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """(kept text, lines, dropped lines) of one document and its bitmap."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(x for x, b in zip(lines, bits.tolist()) if b), len(lines), int(len(lines) - bits.sum())


def with_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus the column ``_keep`` (null: every line stays)."""
    marks = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    marks = marks.select(F.col("doc").alias("_doc"), F.col("row").alias("_row2"), F.col("keep").alias("_keep"))
    left = docs.withColumn("_row1", row_key(text_col))
    on = (left[id_col].cast("long") == marks["_doc"]) & (left["_row1"] == marks["_row2"])
    return left.join(marks, on, "left").drop("_doc", "_row1", "_row2")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``; all other columns as they were."""

    docs, restored = shielded(docs, id_col, text_col)
    marked = with_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            if batch.column(batch.num_columns - 1).null_count < batch.num_rows:
                texts = [text if keep is None else kept_lines(text, keep)[0] for text, keep in zip(cols[at].to_pylist(), column(batch, "_keep"))]
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return restored(marked.select(*docs.columns, "_keep").mapInArrow(run, docs.schema))


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_lines, n_dropped and the SHA-256 of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                            ("kept_sha256", pa.string())])
        for batch in batches:
            out: list = []
            for doc, text, keep in zip(column(batch, "doc_id"), column(batch, "text"), column(batch, "_keep")):
                kept, n, gone = kept_lines(text, keep)
                out.append((doc, n, gone, hashlib.sha256(kept.encode()).hexdigest()))
            yield from flushed(out, schema, 1)

    marked = with_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    return marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "_keep").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
