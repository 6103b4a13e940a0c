"""Product codes of vectors, fitted and assigned exactly on metric trees.

Each block of rows holds one anchors-hierarchy tree for every part position (``metric_tree``); blocks are built
once and kept as a table.  A round sends the codebooks to the blocks: inherited candidate lists shrink until a ball is
wholly owned and gives its cached sum and count, so that only (part, entry, position) sums leave a task.
All arithmetic that decides a result is in integers.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.llm.common import materialize, small_batches
from ragtide.llm.metric_tree import Tree
from ragtide.llm.vectors import matrix, on_grid

BLOCK = 4096  # rows that share trees
BROADCAST_LABELS = 100_000  # sums by label are sent to every task up to so many labels, joined by label beyond
PART_ROWS = "part int, entry int, place int, total decimal(38,0), members long"


def tree_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(vec_id array, label array, trees): blocks of up to BLOCK rows, trees pickled by part position."""
    types = [rows.schema[c].dataType for c in ("vec_id", "label")]
    schema = T.StructType([T.StructField("vec_ids", T.ArrayType(types[0])), T.StructField("labels", T.ArrayType(types[1])), T.StructField("trees", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                trees = [Tree(np.ascontiguousarray(p)).plain() for p in np.split(x, parts, axis=1)]
                whole = pa.array([0, len(x)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, batch.column(0)), pa.ListArray.from_arrays(whole, batch.column(1)),
                                                  pa.array([pickle.dumps(trees)], pa.binary())], names=schema.names)

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def refit(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floor of the mean of the parts nearest to it; unused entries stay.

    What reaches the driver is a sum for each component of the codebooks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(c.shape, dtype=object), np.zeros(len(c), dtype=object)) for c in codebooks]
        for trees in _trees(batches):
            for (sums, counts), state, entries in zip(total, trees, codebooks):
                _, s, n, _ = Tree.of(state).nearest(entries)
                sums += s
                counts += n
        rows = [(p, e, i, sums[e, i], counts[e]) for p, (sums, counts) in enumerate(total) for e in np.flatnonzero(counts) for i in range(sums.shape[1])]
        if rows:
            part, entry, place, value, members = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.array(entry, dtype=np.int32)), pa.array(place, pa.int32()),
                                              pa.array([int(v) for v in value], pa.decimal128(38, 0)), pa.array([int(v) for v in members], pa.int64())],
                                             names=["part", "entry", "place", "total", "members"])

    sums = blocks.select("trees").mapInArrow(run, PART_ROWS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    new = [c.copy() for c in codebooks]
    for r in sums.collect():
        new[r.part][r.entry, r.place] = int(r.total) // r.members
    return new


def assigned(blocks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): numbers of the nearest entries in two hex digits each, squared distances summed."""
    types = [blocks.schema[c].dataType.elementType for c in ("vec_ids", "labels")]
    schema = T.StructType([T.StructField("vec_id", types[0]), T.StructField("label", types[1]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(_trees([batch])):
                codes, error = [], 0
                for state, entries in zip(trees, codebooks):
                    tree = Tree.of(state)
                    code, *_ = tree.nearest(entries)
                    gap = tree.points - entries[code]
                    codes.append(code[tree.row_of])
                    error = error + (gap * gap).sum(1)[tree.row_of]
                text = [bytes(r).hex() for r in np.array(codes, dtype=np.uint8).T.copy()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=schema.names)

    return blocks.mapInArrow(run, schema)


def _trees(batches) -> Iterator[list]:
    for batch in batches:
        for state in batch.column(batch.schema.get_field_index("trees")):
            yield pickle.loads(state.as_py())


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of every vector and the codebooks (a matrix of longs for each part position).

    The first codebooks are the parts of the ``entries`` smallest vec_ids (nulls last; equal ids by vector; fewer rows
    give fewer entries).  Rows are (vec_id, label, code, error); repeated rows stay, a table without ``label``
    counts as null labels, and ``on_grid`` says which rows take no part.  An empty table gives no rows and no
    entries.  A dimension that ``parts`` doesn't divide is a ValueError, as is more than 256 entries.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    spark = vectors.sparkSession
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    rows = on_grid(vectors, scale)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    if first and len(first[0].x) % parts:
        raise ValueError(f"vectors of {len(first[0].x)} components can't be cut into {parts} equal parts")
    codebooks = [np.ascontiguousarray(c) for c in np.split(np.array([r.x for r in first], dtype=np.int64), parts, axis=1)] if first else []
    small_batches(spark, BLOCK)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(tree_blocks(rows.repartition(tasks), parts))
    for _ in range(rounds if first else 0):
        codebooks = refit(blocks, codebooks)
    return assigned(blocks, codebooks), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in order of part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for c in codebooks for v in c.ravel()).encode()).hexdigest()


def code_report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``compress``; label_error sums error over equal labels, nulls together."""
    codes, codebooks = compress(vectors, **options)
    codes = materialize(codes)
    sums = materialize(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    sums = sums.withColumnRenamed("label", "of_label")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
