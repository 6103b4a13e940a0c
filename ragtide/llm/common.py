"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
BATCH_ROWS = 500  # documents of an Arrow batch: a batch of very long texts still fits a worker


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder, by a path that only Spark needs to open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``materialize``, in Parquet files: for tables whose size counts, as checkpoints are not compressed."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    path = f"{root}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the needed columns under names that no operator uses, and what gives a result
    with these columns its own names and order back."""
    names = {n: n if n in needed else f"kept_{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda out: out.select(*(F.col(inner).alias(n) for n, inner in names.items()))


def row_key(text: str = "text"):
    """64-bit key of a row's text: with the id it names the row even where an id repeats."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast that carries this package's classes by value, as tasks need no installed copy of it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    return pickle.loads(sent.value)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, whatever task asks for it."""
    home = sys.modules.setdefault("_ragtide_worker_cache", types.ModuleType("_ragtide_worker_cache"))
    return home.__dict__.setdefault(name, {})


def drop_caches() -> None:
    """Let go what tasks of earlier operators keep in this worker."""
    sys.modules.setdefault("_ragtide_worker_cache", types.ModuleType("_ragtide_worker_cache")).__dict__.clear()


def slices(texts: list[str | None], most: int = 4 << 20) -> Iterator[slice]:
    """Stretches of the texts of about ``most`` letters, so that working memory doesn't hang on text lengths."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield slice(at, i + 1)
            at, size = i + 1, 0


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def flushed(rows: list, schema: pa.Schema, at: int = 2000) -> Iterator[pa.RecordBatch]:
    """Emit and clear ``rows`` (tuples in schema order) once there are ``at`` of them."""
    if rows and len(rows) >= at:
        yield record(schema, *zip(*rows))
        rows.clear()
