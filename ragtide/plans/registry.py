"""Registry of named queries: (spark, sf_dir) -> DataFrame, each with its SQL oracle.

Every registered query reads the whole driver tables (or data Spark derives
from them).  The oracle is an independent ANSI SQL statement over the same
tables; ``None`` marks a query with no SQL form (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ARROW_ROWS = "1024"  # rows of one Arrow batch
REGISTRY: dict[str, Query] = {}


def normalize_types(df: DataFrame) -> DataFrame:
    """INT/SHORT -> BIGINT and FLOAT -> DOUBLE so both engines report one type per column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # interaction times are naive UTC: keep window alignment and formatting in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # a Python worker holds an Arrow batch several times over: long texts and vectors go in small batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
            return normalize_types(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql.strip() if sql else None)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills REGISTRY.
    from ragtide.plans import (  # noqa: F401
        q_retrieval, q_elements, q_chunks, q_judge, q_evaluate, q_ingest, q_monitor, q_sessions,
        q_streaming, q_io,
    )

    return REGISTRY
