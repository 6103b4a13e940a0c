"""Table sources: the driver's parquet tables and the file-based inputs.

``table(spark, sf_dir, name)`` is a plain ``spark.read.parquet`` so Catalyst
prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


SPREAD_MIN_BYTES = 256 << 10
SPREAD_MAX_BYTES = 64 << 20


def _input_bytes(df: DataFrame) -> int:
    sc = df.sparkSession.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        p = sc._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has slots.

    A Parquet file splits at row-group boundaries, so a small but CPU-heavy table (long
    texts) can arrive in a handful of partitions.  Below the default parallelism, and
    when the files hold at least ``SPREAD_MIN_BYTES`` (tiny tables are not worth a
    shuffle), the rows are dealt out to that many partitions.  Tables of more than
    ``SPREAD_MAX_BYTES`` are never shuffled for this, however many slots there are.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target or not SPREAD_MIN_BYTES <= _input_bytes(df) <= SPREAD_MAX_BYTES:
        return df
    return df.repartition(target)  # in turn: no key can be a hot spot, and unread columns stay unread


# ---------------------------------------------------------------- file sources

SPLITS_A_TASK = 250  # splits of small files that one task reads


def few_tasks(files: DataFrame) -> DataFrame:
    """A scan of many small files in as many tasks as its bytes fill.

    Spark counts a file as 4 MB at least (``spark.sql.files.openCostInBytes``) when it fills a split, so small files make a task
    for a few of them each.  Such splits are read one after the other by one task; large files are left as they are.
    """
    n = files.rdd.getNumPartitions()
    spark = files.sparkSession
    size = int(str(files._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    want = max(spark.sparkContext.defaultParallelism, math.ceil(n / SPLITS_A_TASK), math.ceil(size / split))
    return files.coalesce(want) if want < n else files


def scan_documents(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """List binary documents by extension without reading their bytes."""
    return few_tasks(
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "modificationTime", "length")
    )


def load_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row per file, with source and file name."""
    return few_tasks(spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("value").alias("text"),
    ))


INTERACTION_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("n_sources", T.LongType()),
        T.StructField("hit_ids", T.ArrayType(T.StringType())),
        T.StructField("faithfulness", T.DoubleType()),
        T.StructField("relevance", T.DoubleType()),
        T.StructField("completeness", T.DoubleType()),
        T.StructField("citation", T.DoubleType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("feedback", T.StringType()),
    ]
)


def read_interaction_logs(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """S3 (source half): JSON interaction records with a fixed schema.

    Windows are cut on the record's own ``ts`` by default; ``modified_after``
    ('YYYY-MM-DDTHH:mm:ss') instead skips files by last-modified time, the
    reference's behaviour (D15), without opening them.
    """
    r = spark.read.schema(INTERACTION_SCHEMA)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return r.json(path)


EVAL_SET_SCHEMA = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_keywords", T.ArrayType(T.StringType())),
    ]
)


def load_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation set stored as JSON arrays of {question, expected_keywords}; a question stored without
    its id gets one from its text."""
    return (
        spark.read.option("multiLine", True)
        .schema(EVAL_SET_SCHEMA)
        .json(path)
        .withColumn("qid", F.coalesce("qid", F.xxhash64("question")))
    )


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Open persisted chunk vectors instead of rebuilding them."""
    return spark.read.parquet(path)


def latest_snapshot(spark: SparkSession, path: str, version_col: str = "snapshot_id") -> DataFrame:
    """Rows of the newest published snapshot.

    The newest id comes from the partition column alone, so it costs a listing; as a literal it prunes
    the scan to one folder.
    """
    snapshots = spark.read.parquet(path)
    newest = snapshots.agg(F.max(version_col)).first()[0]
    return snapshots.where(F.col(version_col) == F.lit(newest))
