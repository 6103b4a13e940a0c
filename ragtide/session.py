"""Session helpers.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a
shared folder; we only read it.  A default is set only when it is unset
(local tests), and then under a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: keep Arrow batches small enough for Python workers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_session(master: str | None = None, app: str = "ragtide") -> SparkSession:
    """Return the active session, or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("RAGTIDE_MASTER", "local[8]"))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, which every executor must see.

    A scratch folder is set only where none is named and the session is local (tests, one machine).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="ragtide-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d
