"""Structured Streaming jobs: ingestion, daily quality, alerts, de-duplication, late data.

All sources declare their schema (mandatory for streams); all state is bounded by
a watermark or by the number of windows; every sink is idempotent per micro-batch
(foreachBatch overwrites a small complete result, or a file sink with its commit
log), so a restarted query from its checkpoint gives the same tables.
Checkpoint locations live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragtide.operators import ingest as I
from ragtide.operators import monitor as M
from ragtide.sources.derived import interaction_records
from ragtide.sources.tables import few_tasks

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def _run(query) -> list:
    query.awaitTermination()
    return query.recentProgress


def stream_ingest(spark: SparkSession, doc_dir: str, *, index_path: str, manifest_path: str, checkpoint: str,
                  to_chunks, doc_of_path, glob: str = "*.txt", text=None,
                  max_files: int | None = None) -> list:
    """New files in ``doc_dir`` -> ``ingest_batch`` per micro-batch (availableNow).

    The file source remembers the paths it has seen, so a file overwritten in place is
    not re-read: land uploads under versioned names, or run the batch delta on a schedule.
    ``doc_of_path``: Column expression on ``path`` giving the document key; ``text``: optional
    Column expression on ``content`` (default: UTF-8 decode); ``max_files``: files per micro-batch.
    """
    source = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    files = source.option("recursiveFileLookup", "true").load(doc_dir)

    def batch(df: DataFrame, batch_id: int) -> None:
        t = F.decode(F.col("content"), "UTF-8") if text is None else text
        raw = few_tasks(df).select(doc_of_path.alias("doc"), "path", F.md5(t).alias("fingerprint"), t.alias("text"))
        I.ingest_batch(df.sparkSession, raw, index_path=index_path, manifest_path=manifest_path,
                       to_chunks=to_chunks, detect_deletions=False)

    q = (files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return _run(q)


def _daily(stream: DataFrame, watermark: str) -> DataFrame:
    rec = interaction_records(stream)  # casts TIMESTAMP_NTZ to TIMESTAMP: withWatermark rejects NTZ
    return M.daily_quality(rec.withWatermark("ts", watermark))


def stream_daily_quality(spark: SparkSession, events_dir: str, schema: T.StructType, *, sink: str,
                         checkpoint: str, watermark: str = "1 day", alerts_sink: str | None = None,
                         reference: DataFrame | None = None) -> list:
    """T2 (+T3): daily quality from the log feed, complete mode, written by foreachBatch.

    The complete result is one row per day (bounded), overwritten each micro-batch.
    With ``reference`` (a static DataFrame of reference records) each batch also writes
    the alert rows of every window (stream-static join of one-row summaries).
    """
    daily = _daily(spark.readStream.schema(schema).parquet(events_dir), watermark)

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()  # else the second write would run the stateful batch again
        try:
            df.write.mode("overwrite").parquet(sink)
            if alerts_sink is not None and reference is not None:
                s = M.with_reference(df, reference)
                M.alerts(s, keys=["window_start"]).write.mode("overwrite").parquet(alerts_sink)
        finally:
            df.unpersist()

    q = (daily.writeStream.outputMode("complete").foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return _run(q)


def stream_daily_quality_closed(spark: SparkSession, events_dir: str, schema: T.StructType, *, sink: str,
                                checkpoint: str, watermark: str = "1 day") -> list:
    """T2, append mode: only windows closed by the watermark are emitted (file sink)."""
    daily = _daily(spark.readStream.schema(schema).parquet(events_dir), watermark)
    q = (daily.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return _run(q)


def stream_drift(spark: SparkSession, events_dir: str, schema: T.StructType, *, reference: DataFrame, sink: str, checkpoint: str,
                 cols: tuple[str, ...] = ("faithfulness", "overall"), raise_at: float = 0.2, clear_at: float = 0.1,
                 watermark: str = "1 day", max_files: int | None = None) -> list:
    """T3 as a stateful stream: drift of every day that the watermark closes, with an alert that has a memory.

    Two stateful steps.  Bin counts per (day, column) are aggregated by Spark and emitted when the watermark closes the day.
    Each column's closed days, in order, then meet its state: the alert goes up when the stability index exceeds ``raise_at`` and
    down only when it falls under ``clear_at``.  State is the counts of open days and one flag a column.  A day
    without any mark in a column gives no row for it and leaves the flag as it is.

    Rows: window_start, column_name, n, psi, js, alert (after that day), change ('raised', 'cleared' or null).  A restart
    from the checkpoint goes on with the flags and open days it left.
    """
    if clear_at > raise_at:
        raise ValueError("clear_at must not exceed raise_at")
    shares = M.reference_shares(reference, list(cols))
    source = spark.readStream.schema(schema)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    rec = interaction_records(source.parquet(events_dir)).withWatermark("ts", watermark)
    marks = rec.select("ts", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), M.unit_bin(F.col(c)).alias("bin")) for c in cols])).alias("m"))
    days = marks.where(F.col("m.bin").isNotNull()).groupBy(F.window("ts", "1 day").alias("w"), F.col("m.column_name").alias("column_name")).agg(
        *[F.count_if(F.col("m.bin") == i).alias(f"b{i}") for i in range(M.BINS)])
    closed = days.select(F.col("w.start").alias("window_start"), "column_name", F.array(*[f"b{i}" for i in range(M.BINS)]).alias("counts"))

    out = T.StructType.fromDDL("window_start timestamp, column_name string, n long, psi double, js double, alert boolean, change string")

    class Alerting(StatefulProcessor):
        """One flag a column: whether its alert is up."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.up = handle.getValueState("up", "up boolean")

        def handleInputRows(self, key, rows, timerValues):
            up = bool(self.up.get()[0]) if self.up.exists() else False
            got = pd.concat(list(rows)).sort_values("window_start")
            moved = []
            for day, counts in zip(got["window_start"], got["counts"]):
                psi, js = M.psi_js(shares[key[0]], [int(n) for n in counts])
                now = psi >= clear_at if up else psi > raise_at
                moved.append((day, key[0], int(sum(counts)), psi, js, now, None if now == up else "raised" if now else "cleared"))
                up = now
            self.up.update((up,))
            yield pd.DataFrame(moved, columns=out.names)

        def close(self) -> None:
            pass

    alerts = closed.groupBy("column_name").transformWithStateInPandas(Alerting(), out, "Append", "None")
    # arbitrary state needs this store; the setting is the session's again as soon as the query has started
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (alerts.writeStream.outputMode("append").format("parquet").option("path", sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return _run(q)


def stream_dedup(spark: SparkSession, events_dir: str, schema: T.StructType, *, sink: str, checkpoint: str,
                 key: str = "event_id", watermark: str = "1 hour") -> list:
    """T4: drop duplicate deliveries of the same event within the watermark (bounded state)."""
    s = spark.readStream.schema(schema).parquet(events_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    d = s.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    q = (d.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return _run(q)


def stream_late(spark: SparkSession, events_dir: str, schema: T.StructType, *, sink: str, checkpoint: str,
                watermark: str = "1 day", max_files: int | None = None) -> tuple[list, int]:
    """T5: windowed counts with a watermark; returns the progress and the number of rows dropped
    as later than the watermark.  ``max_files``: files per micro-batch (the watermark moves between them)."""
    source = spark.readStream.schema(schema)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    s = source.parquet(events_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = s.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    out = agg.select(F.col("w.start").alias("window_start"), "n")
    q = (out.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    progress = _run(q)

    def ops(p):
        return p["stateOperators"] if isinstance(p, dict) else p.stateOperators

    def dropped_of(op):
        return op["numRowsDroppedByWatermark"] if isinstance(op, dict) else op.numRowsDroppedByWatermark

    dropped = sum(dropped_of(op) for p in progress for op in ops(p))
    return progress, int(dropped)
