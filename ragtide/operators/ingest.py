"""Incremental ingestion: delta against a manifest, replace-by-document reindex, manifest upsert.

Plan shape: every step is a hash join or anti join on the document key (one
shuffle by key), never a scan of the manifest per document.  The index is a
Parquet table that only grows: a batch appends the chunks of its changed documents as one
new version folder, whatever the size of the index.  The manifest says which version of a
document is current; readers keep the chunks of current versions, so replaced, emptied and deleted documents
vanish as soon as a delta is committed.  The manifest is a log of actions (``action_log``): a failed
batch leaves the last commit in place and is retried whole, a rerun on unchanged input writes nothing, and writers
that overlap take different versions and commit numbers.  ``compact`` rewrites the current chunks as one version from
time to time.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators import action_log as log
from ragtide.session import checkpoint_dir

MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("indexed_at", T.TimestampType()),
])

def changed_documents(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """New or modified documents — no manifest entry with the same (path, fingerprint)."""
    return raw.join(manifest.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def delta_status(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """New / modified / unchanged / deleted per path (full outer join on path)."""
    cur = raw.select("path", F.col("fingerprint").alias("_cur"))
    old = manifest.select("path", F.col("fingerprint").alias("_old"))
    j = cur.join(old, "path", "full_outer")
    status = (F.when(F.col("_old").isNull(), "new").when(F.col("_cur").isNull(), "deleted")
              .when(F.col("_cur") == F.col("_old"), "unchanged").otherwise("modified"))
    return j.select("path", status.alias("status"))


def skip_existing(docs: DataFrame, outputs: DataFrame, *, stem: str = "stem") -> DataFrame:
    """Documents whose parsed-text output does not exist yet (anti join on the stem)."""
    return docs.join(outputs.select(stem).distinct(), stem, "left_anti")


def reindex_replace(index: DataFrame, touched_docs: DataFrame, new_chunks: DataFrame, *, doc: str = "doc") -> DataFrame:
    """I4 (logical): drop every chunk of a touched document, add its new chunks.

    ``touched_docs`` holds the changed and the deleted documents; deleted ones simply
    get no new chunks.  Unlike an append, a modified document leaves no stale chunk.
    """
    kept = index.join(touched_docs.select(doc).distinct(), doc, "left_anti")
    return kept.unionByName(new_chunks)


def manifest_upsert(manifest: DataFrame, entries: DataFrame, *, drop_deleted: DataFrame | None = None) -> DataFrame:
    """K3: newest entry per path wins; optional tombstones remove deleted paths."""
    u = manifest.select(*MANIFEST_SCHEMA.names).unionByName(entries.select(*MANIFEST_SCHEMA.names))
    w = Window.partitionBy("path").orderBy(F.col("indexed_at").desc(), F.col("fingerprint").desc())
    out = u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    if drop_deleted is not None:
        out = out.join(drop_deleted.select("path").distinct(), "path", "left_anti")
    return out


# ------------------------------------------------------------------ manifest as JSON map

def manifest_to_json_shards(manifest: DataFrame, shard_size: int = 1000, *, key: str = "doc_id") -> DataFrame:
    """Boundary format of the reference (a JSON map path -> fingerprint), written in shards.

    One JSON object per block of ``shard_size`` consecutive ids, so no single row or
    task holds the whole manifest.
    """
    g = manifest.groupBy(F.floor(F.col(key) / shard_size).alias("shard")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "fingerprint")))).alias("value"))
    return g


def manifest_rows(json_shards: DataFrame, value: str = "value") -> DataFrame:
    """JSON map text -> (path, fingerprint) rows."""
    m = json_shards.select(F.explode(F.from_json(F.col(value), "map<string,string>")).alias("path", "fingerprint"))
    return m


# ------------------------------------------------------------------ physical index (K2) and the batch job

def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "ragtide-work", f"{name}-{uuid.uuid4().hex[:12]}")


def write_index(chunks: DataFrame, path: str, version: int = 0) -> None:
    """K2: chunk rows as one version of the index.  A retried batch overwrites its own version only."""
    chunks.write.mode("overwrite").parquet(f"{path}/version={version}")


def new_version() -> int:
    """A number for one version of the index that no other writer has."""
    return uuid.uuid4().int >> 66


def publish_manifest(manifest: DataFrame, path: str) -> int:
    """K3: documents (path, fingerprint, indexed_at, doc, version) as one commit of the log; returns its number."""
    return log.commit(manifest.sparkSession, path, log.actions(manifest))


def read_manifest(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The current documents (none if nothing was committed), or those after commit ``as_of``."""
    return log.state(spark, path, as_of)


def read_index(spark: SparkSession, index_path: str, manifest_path: str, *, doc: str = "doc", as_of: int | None = None) -> DataFrame:
    """Chunks of the current version of every document in the manifest, or of those after commit ``as_of``."""
    chunks = spark.read.parquet(index_path)
    current = read_manifest(spark, manifest_path, as_of).select(F.col("doc").cast(chunks.schema[doc].dataType).alias(doc), "version")
    return chunks.join(current, [doc, "version"], "left_semi").drop("version")


def compact(spark: SparkSession, index_path: str, manifest_path: str) -> int:
    """Rewrite the current chunks as one new version and commit it; returns the version.

    A commit that another writer makes meanwhile sends it back to the start: its actions hold for the state it read.
    Older versions stay for readers that began before; they can be deleted once those are done."""
    while True:
        at, version = log.newest(spark, manifest_path), new_version()
        write_index(read_index(spark, index_path, manifest_path, as_of=at), index_path, version)
        moved = read_manifest(spark, manifest_path, at).withColumn("version", F.lit(version))
        try:
            log.commit(spark, manifest_path, log.actions(moved), exactly=0 if at is None else at + 1)
            return version
        except log.Taken:
            continue


def ingest_batch(spark: SparkSession, raw: DataFrame, *, index_path: str, manifest_path: str,
                 to_chunks, now=None, detect_deletions: bool = True) -> int:
    """One incremental batch.  Returns the number of touched documents (0 = nothing written).

    ``raw``: (doc, path, fingerprint, text) of the current documents.  ``to_chunks``:
    DataFrame(doc, text) -> chunk rows (doc, chunk_no, ...), e.g. chunk + encode.
    Steps: delta -> chunks of the changed documents appended as a new version -> the delta committed to the log.
    ``detect_deletions=False`` for a stream micro-batch, which holds only the files that arrived, not the whole corpus.
    A document key has one current path: one that arrives under a new path leaves its old one, and a batch that holds
    a key under two paths is a ValueError, as nothing says which of them is meant.
    """
    twice = raw.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").limit(5).collect()
    if twice:
        raise ValueError("one document key under two paths: " + ", ".join(f"{r.doc} ({r.a}, {r.b})" for r in twice))
    manifest = read_manifest(spark, manifest_path).checkpoint()  # one state for the whole batch
    changed = changed_documents(raw, manifest).where(F.col("doc").isNotNull()).checkpoint()  # read several times
    gone = manifest.select("path").limit(0)
    if detect_deletions:
        gone = manifest.join(raw.select("path"), "path", "left_anti").select("path")
    n_touched = changed.count() + gone.count()
    if n_touched == 0:  # empty delta writes nothing (as the reference's early exit)
        return 0
    version = new_version()
    write_index(to_chunks(changed.select("doc", "text")), index_path, version)
    ts = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    entries = changed.select("path", "fingerprint", ts.alias("indexed_at"), F.col("doc").cast("string").alias("doc"),
                             F.lit(version).cast("long").alias("version"))
    moved = manifest.select("path", "doc").join(entries.select("doc", F.col("path").alias("_new")), "doc").where("path <> _new").select("path")
    removed = gone.unionByName(moved).distinct().join(entries.select("path"), "path", "left_anti")  # D14: forget deletions
    log.commit(spark, manifest_path, log.actions(entries, removed))
    return n_touched
