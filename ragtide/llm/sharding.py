"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of slots that never change; only bytes per slot are
aggregated (a table of ``n_slots`` rows, whatever the input), and the map from slot to
shard is a small versioned table.  Version 1 deals slots out in turn; every rebalancing
edits a copy: slots leave the heaviest shards for the lightest ones until no single
move makes the sizes more equal.  The law that holds is ``bytes``: shard sizes near equal.

Defined results: a null text has no bytes and the crc32 of nothing; a null id is hashed
like any value; equal rows share a slot and get neighbouring places there; an empty
table gives an empty result and a map all the same; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


OVERHEAD = 16  # bytes counted for a record besides its text


def sized(docs: DataFrame, n_slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [s % n_shards for s in range(n_slots)]


def rebalanced(shard_of: list[int], size_of: list[int], n_shards: int) -> list[int]:
    """An edited copy of the map with near equal bytes; slots move only where that helps.

    Shards above the mean release their largest slots that fit the excess; the released
    slots go, largest first, to the lightest shard; then the heaviest and the lightest
    shard swap or hand over slots while that narrows the gap between them.
    """
    shard_of = list(shard_of)
    load = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for s in sorted(range(len(shard_of)), key=lambda s: (-size_of[s], s)):
        held[shard_of[s]].append(s)
        load[shard_of[s]] += size_of[s]
    mean = sum(load) / n_shards
    free: list[int] = []
    uneven = max(load) - min(load) > max(size_of, default=0)
    for k in range(n_shards) if uneven else ():
        for s in list(held[k]):
            if size_of[s] and load[k] - size_of[s] >= mean:
                held[k].remove(s)
                load[k] -= size_of[s]
                free.append(s)
        if load[k] > mean and held[k]:  # one more, the smallest, brings it just below the mean
            s = min((s for s in held[k] if size_of[s]), key=lambda s: (size_of[s], s))
            held[k].remove(s)
            load[k] -= size_of[s]
            free.append(s)
    heap = [(load[k], k) for k in range(n_shards)]
    heapq.heapify(heap)
    for s in sorted(free, key=lambda s: (-size_of[s], s)):
        _, k = heapq.heappop(heap)
        shard_of[s] = k
        held[k].append(s)
        load[k] += size_of[s]
        heapq.heappush(heap, (load[k], k))
    for _ in range(20 * n_shards):
        hi, lo = max(range(n_shards), key=lambda k: (load[k], -k)), min(range(n_shards), key=lambda k: (load[k], k))
        gap = load[hi] - load[lo]
        moves = [(abs(gap - 2 * size_of[a]), a, -1) for a in held[hi] if 0 < size_of[a] < gap]
        small = sorted((size_of[b], b) for b in held[lo])
        for a in held[hi]:  # the partner whose size leaves half the gap
            want = size_of[a] - gap / 2
            i = _nearest(small, want)
            if i >= 0 and 0 < size_of[a] - small[i][0] < gap:
                moves.append((abs(gap - 2 * (size_of[a] - small[i][0])), a, small[i][1]))
        if not moves or min(moves)[0] >= gap:
            break
        _, a, b = min(moves)
        for s, source, target in ((a, hi, lo), (b, lo, hi)):
            if s >= 0:
                held[source].remove(s)
                held[target].append(s)
                load[source] -= size_of[s]
                load[target] += size_of[s]
                shard_of[s] = target
    return shard_of


def _nearest(pairs: list[tuple[int, int]], want: float) -> int:
    i = bisect.bisect_left(pairs, (want, -1))
    near = [j for j in (i - 1, i) if 0 <= j < len(pairs)]
    return min(near, key=lambda j: abs(pairs[j][0] - want)) if near else -1


def store_map(spark: SparkSession, shard_of: list[int], version: int, path: str | None = None) -> DataFrame:
    """The map as a table (version, vslot, shard); with ``path`` it is appended there, one folder a version."""
    rows = spark.createDataFrame([(version, s, k) for s, k in enumerate(shard_of)], "version int, vslot int, shard int")
    if path:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return rows


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """Slot-to-shard list of one version (the newest if none is named)."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return [r.shard for r in maps.where(F.col("version") == version).orderBy("vslot").collect()]


def assign_shards(docs: DataFrame, n_shards: int = 40, n_slots: int = 8192, map_path: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record with its shard and its place there (0, 1, 2 ... in each shard).

    A stored map at ``map_path`` is the starting point where there is one (its next version
    is written there); otherwise version 1 is.  Places follow virtual slots, then ids, so
    they need one sort within each slot and the few row counts per slot, no sort per shard.
    """
    spark = docs.sparkSession
    records = sized(docs, n_slots, id_col, text_col)
    # at most n_slots rows
    stats = {r.vslot: (r.bytes, r.rows) for r in slot_bytes(records).collect()}
    start, version = first_map(n_slots, n_shards), 1
    if map_path and (last := _last_version(spark, map_path)):
        start, version = load_map(spark, map_path, last), last
    elif map_path:
        store_map(spark, start, version, map_path)
    edited = rebalanced(start, [stats.get(s, (0, 0))[0] for s in range(n_slots)], n_shards)
    if map_path and edited != start:
        store_map(spark, edited, version + 1, map_path)
    base, used = [], [0] * n_shards
    for s, k in enumerate(edited):
        base.append((s, k, used[k]))
        used[k] += stats.get(s, (0, 0))[1]
    places = spark.createDataFrame(base, "vslot int, shard int, base long")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    # places has n_slots rows: safe to broadcast
    return records.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(places), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def _last_version(spark: SparkSession, path: str) -> int | None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(conf).exists(folder):
        return None
    return spark.read.parquet(path).agg(F.max("version")).first()[0]
