"""Token ids in a binary file format: canonical length-limited Huffman codes in independent blocks.

Ids are counted over the whole corpus; package-merge gives code lengths of at most
``max_bits``, and lengths alone fix the canonical codes, so the code book of a file is one byte
per id.  Documents, range-partitioned and sorted by id, are gathered into blocks of whole
documents.  A block holds its documents' ids as one bit stream plus the bit offset of
every ``CHECKPOINT``-th id; a reader needs nothing but the block and the code book, and
decodes all stretches between checkpoints side by side through one table lookup per id.

A file set is a folder with ``codebook`` and ``blocks`` (Parquet tables that carry the
binary blocks, so any store that Spark reads will do).

Defined results: a null text is an empty one and still has its end id; repeated ids and
rows follow one another, ordered by id and text hash (null ids first); an empty table gives an
empty file set and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.llm.common import column, record, row_key
from ragtide.llm.encode_ids import encoded_rows, encoder
from ragtide.session import checkpoint_dir

MAX_BITS = 18
CHECKPOINT = 256
BLOCK_IDS = 1 << 18
MAGIC = b"HUF1"


# ------------------------------------------------------------------ code book

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Length of each id's code (0: never used) by package-merge, at most ``max_bits``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    max_bits = max(max_bits, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    rows, is_leaf = leaf, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        rows = both[by]
        is_leaf.append(by < n)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the successor of the one before."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = lengths[order].astype(np.int64)
    if len(order):
        top = int(bits.max())
        width = np.left_shift(np.int64(1), top - bits)  # share of the code space
        codes[order] = ((np.cumsum(width) - width) >> (top - bits)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """id * 32 + length for every value of the next ``bits`` bits."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    fill = np.repeat(order * 32 + lengths[order], 1 << (bits - lengths[order].astype(np.int64)))
    table = np.ones(1 << bits, np.int64)
    table[: len(fill)] = fill
    return table, bits


# --------------------------------------------------------------------- blocks

def encode_block(ids: np.ndarray, doc_ids: list, doc_lengths: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Header, documents (id, null flag, ids), bit offsets of the checkpoints, bit stream."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    off = end - size
    total = int(end[-1]) if len(end) else 0
    words = total // 32 + 2
    value = codes[ids] << (64 - (off & 31) - size).astype(np.uint64)
    at = off >> 5
    # bits of different ids never overlap, so adding is joining; sums stay under 2**32, exact in float64
    stream = np.bincount(at, (value >> np.uint64(32)).astype(np.float64), words)
    stream[1:] += np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    points = off[::CHECKPOINT].astype("<u8")
    head = struct.pack("<4sIIIQ", MAGIC, len(ids), len(doc_ids), CHECKPOINT, len(points))
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    empty = np.packbits(np.array([d is None for d in doc_ids], np.uint8)).tobytes()
    return b"".join([head, names, empty, np.asarray(doc_lengths, "<u4").tobytes(), points.tobytes(), stream.astype(">u4").tobytes()])


def decode_block(data: bytes, table: np.ndarray, bits: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of one block."""
    magic, n, docs, every, n_points = struct.unpack_from("<4sIIIQ", data)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = struct.calcsize("<4sIIIQ")
    names = np.frombuffer(data, "<i8", docs, at).tolist()
    at += 8 * docs
    empty = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs)
    at += -(-docs // 8)
    doc_lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    off = np.frombuffer(data, "<u8", n_points, at).astype(np.int64)
    at += 8 * n_points
    raw = np.frombuffer(data, np.uint8, -1, at)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    four = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from every byte on
    ids = np.empty((len(off), every), np.uint32)
    last = len(four) - 1
    for i in range(every if len(off) else 0):  # all stretches side by side
        window = (four[np.minimum(off >> 3, last)] << (off & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        entry = table[window]
        ids[:, i] = entry >> 5
        off = off + (entry & 31)
    return [None if e else d for d, e in zip(names, empty.tolist())], doc_lengths, ids.ravel()[:n]


# ------------------------------------------------------------------ Spark jobs

def id_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, block_ids: int) -> DataFrame:
    """Documents in ascending id order as blocks of plain ids: (part, block, base, n, doc_ids, lengths, ids)."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        small = "<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        part, block, base = TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0

        def done():
            lengths = np.array([len(p) for p in parts], "<u4")
            ids = np.concatenate(parts)
            return record(schema, [part], [block], [base], [held], [names], [lengths.tobytes()], [ids.astype(small).tobytes()])

        for (doc,), ids in encoded_rows(batches, enc, ("doc_id", "text")):
            names.append(doc)
            parts.append(np.append(ids, np.uint32(end_id)))
            held += len(ids) + 1
            if held >= block_ids:
                yield done()
                block, base = block + 1, base + held
                names, parts, held = [], [], 0
        if names:
            yield done()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(text_col).alias("row"))
    ordered = plain.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    spec = "part int, block int, base long, n long, doc_ids array<long>, lengths binary, ids binary"
    return ordered.select("doc_id", "text").mapInArrow(run, spec)


def _plain_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def count_ids(blocks: DataFrame, vocab_size: int) -> np.ndarray:
    """Occurrences of every id in the whole corpus (one partial count per task and id)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            for lengths, raw in zip(column(batch, "lengths"), column(batch, "ids")):
                n = int(np.frombuffer(lengths, "<u4").sum(dtype=np.int64))
                total += np.bincount(_plain_ids(raw, n), minlength=vocab_size)
        seen = np.flatnonzero(total)
        yield record(schema, seen, total[seen])

    counted = blocks.select("lengths", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocab_size, np.int64)
    for r in counted.collect():  # at most one row per id of the vocabulary
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text", max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write the file set to ``folder``."""
    spark = docs.sparkSession
    scratch = f"{folder}-plain"
    # tokenizing is the dear part: its result is written once, then counted and coded
    (id_blocks(docs, tokenizer_path, end_id, id_col, text_col, block_ids)
     .write.mode("overwrite").option("compression", "zstd").parquet(scratch))
    blocks = spark.read.parquet(scratch)
    vocab_size = max(encoder(tokenizer_path).vocab_size, end_id + 1)
    lengths = code_lengths(count_ids(blocks, vocab_size), max_bits)
    # ids before each partition: one row per partition
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(
        F.max(F.struct("block", (F.col("base") + F.col("n")).alias("n"))).alias("last")).select("part", "last.n").collect()}
    before, upto = {}, 0
    for part in sorted(sums):
        before[part], upto = upto, upto + sums[part]
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("data", pa.binary())])
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes, before = sent.value
        for batch in batches:
            for part, block, base, names, raw_n, raw in zip(*(column(batch, c) for c in ("part", "block", "base", "doc_ids", "lengths", "ids"))):
                n = np.frombuffer(raw_n, "<u4")
                data = encode_block(_plain_ids(raw, int(n.sum(dtype=np.int64))), names, n, codes, size)
                yield record(schema, [part], [block], [before[part] + base], [data])

    (blocks.mapInArrow(run, "part int, block int, first_id long, data binary")
     .write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks"))
    book = spark.createDataFrame([(bytearray(lengths.tobytes()), CHECKPOINT)], "code_lengths binary, checkpoint int")
    book.coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids (little-endian u32)."""
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first().code_lengths, np.uint8)
    sent = spark.sparkContext.broadcast(lengths)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = decode_table(sent.value)
        for batch in batches:
            for first, data in zip(column(batch, "first_id"), column(batch, "data")):
                names, n, ids = decode_block(data, table, bits)
                raw, end = ids.astype("<u4").tobytes(), np.cumsum(n)
                texts = [raw[4 * (e - k): 4 * e] for e, k in zip(end.tolist(), n.tolist())]
                yield record(schema, names, first + end - n, n, [zlib.crc32(t) for t in texts], *[texts] * with_ids)

    spec = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.parquet(f"{folder}/blocks").select("first_id", "data").mapInArrow(run, spec)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name in the session's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{root}/token-ids-{uuid.uuid4().hex}"
