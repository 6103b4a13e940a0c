"""Exact top-k inner product on a bit-sliced index.

Vectors are quantised to integers and held per block as bit slices: one bitmap per
dimension and bit.  A query adds the slices of every dimension, shifted by the set bits
of its own value, with bitmap full adders; the sum is again a stack of slices.  The top k
rows fall out from the most significant slice downward; rows that tie on the whole score
at the boundary are settled by the smaller id.  Scores are read back from the slices, so
nothing is approximate.  Negative query values run over the complemented slices.

Queries are dealt out in blocks of a fixed size; each block is broadcast (its size is
checked) and runs against all rows where they lie: the index is never shuffled.

Defined results: vectors that are null or hold a null or a non-finite value take no part;
vectors meet only vectors of their own length; rows that share a query's id are its own;
of repeated query ids the smallest vector asks; ties go to the smaller id; values whose
scores would pass 62 bits raise a clear error; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragtide.llm.common import record

BLOCK_ROWS = 8192  # rows of an index block
QUERY_BLOCK = 4096  # queries sent out at once
QUERY_LANES = 32  # queries that share one pass over a block's slices
QUERY_BYTES = 64 << 20  # checked size of a broadcast query block
_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, for whole and finite vectors only."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(fit)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))


def bit_slices(values: np.ndarray) -> np.ndarray:
    """Bitmaps (dims, bits, words) of the non-negative integers ``values`` (rows, dims)."""
    rows, dims = values.shape
    bits = max(1, int(values.max(initial=0)).bit_length())
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((values >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
        out[:, b, : packed.shape[0]] = packed.T
    return out.view("<u8")


def add_slices(total: list[np.ndarray], addend: list[np.ndarray], shift: int) -> None:
    """total += addend << shift, in place, with bitmap full adders."""
    carry = None
    p = shift
    while p - shift < len(addend) or carry is not None:
        x = addend[p - shift] if p - shift < len(addend) else None
        if p == len(total):
            total.append(np.zeros_like(total[0]))
        t = total[p]
        if x is None:
            total[p] = t ^ carry
            carry = t & carry
            if not carry.any():
                carry = None
        elif carry is None:
            total[p] = t ^ x
            carry = t & x
        else:
            tx = t ^ x
            total[p] = tx ^ carry
            carry = (t & x) | (tx & carry)
        p += 1


def top_rows(total: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, tied) bitmaps per query: rows surely among the top k, and rows equal at the boundary."""
    sure, tied = np.zeros_like(alive), alive.copy()
    for s in reversed(total):
        hit = sure | (tied & s)
        n = np.bitwise_count(hit).sum(axis=1, keepdims=True)
        over = n > k
        tied = np.where(over, tied & s, tied & ~s)
        sure = np.where(over, sure, hit)
    return sure, tied


def _search(ids: np.ndarray, values: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """Top k of one block for every query: (query id, vec id, score) arrays."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = values.min(axis=0)
    up = values - low  # non-negative
    bits = max(1, int(up.max(initial=0)).bit_length())
    largest = max(int(up.max(initial=0)), int(np.abs(values).max(initial=0)))
    if largest.bit_length() + int(np.abs(q).max(initial=0)).bit_length() + q.shape[1].bit_length() > 62:
        raise ValueError("quantised values too large for 62-bit scores")
    top = (1 << bits) - 1
    plus, minus = bit_slices(np.vstack([up, np.full((1, up.shape[1]), top)])), bit_slices(np.vstack([top - up, np.full((1, up.shape[1]), top)]))
    rows, words = len(ids), plus.shape[2]
    valid = np.packbits(np.arange(words * 64) < rows, bitorder="little").view("<u8")
    for at in range(0, len(q_ids), QUERY_LANES):
        qs, part = q_ids[at: at + QUERY_LANES], q[at: at + QUERY_LANES]
        size = np.abs(part)
        # what the shift to non-negative slices adds to each query's scores
        base = (part * low).sum(axis=1) - np.where(part < 0, size * top, 0).sum(axis=1)
        total = [np.zeros((len(qs), words), np.uint64)]
        for d in range(part.shape[1]):
            # slices of this dimension as each query sees them: complemented where its value is negative
            seen = [np.where((part[:, d] < 0)[:, None], y, x) for x, y in zip(plus[d], minus[d])]
            for b in range(int(size[:, d].max(initial=0)).bit_length()):
                asks = np.where(((size[:, d] >> b) & 1).astype(bool)[:, None], np.uint64(2**64 - 1), np.uint64(0))
                add_slices(total, [x & asks for x in seen], b)
        alive = np.repeat(valid[None], len(qs), axis=0)
        own_from, own_to = np.searchsorted(ids, qs, "left"), np.searchsorted(ids, qs, "right")
        for i in range(len(qs)):
            for r in range(own_from[i], own_to[i]):
                alive[i, r >> 6] &= ~np.uint64(1 << (r & 63))
        sure, tied = top_rows(total, alive, k)
        for i in range(len(qs)):
            got = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            if len(got) < k:  # ids ascend within a block: the first tied rows win
                same = np.flatnonzero(np.unpackbits(tied[i].view(np.uint8), bitorder="little"))[: k - len(got)]
                got = np.concatenate([got, same])
            score = np.zeros(len(got), np.int64)
            for p, s in enumerate(total):
                score += ((s[i, got >> 6] >> (got & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p
            yield np.full(len(got), qs[i]), ids[got], score + base[i]


def _arrays(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, values) of a batch, apart by vector length."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    return [(ids[m], flat[start[m][:, None] + np.arange(n)]) for n in np.unique(length).tolist() for m in [length == n]]


def block_top(rows: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Each index block's best k rows for each query of one broadcast query block."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def search(parts):
            ids, values = (np.concatenate(x) for x in zip(*parts))
            asked = sent.value.get(values.shape[1])
            if asked is not None:
                found = [np.concatenate(x) for x in zip(*_search(ids, values, *asked, k))]
                yield record(_TOP, *found)

        for batch in batches:
            for ids, values in _arrays(batch):
                parts = held.setdefault(values.shape[1], [])
                parts.append((ids, values))
                if sum(len(x) for x, _ in parts) >= BLOCK_ROWS:
                    yield from search(held.pop(values.shape[1]))
        for parts in held.values():
            yield from search(parts)

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def topk(vectors: DataFrame, is_query, k: int = 5, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows of all ``vectors`` for each row where ``is_query`` (a column over vec_id) holds."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vec_col)
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = max(1, -(-asking.count() // query_block))
    found = None
    for b in range(blocks):
        block = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if block.nbytes > QUERY_BYTES:
            raise ValueError(f"a query block takes {block.nbytes} bytes: choose a smaller query_block")
        queries = {v.shape[1]: (i, v) for x in block.combine_chunks().to_batches() for i, v in _arrays(x)}
        part = block_top(rows, queries, k)
        found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
