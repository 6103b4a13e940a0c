"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents are range-partitioned and sorted by id and encoded where they land; each
partition is one token stream that is cut into windows of at most ``window`` ids.  Cuts
may fall at document ends (free), sentence ends (a small penalty) and, where neither is
near, every ``window / 32`` ids (a larger one).  The cost of a window is its padding plus
the penalty of the cut that ends it; windows as long as a power of two need no padding and pay
a fixed fee instead.  f(j) = min over cuts i within reach of f(i) + pad(i, j) + penalty(j):
as padding is linear in i, a monotone queue of f(i) + i answers the minimum in constant
time.  A stream is solved piece by piece (``BUFFER_IDS`` ids at a time, the open end goes on
to the next piece), so memory is bounded; the last ids of a partition go into power-of-two
windows where that costs less than padding.

Defined results: a null text is an empty one and still has its end id; repeated ids and
rows follow one another, ordered by id and text hash (null ids first); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import record, row_key
from ragtide.llm.encode_ids import encoded_rows, encoder

BUFFER_IDS = 1 << 20
SENTENCE_MARKS = ".!?"


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, window: int):
    """Sorted cut places and their penalties; neighbours are at most window / 32 apart."""
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    place = np.concatenate([[0], doc_ends, sentence])
    cost = np.concatenate([[0], np.zeros(len(doc_ends)), np.full(len(sentence), window / 1024)])
    step = max(1, window // 32)
    known = np.unique(np.append(place, len(ids)))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > step)
    n = (gaps[wide] - 1) // step
    extra = np.repeat(known[wide], n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    place = np.concatenate([place, extra, [len(ids)]])
    cost = np.concatenate([cost, np.full(len(extra) + 1, window / 128)])
    order = np.lexsort((cost, place))
    place, cost = place[order], cost[order]
    first = np.append(True, place[1:] != place[:-1])
    return place[first], cost[first]


def best_windows(place: np.ndarray, cost: np.ndarray, window: int, closing: bool) -> list[int]:
    """Ends of the cheapest windows from 0; if not ``closing``, up to the best cut within a window of the end."""
    c, pen, m = place.tolist(), cost.tolist(), len(place)
    even: dict[int, list[int]] = {}  # j -> cuts that lie a smaller power of two before it
    size = window >> 1
    while size >= max(1, window >> 4):
        at = np.searchsorted(place, place - size)
        for j in np.flatnonzero((at < m) & (place[np.minimum(at, m - 1)] == place - size)).tolist():
            even.setdefault(j, []).append(int(at[j]))
        size >>= 1
    fee = window / 8
    f, back = [0.0] * m, [0] * m
    g = [0.0] * m  # f(i) + i
    queue: deque[int] = deque()
    push, pop, shift = queue.append, queue.pop, queue.popleft
    for j in range(1, m):
        i = j - 1
        gi = g[i] = f[i] + c[i]
        while queue and g[queue[-1]] >= gi:
            pop()
        push(i)
        low = c[j] - window
        while c[queue[0]] < low:
            shift()
        i = queue[0]
        best = g[i] - low
        if j in even:
            for k in even[j]:
                if f[k] + fee < best:
                    best, i = f[k] + fee, k
        f[j] = best + pen[j]
        back[j] = i
    if closing:
        j, tail = m - 1, []
        if m > 1:
            near = [i for i in range(int(np.searchsorted(place, place[-1] - window)), m - 1)]
            i = min(near, key=lambda i: (f[i] + _tail_cost(c[-1] - c[i], window), i))
            tail = _tail(c[i], c[-1], window)
            j = i
    else:
        near = range(int(np.searchsorted(place, place[-1] - window, "right")), m)
        j, tail = min(near, key=lambda j: (f[j] - c[j] / window, -j)), []
    ends = []
    while j > 0:
        ends.append(c[j])
        j = back[j]
    return ends[::-1] + tail


def _tail_cost(length: int, window: int) -> float:
    return min(window - length, (length.bit_count() - 1) * window / 32)


def _tail(start: int, end: int, window: int) -> list[int]:
    """Ends of the last windows: one padded window, or powers of two."""
    length = end - start
    if window - length <= (length.bit_count() - 1) * window / 32:
        return [end]
    ends = []
    for b in reversed(range(length.bit_length())):
        if length >> b & 1:
            start += 1 << b
            ends.append(start)
    return ends


def sentence_table(path: str) -> np.ndarray:
    """For every id: whether its piece ends a sentence."""
    tok = encoder(path).tokenizer
    table = np.zeros(encoder(path).vocab_size + 1, bool)
    for piece, i in tok.get_vocab().items():
        body = piece.removesuffix("</w>")
        table[i] = bool(body) and all(x in SENTENCE_MARKS for x in body)
    return table


class Stream:
    """One partition's documents, cut window by window."""

    def __init__(self, window: int, ends_sentence: np.ndarray, first_sequence: int):
        self.window, self.ends_sentence, self.sequence = window, ends_sentence, first_sequence
        self.docs: list[tuple] = []  # (doc id, ids before the buffer, ids in all, ids in the buffer)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, 0, len(ids), len(ids)))
        self.parts.append(ids)
        self.held += len(ids)

    def cut(self, closing: bool) -> Iterator[tuple]:
        """Pieces (doc, start, length, ids, doc_tokens, sequence, offset) of the windows that are settled."""
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        doc_ends = np.cumsum([d[3] for d in self.docs])
        place, cost = candidate_cuts(ids, doc_ends, self.ends_sentence, self.window)
        ends = np.array(best_windows(place, cost, self.window, closing), np.int64)
        done = int(ends[-1])
        starts = np.append(0, ends[:-1])
        cuts = np.union1d(ends, doc_ends[doc_ends < done])
        doc_from = np.append(0, doc_ends[:-1])
        begin = np.append(0, cuts[:-1])
        which, where = np.searchsorted(doc_ends, begin, "right").tolist(), np.searchsorted(ends, begin, "right").tolist()
        for a, b, d, w in zip(begin.tolist(), cuts.tolist(), which, where):
            doc, before, total, _ = self.docs[d]
            yield doc, before + a - int(doc_from[d]), b - a, ids[a:b], total, self.sequence + w, a - int(starts[w])
        self.sequence += len(ends)
        left = [i for i in range(len(self.docs)) if doc_ends[i] > done]
        self.docs = [(doc, before + max(0, done - int(doc_from[i])), total, int(doc_ends[i]) - max(done, int(doc_from[i])))
                     for i in left for doc, before, total, _ in [self.docs[i]]]
        self.parts, self.held = [ids[done:]], len(ids) - done


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, the ids themselves (little-endian unsigned 32-bit).  ``window`` is a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    names = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    schema = pa.schema([(x, pa.int64()) for x in names] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        # sequences are numbered within their partition; the partition number keeps them apart and in order
        stream = Stream(window, sentence_table(tokenizer_path), TaskContext.get().partitionId() << 32)

        def rows(closing: bool) -> Iterator[pa.RecordBatch]:
            got = []
            for doc, start, n, ids, total, seq, off in stream.cut(closing):
                raw = ids.tobytes()
                got.append((doc, start, n, zlib.crc32(raw), total, seq, off, *[raw] * with_ids))
            if got:
                yield record(schema, *zip(*got))

        for (doc,), ids in encoded_rows(batches, enc, ("doc_id", "text")):
            stream.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4"))
            if stream.held >= max(BUFFER_IDS, window):
                yield from rows(False)
        yield from rows(True)

    spec = ", ".join(f"{x} long" for x in names) + ", ids binary" * with_ids
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(text_col).alias("row"))
    ordered = plain.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return ordered.select("doc_id", "text").mapInArrow(run, spec)
