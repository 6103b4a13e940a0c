"""Benchmark decontamination by a prefix-filtered set join with exact containment.

A benchmark item gives windows of ``n`` consecutive words (an item of fewer words is one
window of its size).  A window is a set of ``q``-word shingles; for full containment one
necessary shingle, its prefix, must occur in a document.  The prefix is the window's
rarest shingle, by counts over the whole corpus, so frequent phrases call up almost no
candidates.  An occurrence of a prefix shingle is a candidate window start; the length
bound (the window must fit the document) and the positional bound (the start may not lie
before the text) go first, then the window is compared word by word.

The benchmark is dealt with in blocks of a fixed byte size, each checked and sent to all
tasks; documents are scanned in place for each block, never shuffled.  Only counts of a
block's own shingles leave the tasks.

Defined results: a null or empty text, or one without words, has no words and no hits; a
benchmark item without words is never found; one without an id is named by the empty string; repeated rows are judged one by one; an
empty benchmark leaves every document clean; columns beside the text stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import column, received, record, shielded, shipped

# words are runs of digits, letters a-z and whatever lies beyond ASCII, after A-Z became a-z
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
BLOCK_BYTES = 8 << 20  # benchmark text handled at once


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Windows:
    """Windows of one benchmark block: word ids, their shingles, and (later) prefixes."""

    vocab: dict[bytes, int]  # word -> 1, 2, ...; 0 stands for any other word
    groups: dict[int, np.ndarray]  # window length -> distinct windows (rows of word ids)
    owners: dict[int, list[list[str]]]  # window length -> item ids of each window
    q: int

    def shingle_keys(self, ids: np.ndarray, q: int) -> np.ndarray:
        """Keys of all q-word shingles of word ids (last axis); -1 where a word is unknown."""
        if ids.shape[-1] < q:
            return np.empty(ids.shape[:-1] + (0,), np.int64)
        key, known = np.zeros(ids.shape[:-1] + (ids.shape[-1] - q + 1,), np.int64), None
        for i in range(q):
            part = ids[..., i: ids.shape[-1] - q + 1 + i]
            key = key * (len(self.vocab) + 1) + part
            known = part > 0 if known is None else known & (part > 0)
        return np.where(known, key, -1)

    def width(self, length: int) -> int:
        """Words per shingle for windows of this length."""
        return min(self.q, length)


def benchmark_windows(items: list[tuple[str, str]], n: int, q: int) -> Windows:
    vocab: dict[bytes, int] = {}
    found: dict[int, dict[tuple, list[str]]] = {}
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
        if not ids:
            continue
        size = min(n, len(ids))
        for w in dict.fromkeys(tuple(ids[i: i + size]) for i in range(len(ids) - size + 1)):
            found.setdefault(size, {}).setdefault(w, []).append(item)
    while q > 1 and (len(vocab) + 2) ** q >= 2**62:
        q -= 1
    return Windows(vocab, {m: np.array(list(ws), np.int64) for m, ws in found.items()},
                   {m: list(ws.values()) for m, ws in found.items()}, q)


def _ids(text: str | None, vocab: dict[bytes, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(vocab.get, words, repeat(0)), np.int64, len(words))


def shingle_counts(docs: DataFrame, block: Windows, text_col: str) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in the whole corpus: {(width, key): count}."""
    wanted = {q: np.unique(np.concatenate([block.shingle_keys(w, q).ravel() for m, w in block.groups.items() if block.width(m) == q]))
              for q in {block.width(m) for m in block.groups}}
    sent = shipped(docs.sparkSession, (block, wanted))
    schema = pa.schema([("q", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, wanted = received(sent)
        total = {q: np.zeros(len(keys), np.int64) for q, keys in wanted.items()}
        for batch in batches:
            for text in column(batch, text_col):
                ids = _ids(text, block.vocab)
                for q, keys in wanted.items():
                    got = block.shingle_keys(ids, q)
                    got = got[got >= 0]
                    at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                    np.add.at(total[q], at[keys[at] == got], 1)
        for q, n in total.items():
            seen = np.flatnonzero(n)
            yield record(schema, np.full(len(seen), q), wanted[q][seen], n[seen])

    counted = docs.select(text_col).mapInArrow(run, "q long, key long, n long").groupBy("q", "key").agg(F.sum("n").alias("n"))
    return {(r.q, r.key): r.n for r in counted.collect()}  # at most the block's shingles


@dataclass
class PrefixIndex:
    """For each shingle width: sorted prefix keys, and the window and offset each stands for."""

    block: Windows
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def prefix_index(block: Windows, counts: dict[tuple[int, int], int]) -> PrefixIndex:
    tables: dict[int, list] = {}
    for m, windows in block.groups.items():
        q = block.width(m)
        keys = block.shingle_keys(windows, q)
        rarity = np.array([[counts.get((q, int(k)), 0) for k in row] for row in keys])
        # the rarest shingle of each window; a window with one that never occurs needs no join at all
        offset = np.lexsort((keys, rarity), axis=1)[:, 0] if keys.shape[1] > 1 else np.zeros(len(keys), np.int64)
        pick = np.arange(len(windows))
        live = rarity[pick, offset] > 0
        rows = np.stack([keys[pick, offset], np.full(len(windows), m), pick, offset], axis=1)[live]
        tables.setdefault(q, []).append(rows)
    out = {}
    for q, parts in tables.items():
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        out[q] = tuple(np.ascontiguousarray(rows[:, i]) for i in range(4))
    return PrefixIndex(block, out)


def find_windows(ids: np.ndarray, index: PrefixIndex) -> list[tuple[int, int, int]]:
    """Every occurrence (start, length, window number) of a window in one document's word ids."""
    hits: list[tuple[int, int, int]] = []
    for q, (keys, length, window, offset) in index.tables.items():
        got = index.block.shingle_keys(ids, q)
        first, last = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
        n = np.where(got >= 0, last - first, 0)
        at = np.flatnonzero(n)
        if not len(at):
            continue
        row = np.repeat(first[at], n[at]) + np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
        start = np.repeat(at, n[at]) - offset[row]
        fits = (start >= 0) & (start + length[row] <= len(ids))  # positional and length bounds
        start, row = start[fits], row[fits]
        for m in np.unique(length[row]).tolist():
            of = length[row] == m
            s, w = start[of], window[row[of]]
            same = (ids[s[:, None] + np.arange(m)] == index.block.groups[m][w]).all(axis=1)
            hits.extend(zip(s[same].tolist(), [m] * int(same.sum()), w[same].tolist()))
    return hits


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of bounded size, one after the other."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield [(r.item, r.text) for r in items.where(part == b).orderBy("item", "text").collect()]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, q: int = 3, id_col: str = "item_id",
                       text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus ``_n_words`` and ``_hits``: array of (start, length, items) in words, one for every
    occurrence of a benchmark window."""
    kept = docs.columns
    marked = docs.withColumn("_n_words", F.lit(None).cast("long")).withColumn(
        "_hits", F.lit(None).cast("array<struct<start:int,length:int,items:array<string>>>"))
    spec = marked.schema
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("items", pa.list_(pa.string()))]))
    for items in _item_blocks(benchmark, id_col, text_col, block_bytes):
        block = benchmark_windows(items, n, q)
        index = prefix_index(block, shingle_counts(docs, block, text_col) if block.groups else {})
        sent = shipped(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = received(sent)
            for batch in batches:
                n_words, hits = [], []
                for text, before in zip(column(batch, text_col), column(batch, "_hits")):
                    ids = _ids(text, index.block.vocab)
                    n_words.append(len(ids))
                    found = find_windows(ids, index)
                    hits.append((before or []) + [{"start": s, "length": m, "items": index.block.owners[m][w]} for s, m, w in found])
                cols = [batch.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(hits, hit_type)], names=[*kept, "_n_words", "_hits"])

        marked = marked.mapInArrow(run, spec)
    return marked


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = mark_contamination(plain, benchmark, n)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    return marked.select(
        "doc_id", F.col("_n_words").alias("n_words"), covered_words("_hits").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def covered_words(hits: str):
    """Words inside any occurrence: the length of the union of the hit spans."""
    spans = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["length"]).alias("b")))))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def join(acc, s):
        new = F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))
        return F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, none, join, lambda acc: acc["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents that hold no benchmark window."""
    docs, restored = shielded(docs, "text")
    return restored(mark_contamination(docs, benchmark, n).where(F.size("_hits") == 0))
