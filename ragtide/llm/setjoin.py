"""N-gram Jaccard join with set-relation skipping, and its connected groups.

A document is its set of distinct word shingles (64-bit hashes); equal sets become one.
Two sets link when 100 * |intersection| >= percent * |union|.

Index: shingles have one global order, frequent ones last (by a table of counts over all
documents; its size is fixed and it only decides the order, never a result), so that a
set's necessary prefix is mostly shingles that few sets have.  The sets that share a prefix
shingle form an index list.  Prefixes are a little longer than one shared shingle asks for, so that linked
sets must share several (one, and one for each SHARE shingles of the smaller set).

Skipping, index level: a list is laid out by set size; a set visits only the stretch within the size
bound (in long lists: its own block and the next).  Where the two prefixes end in the common order bounds what can
lie behind them, so linked sets of like size share far more than one prefix shingle: a pair is only sent by the task that
holds its lists if the lists that both sets are in elsewhere can make up that number, and falls out before any set
is fetched if it misses it or if the sets' bitmaps differ in too many bits.

Skipping, answer level: first each list is walked once in one common order and only
neighbours are verified (linear in the list).  Sets found similar share one answer: whatever
the group is linked to, they are linked to.  Then only pairs of sets that share a list
and are not yet in one group are verified.  So a group of copies costs about as many
comparisons as it has members, and no link between groups is lost.

Defined results: a null or empty text, or one of white space only, has no shingles and
stands alone; a text with fewer words than a shingle has its word sequence as its only one;
repeated rows and ids share a set; a null id belongs to its group but never names it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragtide.llm.common import column, materialize, received, record, row_key, shielded, shipped, slices, stored
from ragtide.llm.components import components

CELL_BITS = 24
CELLS = 1 << CELL_BITS  # counters of the order table
LIST_SETS = 4000  # sets of an index list that one task pairs
SHARE = 20  # one shared prefix shingle more for so many shingles of a set
FLUSH = 1 << 22  # shingles that a task counts before it sends its pieces; a part of it for rows of lists and pairs
CHUNK = 1 << 16  # counters of one piece of it
SIGNED = 4  # words of a set's bitmap that go with its rows into the lists' tasks
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                         0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, A-Z read as a-z.  A word's hash is the sum of its bytes, each
    times a multiplier of its place."""
    raw = [(t or "").encode() for t in texts]
    data = _FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    inside = data != 32
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    factor = mixed(np.arange(1, int(size.max()) + 1, dtype=np.uint64))
    h = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * factor[place], first)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    return mixed(h + size.astype(np.uint64) * _MULTIPLIERS[7]), np.searchsorted(text_end, start, "right")


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text, one text after the other; where each text ends)."""
    word, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    end = np.cumsum(count)
    h = np.zeros(len(word), np.uint64)
    for i in range(words):
        h[: len(word) - i] += word[i:] * _MULTIPLIERS[i]
    whole = np.ones(len(word), bool)
    for i in range(1, words):  # windows that would run into the next text
        whole[-i:] = False
        whole[:-i] &= owner[:-i] == owner[i:]
    for t in np.flatnonzero((count > 0) & (count < words)).tolist():
        a = end[t] - count[t]
        h[a] = (word[a: end[t]] * _MULTIPLIERS[: count[t]]).sum(dtype=np.uint64) + np.uint64(count[t])
        whole[a] = True
    h, owner = mixed(h[whole]), owner[whole]
    start = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.cumsum(np.bincount(owner, minlength=len(texts)))


def set_names(h: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit name per set (0 for an empty one)."""
    start = np.append(0, end[:-1]) if len(end) else end
    out = np.zeros(len(end), np.uint64)
    some = np.flatnonzero(end > start)
    if len(some):
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed(h ^ _MULTIPLIERS[6]), start[some])
            out[some] = mixed(total + (end - start)[some].astype(np.uint64) * _MULTIPLIERS[7]) | np.uint64(1)
    return out.view(np.int64)


def needed(n1, n2, percent: int):
    """Smallest intersection of linked sets with these sizes."""
    return -(-(percent * (n1 + n2)) // (100 + percent))


def shared_needed(n):
    """Shingles that linked sets share in their prefixes: a prefix is longer by one for each beyond the first."""
    return n // SHARE + 1


def prefix_length(n, percent: int):
    """Shingles in the prefix of a set of size n: a linked set overlaps with it in at least percent of its size."""
    return n - -(-percent * n // 100) + shared_needed(n)


def prefix_needed(n1, n2, percent: int):
    """Prefix shingles that linked sets of these sizes share at least.

    Of the set whose prefix ends first in the common order, every shared prefix shingle lies in the other's prefix
    too, and what lies behind its prefix adds at most its number to the intersection (the positional bound)."""
    behind = np.maximum(n1 - prefix_length(n1, percent), n2 - prefix_length(n2, percent))
    return np.maximum(needed(n1, n2, percent) - behind, 1)


def _cells_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def _pieces(cells: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Counted cells by piece of the table: differences of the sorted places in it, compressed."""
    flat = np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.uint32)
    cut = np.searchsorted(flat, np.arange(0, CELLS + 1, CHUNK))
    for piece in np.flatnonzero(np.diff(cut)).tolist():
        place = flat[cut[piece]: cut[piece + 1]] - np.uint32(piece * CHUNK)
        yield piece, zlib.compress(np.diff(place, prepend=np.uint32(0)).astype("<u2").tobytes(), 1)


def merged_table(pieces: DataFrame) -> np.ndarray:
    """CELLS counters (up to 65535) of all pieces (piece, data): first in many small groups, then per piece."""

    def count(pdf):
        total = np.zeros(CHUNK, np.int64)
        for data in pdf["data"]:
            total += np.bincount(np.cumsum(np.frombuffer(zlib.decompress(data), "<u2"), dtype=np.int64), minlength=CHUNK)
        return pdf.iloc[:1][["piece"]].assign(data=[zlib.compress(total.astype("<u4").tobytes(), 1)])

    def add(pdf):
        total = sum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64) for data in pdf["data"])
        return pdf.iloc[:1][["piece"]].assign(data=[zlib.compress(np.minimum(total, 65535).astype("<u2").tobytes(), 1)])

    salted = pieces.select("piece", "data", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"))
    once = salted.groupBy("piece", "salt").applyInPandas(count, "piece int, data binary")
    counts = np.zeros(CELLS, np.uint16)
    for r in once.groupBy("piece").applyInPandas(add, "piece int, data binary").toLocalIterator():  # CELLS counters in all
        counts[r.piece * CHUNK: (r.piece + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.data), "<u2")
    return counts


_SCAN = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("piece", pa.int32()), ("data", pa.binary())])


def scanned(docs: DataFrame, words: int) -> DataFrame:
    """Row key, set name and size of every document, and each task's counters of all its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            got = list(_pieces(held))
            none = [None] * len(got)
            yield record(_SCAN, none, none, none, none, [p for p, _ in got], [d for _, d in got])

        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), column(batch, "text")
            for part in slices(texts):
                h, end = shingle_sets(texts[part], words)
                s = set_names(h, end)
                none = [None] * len(s)
                yield record(_SCAN, ids[part], keys[part], pa.array(s, pa.int64(), mask=s == 0), np.diff(end, prepend=0), none, none)
                held.append(_cells_of(h))
                size += len(h)
                if size >= FLUSH:
                    yield from counted()
                    held, size = [], 0
        yield from counted()

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, s long, n long, piece int, data binary")


def order_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells no fuller than chance makes them, else the count's magnitude."""
    usual = counts.mean()
    odd = counts > usual + 4 * np.sqrt(usual) + 4
    return np.where(odd, np.log2(np.maximum(counts, 1), dtype=np.float32).astype(np.uint8) + 1, 0).astype(np.uint8)


_PREFIX = pa.schema([("token", pa.int64()), ("s", pa.int64()), ("n", pa.int64())])


def prefixes(docs: DataFrame, words: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(token, s, n): the necessary prefix of every set, each set once per task."""
    sent = shipped(docs.sparkSession, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = received(sent)
        seen: set[int] = set()
        for batch in batches:
            texts = column(batch, "text")
            for part in slices(texts):
                h, end = shingle_sets(texts[part], words)
                s = set_names(h, end)
                n = np.diff(end, prepend=0)
                first: dict[int, int] = {}
                for i, name in enumerate(s.tolist()):
                    if name and name not in seen:
                        first.setdefault(name, i)
                seen.update(first)
                level = classes[_cells_of(h)]
                out = []
                for i in first.values():
                    a, b = int(end[i] - n[i]), int(end[i])
                    out.append(h[a:b][np.argsort(level[a:b], kind="stable")[:prefix_length(b - a, percent)]])
                if out:
                    who, size = np.array(list(first.values())), np.array([len(x) for x in out])
                    yield record(_PREFIX, np.concatenate(out).view(np.int64), np.repeat(s[who], size), np.repeat(n[who], size))

    return docs.select("text").mapInArrow(run, "token long, s long, n long")


def shared_lists(rows: DataFrame) -> DataFrame:
    """Rows of tokens that at least two sets have: (token, s, n), each set once in its list, and the
    list's next set (after_s, after_n).  All lists follow one order, so the lists of a group of
    copies name the same few neighbours."""
    lists = Window.partitionBy("token")
    walk = lists.orderBy("s")
    spread = rows.withColumn("low", F.min("s").over(lists)).withColumn("high", F.max("s").over(lists))
    for c in ("s", "n"):
        spread = spread.withColumn(f"after_{c}", F.lead(c).over(walk))
    # a set that several tasks sent stands there repeatedly: its last row has another set after it, or none
    last = F.col("after_s").isNull() | (F.col("after_s") != F.col("s"))
    return spread.where("low <> high").where(last).drop("low", "high")


def alike_in_size(n1, n2, percent: int):
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def often(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, need, k), a row for every k shared prefix shingles, that share enough of them."""
    return pairs.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("need").alias("need")).where("k >= need").select("a", "b")


def parity_bits(h: np.ndarray) -> bytes:
    """A bitmap of about two bits a shingle in which each shingle toggles one bit.

    Two such bitmaps differ in at most as many bits as their sets differ in shingles, also after the larger one
    is folded onto the smaller, so they bound the intersection from above."""
    size = 64
    while size < 2 * len(h):
        size *= 2
    return np.packbits(np.bincount((mixed(h) % np.uint64(size)).astype(np.int64), minlength=size) % 2 == 1).tobytes()


def may_link(x: bytes, n1: int, y: bytes, n2: int, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2:]
    apart = int(np.bitwise_count(a ^ b).sum())
    return (n1 + n2 - apart) // 2 >= needed(n1, n2, percent)


def folded(x: bytes, words: int) -> np.ndarray:
    """The bitmap in at most so many words of 64 bits."""
    a = np.frombuffer(x, np.uint64)
    while len(a) > words:
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    return a


def apart(names: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """For bitmaps of at most SIGNED words: in how many bits number i differs from each of the numbers j."""
    size = np.array([len(x) // 8 for x in names])
    at_most = {w: np.zeros((len(names), w), np.uint64) for w in np.unique(size).tolist()}
    for w, rows in at_most.items():
        for i in np.flatnonzero(size >= w).tolist():
            rows[i] = folded(names[i], w)

    def bits(i: int, j: np.ndarray) -> np.ndarray:
        out, w = np.zeros(len(j), np.int64), np.minimum(size[i], size[j])
        for k in np.unique(w).tolist():
            out[w == k] = np.bitwise_count(at_most[k][j[w == k]] ^ at_most[k][i]).sum(axis=1)
        return out

    return bits


def signatures(bits: DataFrame) -> DataFrame:
    """(s, sig): the bitmaps folded to SIGNED words."""
    schema = pa.schema([("s", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(schema, batch.column(0), [folded(x, SIGNED).tobytes() for x in column(batch, "h")])

    return bits.select("s", "h").mapInArrow(run, "s long, sig binary")


def narrowed(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmaps don't rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_link(*row, percent) for row in zip(*(column(batch, c) for c in ("x", "nx", "y", "ny")))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)

    left = pairs.join(bits.select(F.col("s").alias("a"), F.col("h").alias("x"), F.col("n").alias("nx")), "a")
    both = left.join(bits.select(F.col("s").alias("b"), F.col("h").alias("y"), F.col("n").alias("ny")), "b")
    return both.select("a", "b", "x", "nx", "y", "ny").mapInArrow(run, "a long, b long")


def wanted_sets(docs: DataFrame, names: DataFrame, words: int, bits: bool = False) -> DataFrame:
    """(s, n, h) of the named sets: size and shingles (or parity bits).  A table of fixed size lets few others
    out of the scan."""
    pieces = names.mapInArrow(_name_cells, "piece int, data binary")
    sent = shipped(docs.sparkSession, np.packbits(merged_table(pieces) > 0))
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("h", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(received(sent)).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            texts = column(batch, "text")
            for part in slices(texts):
                h, end = shingle_sets(texts[part], words)
                s = set_names(h, end)
                start = np.append(0, end[:-1])
                out = {}
                for i in np.flatnonzero(there[_cell(s)] & (s != 0)).tolist():
                    if int(s[i]) not in seen:
                        out[int(s[i])] = h[start[i]: end[i]]
                seen.update(out)
                data = [parity_bits(x) if bits else x.tobytes() for x in out.values()]
                yield record(schema, list(out), [len(x) for x in out.values()], data)

    sets = docs.select("text").mapInArrow(run, "s long, n long, h binary")
    return sets.dropDuplicates(["s"])


def _cell(s: np.ndarray) -> np.ndarray:
    return _cells_of(mixed(s.view(np.uint64)))


def _name_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("piece", pa.int32()), ("data", pa.binary())])
    held, size = [], 0
    for batch in batches:
        held.append(np.unique(_cell(batch.column(0).to_numpy().astype(np.int64))))
        size += len(held[-1])
        if size >= FLUSH:
            yield record(schema, *zip(*_pieces(held)))
            held, size = [], 0
    got = list(_pieces(held))
    yield record(schema, [p for p, _ in got], [d for _, d in got])


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    sets = wanted_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("s")), words)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(column(batch, "x"), column(batch, "y")):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                ok.append(same >= needed(len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)

    left = pairs.join(sets.select(F.col("s").alias("a"), F.col("h").alias("x")), "a")
    return left.join(sets.select(F.col("s").alias("b"), F.col("h").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked_sets(docs: DataFrame, words: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(node, root) of all sets that link with another one."""
    live = stored(shared_lists(prefixes(docs, words, percent, classes)))
    bits = materialize(wanted_sets(docs, live.select("s"), words, bits=True))
    fits = alike_in_size(F.col("n"), F.col("after_n"), percent)
    walked = live.where(fits).select(F.least("s", "after_s").alias("a"), F.greatest("s", "after_s").alias("b")).distinct()
    near = materialize(verified(materialize(narrowed(walked, bits, percent)), docs, words, percent))
    groups = components(near)
    # what is left: sets of different groups that share a list
    named = live.select("token", "s", "n").join(groups.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    named = named.withColumn("r", F.count("*").over(Window.partitionBy("s")))  # lists that a set is in at all
    lists = Window.partitionBy("token")
    open_ = named.withColumn("low", F.min("root").over(lists)).withColumn("high", F.max("root").over(lists)).withColumn(
        "size", F.count("*").over(lists)).where("low <> high")
    # only rows of lists that are still open carry a bitmap
    short = open_.where(F.col("size") <= LIST_SETS).join(signatures(bits), "s", "left")
    left = often(short_list_pairs(short, percent).unionAll(
        long_list_pairs(open_.where(F.col("size") > LIST_SETS), percent)))
    left = narrowed(left, bits, percent)
    return components(near.union(verified(materialize(left), docs, words, percent)))


def short_list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, need, k) of sets of different groups in lists of bounded length.  Lists that begin with the same group
    meet in one task, which takes one set after the other, counts what it shares with the others, and sends a pair
    only if the lists that its sets are in elsewhere can still make up what linked sets share, and if the sets' folded
    bitmaps don't rule it out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64()), ("k", pa.int64())])

    def pairs(token, s, n, root, r, sig) -> Iterator[tuple]:
        names, first, at, here = np.unique(s, return_index=True, return_inverse=True, return_counts=True)
        n, root, elsewhere = n[first], root[first], r[first] - here
        cut = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        own_list = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        by_set = np.argsort(at, kind="stable")
        bits = apart(sig[first].tolist())
        upto = np.cumsum(here)
        for i in range(len(names)):
            lists = own_list[by_set[upto[i] - here[i]: upto[i]]]
            j, k = np.unique(np.concatenate([at[cut[x]: cut[x + 1]] for x in lists.tolist()]), return_counts=True)
            # each pair once, from its smaller set, within the size bound
            ok = ((n[j] > n[i]) | ((n[j] == n[i]) & (j > i))) & (n[j] * percent <= n[i] * 100) & (root[j] != root[i])
            j, k = j[ok], k[ok]
            need = prefix_needed(n[i], n[j], percent)
            ok = k + np.minimum(elsewhere[i], elsewhere[j]) >= need
            j, k, need = j[ok], k[ok], need[ok]
            ok = (n[i] + n[j] - bits(i, j)) // 2 >= needed(n[i], n[j], percent)
            if ok.any():
                j, k, need = j[ok], k[ok], need[ok]
                yield np.minimum(names[i], names[j]), np.maximum(names[i], names[j]), need, k

    def sent(held: list) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for part in pairs(*(np.concatenate(c) for c in zip(*held))):
            found.append(part)
            size += len(part[0])
            if size >= FLUSH // 16:
                yield record(schema, *(np.concatenate(c) for c in zip(*found)))
                found, size = [], 0
        if found:
            yield record(schema, *(np.concatenate(c) for c in zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
            low, token = cols[0], cols[1]
            # beyond FLUSH // 4 rows the lists at hand go first, and the rest of their group counts as elsewhere
            cut = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1).tolist(), len(token)]
            for x, y in zip(cut[:-1], cut[1:]):
                new = held and token[x] != held[-1][0][-1]
                if new and size >= (FLUSH // 16 if low[x] != held_low else FLUSH // 4):
                    yield from sent(held)
                    held, size = [], 0
                held_low = low[x]
                held.append([c[x:y] for c in cols[1:]])
                size += y - x
        if held:
            yield from sent(held)

    near = rows.select("low", "token", "s", "n", "root", "r", "sig").repartition("low").sortWithinPartitions("low", "token")
    return near.mapInArrow(run, "a long, b long, need long, k long")


def long_list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The same for long lists, as a join that Spark can split, in blocks by size."""
    # a hair wider than the bound: partners of at least a set's size lie in its own block or the next
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.001 * math.log(percent / 100.0))).cast("long")
    x = rows.select("token", block.alias("block"), *(F.col(c).alias(f"{c}1") for c in ("s", "n", "root", "r")))
    y = rows.select("token", F.explode(F.array(block, block - 1)).alias("block"), *(F.col(c).alias(f"{c}2") for c in ("s", "n", "root", "r")))
    once = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("s1") < F.col("s2")))
    apart = F.col("root1") != F.col("root2")
    # as in prefix_needed
    least = F.expr(f"({percent} * (n1 + n2) + {99 + percent}) div {100 + percent}")
    behind = F.greatest(*(F.expr(f"({percent} * {n} + 99) div 100 - {n} div {SHARE} - 1") for n in ("n1", "n2")))
    need = F.greatest(least - behind, F.lit(1))
    both = x.join(y, ["token", "block"]).where(apart & once & alike_in_size(F.col("n1"), F.col("n2"), percent) & (F.least("r1", "r2") >= need))
    return both.select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b"), need.alias("need"), F.lit(1).cast("long").alias("k"))


def keyed_rows(plain: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, row, n, key) of every row of ``plain`` (doc_id, row, text); key is equal within a group, null without shingles."""
    scan = materialize(scanned(plain, words))
    classes = order_classes(merged_table(scan.where("piece is not null").select("piece", "data")))
    named = scan.where("piece is null").select("doc_id", "row", "s", "n")
    roots = linked_sets(plain, words, percent, classes).withColumnRenamed("node", "s")
    return named.join(roots, "s", "left").select("doc_id", "row", "n", F.coalesce("root", "s").alias("key"))


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id of its group, its own included) and
    group_key (equal for all documents of a group; null without shingles)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.col(text_col).alias("text"))
    keyed = keyed_rows(plain, words, percent)
    lowest = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("lowest"))
    return keyed.join(lowest, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"), F.col("key").alias("group_key"))


def keep_one(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group: the smallest id (a null one only where the whole group has none),
    then the smallest row key, then, of rows that agree in both, the one whose JSON is smallest; rows without shingles all
    stay.  Other columns may have any type and name."""
    docs, restored = shielded(docs, id_col, text_col)
    name, row = F.col(id_col).cast("long"), row_key(text_col)
    keyed = keyed_rows(docs.select(name.alias("doc_id"), row.alias("row"), F.col(text_col).alias("text")), words, percent)
    # rows of one id and row key have one text, so one group
    named = materialize(keyed.where("key is not null").groupBy("doc_id", "row").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    first = named.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"))
    same = named["doc_id"].eqNullSafe(first["_id"]) & (named["row"] == first["_row"])
    gone = named.join(first, same, "left_anti").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    several = named.where("n > 1").join(first, same, "left_semi").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    there = name.eqNullSafe(F.col("_id")) & (row == F.col("_row"))
    single = docs.join(gone.unionAll(several), there, "left_anti")
    # only kept rows that repeat are gathered, and each task sends one of them
    one = docs.join(several, there, "left_semi").groupBy(name.alias("_id"), row.alias("_row")).agg(
        F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("_one"))
    return restored(single.unionAll(one.select("_one.*")))
