"""Sparse text search over stored posting lists with block maxima.

Stored: chunks become sparse count vectors (bucket, weight), are sorted so that chunks with the same heaviest buckets
lie together, and cut into blocks of ``BLOCK`` chunks.  One row a block holds its posting lists (bucket, place in the
block, weight), the chunks' norms and ids, and for every bucket the largest normed weight of any chunk of the block.
Later chunks are appended as one more version folder.

Search: a question's cosine with any chunk of a block is at most the sum of its normed weights times the block's maxima.
A first pass reads the maxima alone, takes each question's ``SEEDS`` best-bounded blocks of the whole index and scores
those: the k-th score found is a floor under the true k-th score.  The second pass streams the blocks; a block is scored
only against the questions whose bound reaches the floor or the running k-th score, whichever is higher, and skipped
otherwise.  Skipping never changes the result: only scores that can't be among the k best are left out.

Vectors leave a task in sparse form only.  A chunk that shares no bucket with a question has no score and is no hit; a
question or chunk without tokens (null and empty texts too) has no hits.  Ties go to the smaller id, as in ``topk``.
Question sets whose dense form is over ``broadcast_bytes`` are met with the blocks cell by cell, without a floor.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators import encode as E
from ragtide.operators.retrieve import DEFAULT_BROADCAST_BYTES, RANK_DIGITS, SCORE_CELLS, _ids, _rank

BLOCK = 16  # chunks of a block
SEEDS = 4  # blocks a question scores first, over the whole index
HEAVIEST = 8  # buckets of the sort key that brings similar chunks together
CELL_BLOCKS = 4096  # index blocks of one cell, for question sets beyond the broadcast budget
SLACK = 2e-9  # scores are ranked at nine digits, so bounds must fall short by more than that


# ------------------------------------------------------------------ index

def add_version(chunks: DataFrame, path: str, version: int = 0, *, c_id="vec_id", text: str = "text") -> None:
    """Store the chunks as one version of the index; a retried write replaces its own version only."""
    ids = _ids(c_id)
    rows = chunks.select(*[F.col(c).alias(f"id_{c}") for c in ids], E.sparse_arrays(text).alias("v"))
    # written once, because range borders are sampled from it before it is sorted
    rows = rows.select(*[f"id_{c}" for c in ids], "v.buckets", "v.weights").where(F.size("buckets") > 0).checkpoint()
    heavy = F.slice(F.sort_array(F.arrays_zip("weights", "buckets"), asc=False), 1, HEAVIEST)
    near = rows.withColumn("heavy", F.transform(heavy, lambda x: x["buckets"]))
    key = ["heavy", *[f"id_{c}" for c in ids]]  # with the ids, so that equal vectors spread over partitions
    schema = T.StructType([
        T.StructField("block", T.StringType()), *[T.StructField(f"id_{c}", T.ArrayType(chunks.schema[c].dataType)) for c in ids],
        T.StructField("norms", T.ArrayType(T.DoubleType())), T.StructField("buckets", T.ArrayType(T.ShortType())),
        T.StructField("maxima", T.ArrayType(T.FloatType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.ArrayType(T.ShortType())), T.StructField("weights", T.ArrayType(T.IntegerType()))])

    def cut(batches):
        part, made, held = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            whole = len(held) // BLOCK * BLOCK
            if whole:
                yield pd.DataFrame([_block(held.iloc[i:i + BLOCK], f"{version}-{part}-{made + i // BLOCK}", ids) for i in range(0, whole, BLOCK)])
                made, held = made + whole // BLOCK, held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame([_block(held, f"{version}-{part}-{made}", ids)])

    near.repartitionByRange(*key).sortWithinPartitions(*key).drop("heavy").mapInPandas(cut, schema) \
        .write.mode("overwrite").parquet(f"{path}/version={version}")


def _block(chunks: pd.DataFrame, name: str, ids: list[str]) -> dict:
    """Posting lists and maxima of some chunks."""
    place = np.repeat(np.arange(len(chunks)), [len(b) for b in chunks["buckets"]])
    bucket, weight = np.concatenate(chunks["buckets"].tolist()), np.concatenate(chunks["weights"].tolist()).astype(np.int64)
    norms = np.sqrt(np.bincount(place, weight * weight, minlength=len(chunks)))
    order = np.lexsort((place, bucket))
    place, bucket, weight = place[order], bucket[order], weight[order]
    names, first = np.unique(bucket, return_index=True)
    top = np.maximum.reduceat(weight / norms[place], first)
    return {"block": name, **{f"id_{c}": chunks[f"id_{c}"].tolist() for c in ids}, "norms": norms, "buckets": names,
            "maxima": np.nextafter(top.astype(np.float32), np.float32(np.inf)), "ends": np.append(first[1:], len(bucket)).astype(np.int32),
            "places": place.astype(np.int16), "weights": weight.astype(np.int32)}


def stored_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("version")


# ------------------------------------------------------------------ search

class _Questions:
    """Dense questions of one task, built there from their sparse form."""

    def __init__(self, ids: np.ndarray, buckets: list, weights: list):
        self.ids, self.q = ids, np.zeros((len(ids), E.DIM))
        for i, (b, w) in enumerate(zip(buckets, weights)):
            self.q[i, b] = w
        self.norm = np.sqrt((self.q * self.q).sum(1))

    def bounds(self, blocks: pd.DataFrame) -> np.ndarray:
        """(blocks x questions): no chunk of the block has a higher cosine."""
        top = np.zeros((len(blocks), E.DIM))
        for i, (b, m) in enumerate(zip(blocks["buckets"], blocks["maxima"])):
            top[i, b] = m
        return top @ self.q.T / self.norm

    def scores(self, block, live: np.ndarray) -> np.ndarray:
        """(questions of ``live`` x chunks): cosine by the block's posting lists; zero where no bucket is shared."""
        lists = np.repeat(np.arange(len(block.buckets)), np.diff(block.ends, prepend=0))
        w = np.zeros((len(block.buckets), len(block.norms)))
        w[lists, block.places] = block.weights
        return self.q[np.ix_(live, block.buckets)] @ w / (block.norms[None, :] * self.norm[live, None])


class _Best:
    """Running k best of every question: what is held is k scores a question and a bounded buffer of candidates."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.top, self.floor, self.found, self.held = k, np.full((n, k), -np.inf), floor.copy(), [], 0

    def add(self, live: np.ndarray, scores: np.ndarray, ids: dict) -> None:
        key = np.where(scores > 0, np.round(scores, RANK_DIGITS), -np.inf)
        both = np.concatenate([self.top[live], key], axis=1)
        self.top[live] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]
        self.floor[live] = np.maximum(self.floor[live], self.top[live].min(1))
        rows, cols = np.nonzero((key > -np.inf) & (key >= self.floor[live][:, None] - SLACK))
        self.found.append(pd.DataFrame({"q": live[rows], **{c: np.asarray(v)[cols] for c, v in ids.items()}, "score": scores[rows, cols]}))
        self.held += len(rows)
        if self.held > 200_000 + 2 * self.top.size:
            self.found = [self.rows()]
            self.held = len(self.found[0])

    def rows(self) -> pd.DataFrame:
        if not self.found:
            return pd.DataFrame()
        got = pd.concat(self.found, ignore_index=True)
        ids = [c for c in got.columns if c not in ("q", "score")]
        got["key"] = -np.round(got["score"], RANK_DIGITS)
        got = got.sort_values(["q", "key", *ids], kind="stable")
        return got[got.groupby("q").cumcount() < self.k].drop(columns="key")


def _stream(batches, asked: _Questions, k: int, floor: np.ndarray, ids: list[str]):
    """Second pass over the blocks of one task: best rows, then one row a question with the blocks it scored and met."""
    best, scored, met = _Best(len(asked.ids), k, floor), np.zeros(len(asked.ids), np.int64), 0
    step = max(1, SCORE_CELLS // max(1, len(asked.ids)))
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            part = pdf.iloc[lo:lo + step]
            bounds, met = asked.bounds(part), met + len(part)
            # blocks that may raise the k-th score most come first
            for i in np.argsort(-(bounds - np.maximum(best.floor, 0)).max(axis=1), kind="stable"):
                live = np.nonzero((bounds[i] > 0) & (bounds[i] >= best.floor - SLACK))[0]
                if len(live):
                    block = part.iloc[i]
                    best.add(live, asked.scores(block, live), {c: block[c] for c in ids})
                    scored[live] += 1
    rows = best.rows()
    if len(rows):
        yield pd.DataFrame({"q": asked.ids[rows["q"]], **{c: rows[c].to_numpy() for c in ids}, "score": rows["score"].to_numpy(),
                            "scored": 0, "met": 0})
    if met:
        yield pd.DataFrame({"q": asked.ids, **{c: None for c in ids}, "score": None, "scored": scored, "met": met})


def _search(questions: DataFrame, path: str, k: int, q_id: str, text: str, broadcast_bytes: int) -> tuple[DataFrame, list[str]]:
    spark = questions.sparkSession
    blocks = stored_blocks(spark, path)
    ids = [c for c in blocks.columns if c.startswith("id_")]
    ask = questions.select(F.col(q_id).alias("q"), E.sparse_arrays(text).alias("v")).select("q", "v.buckets", "v.weights") \
        .where(F.size("buckets") > 0).checkpoint()
    q_field = T.StructField("q", ask.schema["q"].dataType)
    out = T.StructType([q_field, *[T.StructField(c, blocks.schema[c].dataType.elementType) for c in ids], T.StructField("score", T.DoubleType()),
                        T.StructField("scored", T.LongType()), T.StructField("met", T.LongType())])
    n = ask.count()
    if n * E.DIM * 8 > broadcast_bytes:
        return _cells(ask, blocks, n, k, ids, out, broadcast_bytes), ids

    local = ask.toPandas()  # sparse, its dense size was checked
    sent = spark.sparkContext.broadcast((local["q"].to_numpy(), local["buckets"].tolist(), local["weights"].tolist()))

    def best_bounds(batches):
        asked = _Questions(*sent.value)
        top, names = np.full((n, SEEDS), -np.inf), np.full((n, SEEDS), None, dtype=object)
        step = max(1, SCORE_CELLS // max(1, n))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                value = np.concatenate([top, asked.bounds(part).T], axis=1)
                name = np.concatenate([names, np.broadcast_to(part["block"].to_numpy(dtype=object), (n, len(part)))], axis=1)
                take = np.argpartition(-value, SEEDS - 1, axis=1)[:, :SEEDS]
                top, names = np.take_along_axis(value, take, 1), np.take_along_axis(name, take, 1)
        i, j = np.nonzero(top > 0)
        yield pd.DataFrame({"i": i, "block": names[i, j], "bound": top[i, j]})

    bounded = blocks.select("block", "buckets", "maxima").mapInPandas(best_bounds, "i int, block string, bound double")
    first = Window.partitionBy("i").orderBy(F.desc("bound"), "block")
    seeds = bounded.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SEEDS).groupBy("block").agg(F.collect_list("i").alias("live"))

    def seed_scores(batches):
        asked = _Questions(*sent.value)
        for pdf in batches:
            for block in pdf.itertuples():
                live = np.sort(np.asarray(block.live))
                scores = asked.scores(block, live)
                rows, cols = np.nonzero(scores > 0)
                yield pd.DataFrame({"i": live[rows], "score": np.round(scores[rows, cols], RANK_DIGITS)})

    # SEEDS blocks a question, so the broadcast side is bounded by the question set
    scored = blocks.select("block", "norms", "buckets", "ends", "places", "weights").join(F.broadcast(seeds), "block") \
        .mapInPandas(seed_scores, "i int, score double")
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))
    floors = scored.withColumn("r", place).where(F.col("r") == k).toPandas()
    floor = np.full(n, -np.inf)
    floor[floors["i"].to_numpy(dtype=int)] = floors["score"]
    sent_floor = spark.sparkContext.broadcast(floor)

    def stream(batches):
        if n:
            yield from _stream(batches, _Questions(*sent.value), k, sent_floor.value, ids)

    return blocks.mapInPandas(stream, out), ids


def _cells(ask: DataFrame, blocks: DataFrame, n: int, k: int, ids: list[str], out: T.StructType, broadcast_bytes: int) -> DataFrame:
    """Question blocks of the broadcast budget against cells of ``CELL_BLOCKS`` index blocks, both by hash."""
    n_q = math.ceil(n * E.DIM * 8 / broadcast_bytes)
    n_b = max(1, math.ceil(blocks.count() / CELL_BLOCKS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = ask.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).withColumn("cb", every(n_b))
    right = blocks.withColumn("cb", F.pmod(F.xxhash64("block"), F.lit(n_b)).cast("int")).withColumn("qb", every(n_q))

    def cell(qdf: pd.DataFrame, bdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(qdf) and len(bdf):
            asked = _Questions(qdf["q"].to_numpy(), qdf["buckets"].tolist(), qdf["weights"].tolist())
            got = list(_stream([bdf], asked, k, np.full(len(qdf), -np.inf), ids))
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({f.name: [] for f in out})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, out)


def topk_sparse(questions: DataFrame, path: str, k: int = 12, *, q_id: str = "qid", text: str = "question",
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """(q_id, rank, ids, score): the k stored chunks of highest cosine with each question's text."""
    found, ids = _search(questions, path, k, q_id, text, broadcast_bytes)
    return _rank(found, "q", ids, k, ascending=False).select(F.col("q").alias(q_id), "rank", *[F.col(c).alias(c[3:]) for c in ids], "score")


def search_report(questions: DataFrame, path: str, k: int = 12, *, q_id: str = "qid", text: str = "question",
                  broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """(q_id, n_blocks, n_scored): blocks of the index and blocks that the second pass scored for each question with tokens."""
    found, _ = _search(questions, path, k, q_id, text, broadcast_bytes)
    return found.groupBy(F.col("q").alias(q_id)).agg(F.sum("met").alias("n_blocks"), F.sum("scored").alias("n_scored"))
