"""V7: which documents hold a known passage, and how well hits find them.

Truth set by a containment join: a passage's words between its first and its last (those two may be parts of longer
words in a document) give shingles; its rarest shingle, by the number of documents that hold it, is joined with the
documents' shingles by equality, and only the pairs that meet are verified on the texts.  Frequent phrases therefore
call up few candidates, and a hot shingle is an equi-join key that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SMALL_KEYS = 200_000  # passage shingles that are sent to every task rather than joined
_WORD = r"[^\s\p{Punct}]+"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0))


def _shingles(words: Column, m: Column | int) -> Column:
    """Keys of all runs of m words (none if there are fewer)."""
    m = F.lit(m) if isinstance(m, int) else m
    at = F.when(F.size(words) >= m, F.sequence(F.lit(1), F.size(words) - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(m, F.array_join(F.slice(words, i, m), " "))))


def containing_documents(passages: DataFrame, docs: DataFrame, *, q_id: str = "qid", passage: str = "passage",
                         doc: str = "doc", text: str = "text") -> DataFrame:
    """(q_id, doc): every document whose text holds the passage, letter by letter.

    Null and empty passages are in no document.  A passage without a word between its first and last has no shingle;
    such passages, a part of the stated question set, are looked for in every document.
    """
    p = passages.where(F.length(passage) > 0).select(q_id, passage, _words(passage).alias("_w"))
    inner = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0)))
    p = p.withColumn("_w", inner).withColumn("_m", F.least(F.size(inner), F.lit(SHINGLE))).checkpoint()
    keyed = p.where("_m > 0").select(q_id, "_m", F.explode(_shingles(F.col("_w"), F.col("_m"))).alias("_key")).checkpoint()
    wanted = keyed.select("_key").distinct()
    if wanted.count() <= SMALL_KEYS:
        wanted = F.broadcast(wanted)
    lengths = [r[0] for r in p.where("_m > 0").select("_m").distinct().collect()]  # SHINGLE values at most
    words = docs.where(F.col(text).isNotNull()).select(doc, _words(text).alias("_w"))
    every = F.concat(*(_shingles(F.col("_w"), int(m)) for m in lengths)) if lengths else F.array().cast("array<bigint>")
    held = words.select(doc, F.explode(every).alias("_key")).join(wanted, "_key", "left_semi").checkpoint()
    counts = held.groupBy("_key").count()
    rarest = Window.partitionBy(q_id).orderBy(F.coalesce("count", F.lit(0)), "_key")  # the shingles of one passage
    prefix = keyed.join(counts, "_key", "left").withColumn("_r", F.row_number().over(rarest)).where("_r = 1").select(q_id, "_key")
    pairs = prefix.join(held, "_key").select(q_id, doc).distinct()
    texts = docs.select(doc, F.col(text).alias("_text"))
    found = pairs.join(p.select(q_id, passage), q_id).join(texts, doc).where(F.instr("_text", F.col(passage)) > 0)
    short = p.where("_m = 0").select(q_id, passage)
    loose = texts.join(F.broadcast(short), F.instr("_text", F.col(passage)) > 0) if not short.isEmpty() else None
    out = found.select(q_id, doc)
    return (out if loose is None else out.unionByName(loose.select(q_id, doc))).distinct()


def ranked_recall(hits: DataFrame, truth: DataFrame, k: int, *, q_id: str = "qid", doc: str = "doc") -> DataFrame:
    """One row per question with a truth: n_relevant, n_found, recall, reciprocal_rank, ndcg.

    A document counts once, at its best rank; gains are binary; the ideal order has as many documents as can fit k ranks."""
    best = hits.groupBy(q_id, doc).agg(F.min("rank").alias("rank"))
    ok = truth.join(best, [q_id, doc], "left")
    gain = F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = ok.groupBy(q_id).agg(F.count(F.lit(1)).alias("n_relevant"), F.count("rank").alias("n_found"),
                               F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.sum(gain).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return per.select(q_id, "n_relevant", "n_found", F.round(F.col("n_found") / F.col("n_relevant"), 6).alias("recall"),
                      F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round(F.col("_dcg") / ideal, 6).alias("ndcg"))
