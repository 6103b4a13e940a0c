"""Chunking, hashing encoder and text-to-hits retrieval over `documents` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtide.functions import vectors as V
from ragtide.operators import block_max as B
from ragtide.operators import chunk as C
from ragtide.operators import encode as E
from ragtide.operators import retrieve as R
from ragtide.operators.ingest import scratch_path
from ragtide.operators.truth import containing_documents, ranked_recall
from ragtide.plans.registry import register
from ragtide.sources.derived import text_questions
from ragtide.sources.tables import table

K = 12

# Fixed 1000/800 windows in SQL; chunk_no is the window's index, blank windows dropped.
SQL_FIXED = r"""
w AS (
  SELECT doc_id AS doc, text AS t, unnest(range(1, greatest(length(text), 1) + 1, 800)) AS s FROM documents
), chk AS (
  SELECT doc, (s - 1) // 800 AS chunk_no, s - 1 AS start, substr(t, s, 1000) AS text FROM w
  WHERE trim(substr(t, s, 1000)) <> ''
)"""

SQL_BUCKET = "(('0x' || substr(md5(tok), 1, 8))::BIGINT) % 384"

# Count vectors of chunks and questions in long form; cosine = integer dot / (|q| |c|).
SQL_RAG = SQL_FIXED + f""",
ct AS (SELECT doc, chunk_no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM chk),
cv AS (SELECT doc, chunk_no, {SQL_BUCKET} AS bucket, count(*) AS w FROM ct GROUP BY ALL),
cn AS (SELECT doc, chunk_no, sqrt(sum(w * w)) AS n FROM cv GROUP BY ALL),
qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM benchmark),
qv AS (SELECT qid, {SQL_BUCKET} AS bucket, count(*) AS w FROM qt GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qv GROUP BY ALL),
dots AS (SELECT qv.qid, cv.doc, cv.chunk_no, sum(qv.w * cv.w)::DOUBLE AS dot
         FROM qv JOIN cv ON cv.bucket = qv.bucket GROUP BY ALL),
sc AS (SELECT d.qid, d.doc, d.chunk_no, d.dot / (qn.n * cn.n) AS score
       FROM dots d JOIN qn ON qn.qid = d.qid JOIN cn ON cn.doc = d.doc AND cn.chunk_no = d.chunk_no),
hits AS (
  SELECT qid, doc, chunk_no, score,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc, chunk_no) AS rank
  FROM sc QUALIFY rank <= {K}
)"""


def _docs(spark, d):
    return table(spark, d, "documents")


def _fixed(spark, d):
    return C.chunk_fixed(_docs(spark, d))


@register("chunk_fixed", "WITH " + SQL_FIXED + """
SELECT doc, chunk_no, start, length(text) AS n_chars, md5(text) AS text_md5 FROM chk""")
def chunk_fixed(spark, d):
    """1000-character windows every 800 characters over every document."""
    c = _fixed(spark, d)
    return c.select("doc", "chunk_no", "start", "n_chars", F.md5("text").alias("text_md5"))


@register("chunk_recursive")
def chunk_recursive(spark, d):
    """Recursive character split (1000 / 200) of every document; no SQL form (library contract)."""
    c = C.chunk_recursive(_docs(spark, d))
    return c.select("doc", "chunk_no", "start", "n_chars", F.md5("text").alias("text_md5"))


@register("chunk_invariants", """
SELECT 0::BIGINT AS too_long, 0::BIGINT AS not_substring, 0::BIGINT AS not_increasing,
       0::BIGINT AS overlap_too_big, 0::BIGINT AS uncovered, 0::BIGINT AS blank_chunks, 0::BIGINT AS docs_lost""")
def chunk_invariants(spark, d):
    """C1 contract as violation counts over every document: all must be zero."""
    docs = _docs(spark, d)
    return C.chunk_invariants(docs, C.chunk_recursive(docs))


@register("chunk_stats", "WITH " + SQL_FIXED + """,
per AS (SELECT doc, count(*) AS n FROM chk GROUP BY doc),
alld AS (SELECT d.doc_id, coalesce(p.n, 0) AS n FROM documents d LEFT JOIN per p ON p.doc = d.doc_id)
SELECT count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_chunks, round(avg(n), 6) AS chunks_per_document,
       CAST(count_if(n = 0) AS BIGINT) AS documents_without_chunks
FROM alld""")
def chunk_stats(spark, d):
    """Total chunks and chunks per document (documents without chunks included)."""
    return C.chunk_stats(_docs(spark, d), _fixed(spark, d))


@register("chunk_ids", "WITH " + SQL_FIXED + """
SELECT doc, chunk_no, sha256(concat_ws(chr(31), CAST(doc AS VARCHAR), CAST(chunk_no AS VARCHAR), text)) AS chunk_id
FROM chk""")
def chunk_ids(spark, d):
    """C4: stable sha256 identity of every chunk."""
    return _fixed(spark, d).select("doc", "chunk_no", C.chunk_id().alias("chunk_id"))


@register("exact_duplicates", """
SELECT sha256(text) AS text_sha256, min(doc_id) AS keep_doc, count(*) AS n_copies
FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def exact_duplicates(spark, d):
    """Groups of identical document texts with the document kept."""
    return C.exact_duplicates(_docs(spark, d))


@register("embed_hashing", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents)
SELECT doc_id, {SQL_BUCKET} AS bucket, count(*) AS weight FROM t GROUP BY ALL""")
def embed_hashing(spark, d):
    """Hashed token counts of every document, long form (doc, bucket, weight)."""
    return E.sparse_vectors(_docs(spark, d), ["doc_id"])


def _rag_hits(spark, d, k=K):
    qs = E.encode(text_questions(table(spark, d, "benchmark")), "question", "qvec")
    chunks = E.encode(_fixed(spark, d), "text", "cvec")
    return R.topk(qs, chunks, k, c_id=["doc", "chunk_no"], c_vec="cvec", metric="cosine")


@register("rag_retrieve", "WITH " + SQL_RAG + """
SELECT h.qid, h.rank, h.doc, h.chunk_no, coalesce(d.source, 'Unknown') AS source, round(h.score, 6) AS cos,
       CASE WHEN h.score > 0.7 THEN 'HIGH' WHEN h.score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS quality
FROM hits h LEFT JOIN documents d ON d.doc_id = h.doc""")
def rag_retrieve(spark, d):
    """Text question -> encoder -> exact top-12 chunks -> cosine, band and source."""
    h = _rag_hits(spark, d)
    src = _docs(spark, d).select(F.col("doc_id").alias("doc"), "source")
    return R.attach(h, src, ["doc"]).select(
        "qid", "rank", "doc", "chunk_no", F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.round("score", 6).alias("cos"), V.quality_band("score").alias("quality"))


def _sparse_index(spark, d):
    path = scratch_path(spark, "postings")
    B.add_version(_fixed(spark, d), path, c_id=["doc", "chunk_no"])
    return path


@register("rag_sparse", "WITH " + SQL_RAG + """
SELECT qid, rank, doc, chunk_no, round(score, 6) AS cos FROM hits""")
def rag_sparse(spark, d):
    """The same top-12 chunks from stored posting lists, blocks skipped by their maxima (block-max pruning)."""
    h = B.topk_sparse(text_questions(table(spark, d, "benchmark")), _sparse_index(spark, d), K)
    return h.select("qid", "rank", "doc", "chunk_no", F.round("score", 6).alias("cos"))


@register("rag_sparse_skipped", "WITH " + SQL_RAG.lstrip() + """
SELECT count(*) AS n_questions, TRUE AS whole_index_met, TRUE AS blocks_skipped FROM qn""")
def rag_sparse_skipped(spark, d):
    """Questions of the posting-list search, whether every block was bounded, and whether fewer were scored."""
    path = _sparse_index(spark, d)
    n = B.stored_blocks(spark, path).count()
    r = B.search_report(text_questions(table(spark, d, "benchmark")), path, K)
    return r.agg(F.count(F.lit(1)).alias("n_questions"), F.bool_and(F.col("n_blocks") == n).alias("whole_index_met"),
                 (F.sum("n_scored") < F.sum("n_blocks")).alias("blocks_skipped"))


@register("retrieval_recall", "WITH " + SQL_RAG + """,
rel AS (
  SELECT h.qid, h.rank, CASE WHEN strpos(d.text, b.text) > 0 THEN 1 ELSE 0 END AS relevant
  FROM hits h JOIN documents d ON d.doc_id = h.doc JOIN benchmark b ON b.item_id = h.qid
), per AS (
  SELECT b.item_id AS qid, coalesce(max(relevant), 0) AS found, coalesce(min(CASE WHEN relevant = 1 THEN rank END), 0) AS first_rank
  FROM benchmark b LEFT JOIN rel ON rel.qid = b.item_id GROUP BY b.item_id
)
SELECT count(*) AS n_questions, CAST(sum(found) AS BIGINT) AS n_found, round(avg(found), 6) AS hit_rate,
       round(avg(CASE WHEN first_rank > 0 THEN 1.0 / first_rank ELSE 0.0 END), 6) AS mrr
FROM per""")
def retrieval_recall(spark, d):
    """V7: known-passage retrieval: does a hit's document contain the question passage? hit rate and MRR.

    Only the k hits per question are checked (join on the hit's document), never all pairs.
    """
    h = _rag_hits(spark, d)
    docs = _docs(spark, d).select(F.col("doc_id").alias("doc"), F.col("text").alias("_dt"))
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("_q"))
    rel = R.attach(h, docs, ["doc"], "inner").join(bench, "qid").select(
        "qid", "rank", (F.instr("_dt", F.col("_q")) > 0).cast("int").alias("relevant"))
    # every question counts, also one without any hit
    per = bench.select("qid").join(rel, "qid", "left").groupBy("qid").agg(
        F.coalesce(F.max("relevant"), F.lit(0)).alias("found"),
        F.coalesce(F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0)).alias("first_rank"))
    return per.agg(
        F.count(F.lit(1)).alias("n_questions"), F.sum("found").alias("n_found"),
        F.round(F.avg("found"), 6).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("first_rank") > 0, 1.0 / F.col("first_rank")).otherwise(0.0)), 6).alias("mrr"))


SQL_TRUTH = """,
truth AS (
  SELECT b.item_id AS qid, d.doc_id AS doc FROM benchmark b JOIN documents d ON b.text <> '' AND strpos(d.text, b.text) > 0
)"""


def _truth(spark, d):
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    return containing_documents(bench, _docs(spark, d).select(F.col("doc_id").alias("doc"), "text"))


@register("truth_set", "WITH " + SQL_TRUTH.lstrip(",\n") + """
SELECT qid, doc FROM truth""")
def truth_set(spark, d):
    """V7: every document that holds a benchmark passage, by a containment join on each passage's rarest shingle."""
    return _truth(spark, d).select("qid", "doc")


@register("retrieval_ndcg", "WITH " + SQL_RAG + SQL_TRUTH + """,
best AS (SELECT qid, doc, min(rank) AS rank FROM hits GROUP BY qid, doc),
per AS (
  SELECT t.qid, count(*) AS n_relevant, count(b.rank) AS n_found, coalesce(1.0 / min(b.rank), 0.0) AS rr,
         sum(CASE WHEN b.rank IS NULL THEN 0.0 ELSE 1.0 / log2(b.rank + 1.0) END) AS dcg
  FROM truth t LEFT JOIN best b ON b.qid = t.qid AND b.doc = t.doc GROUP BY t.qid
)
SELECT qid, n_relevant, n_found, round(n_found / n_relevant, 6) AS recall, round(rr, 6) AS reciprocal_rank,
       round(dcg / list_sum(list_transform(range(1, least(n_relevant, 12) + 1), lambda i: 1.0 / log2(i + 1.0))), 6) AS ndcg
FROM per""")
def retrieval_ndcg(spark, d):
    """V7: recall@12, reciprocal rank and nDCG of the text search against all documents that hold the passage."""
    return ranked_recall(_rag_hits(spark, d), _truth(spark, d), 12)
