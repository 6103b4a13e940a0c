"""Source/sink round trips: write with the sink, read back with the source, compare with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions import vectors as V
from ragtide.functions.relational import with_scalars
from ragtide.operators import chunk as C
from ragtide.operators import encode as E
from ragtide.operators import ingest as I
from ragtide.operators import judge as J
from ragtide.operators import sessions as SS
from ragtide.operators.evaluate import METRICS
from ragtide.plans.q_chunks import SQL_BUCKET, SQL_FIXED
from ragtide.plans.q_evaluate import SQL_ANSWERS, SQL_EVAL, _eval_rows
from ragtide.plans.q_monitor import SQL_REC
from ragtide.plans.q_sessions import SQL_PAIRS, _archived_at
from ragtide.plans.registry import register
from ragtide.sources import sinks as K
from ragtide.sources import tables as S
from ragtide.sources.derived import interaction_records, text_questions
from ragtide.sources.tables import table


def _landing(spark, d, root):
    """Documents as one text file per document (the text writer ends each file with a newline)."""
    path = f"{root}/landing"
    K.write_text_files(table(spark, d, "documents"), path)
    return path


@register("write_docs", """
SELECT doc_id AS doc, md5(text) AS text_md5 FROM documents""")
def write_docs(spark, d):
    """K1: documents written, half of them written again as a new version, read back."""
    root = I.scratch_path(spark, "write-docs")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    K.write_docs(docs, f"{root}/docs", 0)
    K.write_docs(docs.where(F.col("doc") % 2 == 0), f"{root}/docs", 1)  # replaces those documents only
    back = K.read_docs(spark, f"{root}/docs")
    return back.select("doc", F.md5("text").alias("text_md5"))


@register("load_text_corpus", """
SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM documents""")
def load_text_corpus(spark, d):
    """Whole-text files with their source path and file name, read back as one row per file."""
    root = I.scratch_path(spark, "text-corpus")
    corpus = S.load_text_corpus(spark, _landing(spark, d, root))
    t = F.substring("text", F.lit(1), F.length("text") - 1)
    return corpus.select(F.regexp_extract("source", r"doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id"),
                         F.md5(t).alias("text_md5"), F.length(t).alias("n_chars"))


@register("scan_documents", """
SELECT doc_id, strlen(text) + 1 AS length FROM documents""")
def scan_documents(spark, d):
    """List document files by extension (bytes not read), with their size."""
    root = I.scratch_path(spark, "scan")
    files = S.scan_documents(spark, _landing(spark, d, root), glob="*.txt")
    return files.select(F.regexp_extract("path", r"doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id"), "length")


@register("load_eval_set", "WITH " + SQL_ANSWERS + """
SELECT b.item_id AS qid, md5(b.text) AS question_md5,
       coalesce((SELECT string_agg(tok, '|' ORDER BY r) FROM kr WHERE kr.qid = b.item_id AND r <= 3), '')
         AS expected_keywords
FROM benchmark b""")
def load_eval_set(spark, d):
    """Evaluation set written as JSON arrays (one per 100 ids) and read back with multiLine."""
    root = I.scratch_path(spark, "eval-set")
    qs = text_questions(table(spark, d, "benchmark"))
    arrays = qs.groupBy(F.floor(F.col("qid") / 100).alias("shard")).agg(
        F.to_json(F.collect_list(F.struct("qid", "question", "expected_keywords"))).alias("value"))
    arrays.write.partitionBy("shard").text(f"{root}/eval")  # a file each: a multi-line file is read as one array
    back = S.load_eval_set(spark, f"{root}/eval")
    return back.select("qid", F.md5("question").alias("question_md5"),
                       F.array_join("expected_keywords", "|").alias("expected_keywords"))


@register("load_vectors", """
SELECT vec_id, len(embedding) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
FROM embeddings""")
def load_vectors(spark, d):
    """Persisted vectors opened instead of rebuilt."""
    root = I.scratch_path(spark, "vectors")
    table(spark, d, "embeddings").write.parquet(f"{root}/vectors")
    v = S.load_vectors(spark, f"{root}/vectors")
    return v.select("vec_id", F.size("embedding").alias("dim"), F.round(V.norm("embedding"), 6).alias("norm"))


@register("latest_snapshot", """
SELECT vec_id, CAST(3 AS BIGINT) AS snapshot_id FROM embeddings""")
def latest_snapshot(spark, d):
    """Three published snapshots (partitioned by id); only the newest is read."""
    root = I.scratch_path(spark, "snapshots")
    emb = table(spark, d, "embeddings").select("vec_id")
    for k in (1, 2, 3):
        part = emb.where(F.col("vec_id") % 3 < k).withColumn("snapshot_id", F.lit(k))
        part.write.mode("append").partitionBy("snapshot_id").parquet(f"{root}/snap")
    return S.latest_snapshot(spark, f"{root}/snap").select("vec_id", F.col("snapshot_id").cast("bigint").alias("snapshot_id"))


@register("index_chunks", "WITH " + SQL_FIXED + f""",
ct AS (SELECT doc, chunk_no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM chk)
SELECT c.doc, c.chunk_no, count(ct.tok) AS n_tokens
FROM chk c LEFT JOIN ct ON ct.doc = c.doc AND ct.chunk_no = c.chunk_no GROUP BY ALL""")
def index_chunks(spark, d):
    """K2: chunks with their vectors written as the bucketed index, read back."""
    root = I.scratch_path(spark, "index")
    chunks = E.encode(C.chunk_fixed(table(spark, d, "documents")), "text", "embedding")
    I.write_index(chunks, f"{root}/index")
    back = spark.read.parquet(f"{root}/index")
    return back.select("doc", "chunk_no",
                       F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_tokens"))


@register("interaction_log", "WITH " + SQL_REC + """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_%f') AS log_key, round(faithfulness, 6) AS faithfulness,
       CASE WHEN kind = 'error' THEN '' ELSE array_to_string(list_transform(range(0, 12),
            lambda i: 'chunk-' || CAST((event_id * 12 + i) % 1000003 AS VARCHAR)), ',') END AS hit_ids
FROM rec JOIN (SELECT event_id, event_type AS kind FROM events) USING (event_id)""")
def interaction_log(spark, d):
    """K4: every interaction appended as a JSON record (partitioned by day), the ids of its hits in it, and read back."""
    root = I.scratch_path(spark, "logs")
    K.write_interaction_log(interaction_records(table(spark, d, "events")), f"{root}/logs")
    schema = T.StructType([*S.INTERACTION_SCHEMA.fields, T.StructField("log_key", T.StringType())])
    back = spark.read.schema(schema).json(f"{root}/logs")
    return back.select("event_id", "log_key", F.round("faithfulness", 6).alias("faithfulness"), F.array_join("hit_ids", ",").alias("hit_ids"))


@register("session_archive", "WITH " + SQL_PAIRS + """
SELECT conv_id, count(*) AS n_turns,
       strftime(TIMESTAMP '2024-02-01 00:00:00' + to_hours((conv_id * 37) % 240), '%Y-%m-%d %H:%M:%S') AS archived_at
FROM pairs GROUP BY conv_id""")
def session_archive(spark, d):
    """K5: sessions appended to the archive in two runs (odd, then even conversations), read back."""
    root = I.scratch_path(spark, "archive")
    arch = SS.archive_rows(SS.qa_pairs(table(spark, d, "conversations")), _archived_at())
    K.append_archive(arch.where(F.col("conv_id") % 2 == 1), f"{root}/archive")
    K.append_archive(arch.where(F.col("conv_id") % 2 == 0), f"{root}/archive")
    schema = arch.schema
    back = spark.read.schema(schema).json(f"{root}/archive")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                       F.date_format("archived_at", "yyyy-MM-dd HH:mm:ss").alias("archived_at"))


@register("eval_report", "WITH " + SQL_EVAL + """
SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(relevance), 6) AS relevance,
       round(avg(completeness), 6) AS completeness, round(avg(citation), 6) AS citation,
       round(avg(overall), 6) AS overall, count(*) AS n_details
FROM erows""")
def eval_report(spark, d):
    """K6: evaluation report written as averages JSON + details table, read back."""
    root = I.scratch_path(spark, "report")
    K.write_eval_report(_eval_rows(spark, d), f"{root}/report")
    schema = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">"
    avg = spark.read.text(f"{root}/report/averages").select(F.from_json("value", schema).alias("a"))
    n = spark.read.parquet(f"{root}/report/details").agg(F.count(F.lit(1)).alias("n_details"))
    return with_scalars(avg, n).select(*[F.round(f"a.{m}", 6).alias(m) for m in METRICS], "n_details")
