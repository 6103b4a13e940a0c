"""Incremental ingestion queries: delta, status, skip, replace-by-document, manifest, batch job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragtide.functions.relational import with_scalars
from ragtide.operators import chunk as C
from ragtide.operators import content_chunks as CC
from ragtide.operators import elements as EL
from ragtide.operators import encode as E
from ragtide.operators import ingest as I
from ragtide.plans.q_chunks import SQL_FIXED
from ragtide.plans.q_elements import SQL_ELEMENTS
from ragtide.plans.registry import register
from ragtide.sources.derived import (
    DELETED_OFFSET, OLD_SUFFIX, PREVIOUS_AT, current_raw, previous_documents, previous_manifest,
)
from ragtide.sources.tables import table

SQL_STATE = f"""
cur AS (SELECT doc_id AS doc, 'docs/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, md5(text) AS fingerprint
        FROM documents),
prev AS (
  SELECT doc_id AS doc, CASE WHEN doc_id % 10 = 0 THEN text || '{OLD_SUFFIX}' ELSE text END AS text
  FROM documents WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id + {DELETED_OFFSET} AS doc, text FROM documents WHERE doc_id % 17 = 0
),
man AS (SELECT 'docs/' || CAST(doc AS VARCHAR) || '.pdf' AS path, md5(text) AS fingerprint FROM prev)"""


def _docs(spark, d):
    return table(spark, d, "documents")


@register("changed_documents", "WITH " + SQL_STATE + """
SELECT path, fingerprint FROM cur WHERE NOT EXISTS (
  SELECT 1 FROM man WHERE man.path = cur.path AND man.fingerprint = cur.fingerprint)""")
def changed_documents(spark, d):
    """New or modified documents against the manifest (anti join on path + fingerprint)."""
    docs = _docs(spark, d)
    return I.changed_documents(current_raw(docs), previous_manifest(docs)).select("path", "fingerprint")


@register("delta_status", "WITH " + SQL_STATE + """
SELECT coalesce(cur.path, man.path) AS path,
       CASE WHEN man.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'deleted'
            WHEN cur.fingerprint = man.fingerprint THEN 'unchanged' ELSE 'modified' END AS status
FROM cur FULL OUTER JOIN man ON man.path = cur.path""")
def delta_status(spark, d):
    """New / modified / unchanged / deleted per path."""
    docs = _docs(spark, d)
    return I.delta_status(current_raw(docs), previous_manifest(docs))


@register("skip_existing", """
SELECT doc_id, CAST(doc_id AS VARCHAR) || '.txt' AS txt_name FROM documents WHERE doc_id % 3 <> 0""")
def skip_existing(spark, d):
    """Documents still to parse: parsed outputs exist for doc_id % 3 = 0 (anti join on stem)."""
    docs = _docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("stem"))
    outputs = docs.where(F.col("doc_id") % 3 == 0).select("stem")
    todo = I.skip_existing(docs, outputs)
    return todo.select("doc_id", F.concat("stem", F.lit(".txt")).alias("txt_name"))


@register("reindex_replace", "WITH " + SQL_FIXED + """
SELECT doc, chunk_no, md5(text) AS text_md5 FROM chk""")
def reindex_replace(spark, d):
    """I4: old index with changed/deleted documents replaced equals a full rebuild (no stale chunk)."""
    docs = _docs(spark, d)
    old_index = C.chunk_fixed(previous_documents(docs), doc="doc")
    raw = current_raw(docs)
    man = previous_manifest(docs)
    changed = I.changed_documents(raw, man)
    deleted_paths = man.join(raw.select("path"), "path", "left_anti")
    deleted = deleted_paths.select(
        F.regexp_extract("path", r"docs/([0-9]+)\.pdf", 1).cast("bigint").alias("doc"))
    touched = changed.select("doc").unionByName(deleted)
    new_chunks = C.chunk_fixed(changed.select("doc", "text"), doc="doc")
    out = I.reindex_replace(old_index, touched, new_chunks)
    return out.select("doc", "chunk_no", F.md5("text").alias("text_md5"))


@register("manifest_upsert", "WITH " + SQL_STATE + """
SELECT path, fingerprint FROM cur
UNION ALL SELECT path, fingerprint FROM man WHERE path NOT IN (SELECT path FROM cur)""")
def manifest_upsert(spark, d):
    """K3: manifest after indexing the delta: newest entry per path (deleted paths kept, as in the reference)."""
    docs = _docs(spark, d)
    raw = current_raw(docs)
    man = previous_manifest(docs)
    entries = I.changed_documents(raw, man).select(
        "path", "fingerprint", F.lit("2024-02-01 00:00:00").cast("timestamp").alias("indexed_at"))
    return I.manifest_upsert(man, entries).select("path", "fingerprint")


@register("manifest_rows", "WITH " + SQL_STATE + """
SELECT path, fingerprint FROM cur""")
def manifest_rows(spark, d):
    """Manifest written as sharded JSON maps and read back as rows."""
    raw = current_raw(_docs(spark, d)).withColumnRenamed("doc", "doc_id")
    shards = I.manifest_to_json_shards(raw, shard_size=100)
    return I.manifest_rows(shards)


@register("ingest_batch", "WITH " + SQL_FIXED + """
SELECT doc, chunk_no, md5(text) AS text_md5 FROM chk""")
def ingest_batch(spark, d):
    """Full job on disk: build the previous index, run one incremental batch, run it again
    (must touch nothing), read the index back.  Must equal a full rebuild of the current corpus."""
    docs = _docs(spark, d)
    root = I.scratch_path(spark, "ingest")
    index_path, manifest_path = f"{root}/index", f"{root}/manifest"

    def to_chunks(df):
        return C.chunk_fixed(df, doc="doc")

    prev = previous_documents(docs)
    I.write_index(to_chunks(prev), index_path, 0)
    state = previous_manifest(docs)
    if "indexed_at" not in state.columns:
        state = state.withColumn("indexed_at", F.lit(None).cast("timestamp"))
    I.publish_manifest(state.select("path", "fingerprint", "indexed_at", F.regexp_extract("path", r"docs/([0-9]+)\.pdf", 1).alias("doc"),
                                    F.lit(0).alias("version")), manifest_path)
    I.ingest_batch(spark, current_raw(docs), index_path=index_path, manifest_path=manifest_path, to_chunks=to_chunks)
    again = I.ingest_batch(spark, current_raw(docs), index_path=index_path, manifest_path=manifest_path, to_chunks=to_chunks)
    if again != 0:
        raise AssertionError(f"rerun on unchanged input touched {again} documents")
    idx = I.read_index(spark, index_path, manifest_path)
    return idx.select("doc", "chunk_no", F.md5("text").alias("text_md5"))


@register("ingest_pages", "WITH " + SQL_ELEMENTS + r"""
SELECT doc, regexp_replace(string_agg(text, '' ORDER BY pos), '\s+', '', 'g') AS letters, TRUE AS vectors_sound
FROM elements WHERE category NOT IN ('Header', 'Footer', 'PageBreak') GROUP BY doc""")
def ingest_pages(spark, d):
    """I5 as a whole: raw pages -> elements -> recursive chunks -> vectors -> index -> manifest, then one page deleted
    and restored; read back from the index."""
    root = I.scratch_path(spark, "ingest-pages")
    at = {"index_path": f"{root}/index", "manifest_path": f"{root}/manifest"}
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc"), "html")
    raw = pages.select("doc", F.concat(F.lit("pages/"), F.col("doc").cast("string"), F.lit(".html")).alias("path"),
                       F.md5("html").alias("fingerprint"), F.col("html").alias("text"))

    def to_chunks(df):
        elements = EL.extract_elements(df, doc="doc", html="text")
        texts = EL.assemble_documents(elements, style="plain").select("doc", "text")
        return E.encode(C.chunk_recursive(texts, doc="doc"), "text", "embedding")

    first = raw.agg(F.min("doc")).first()[0]
    for part in (raw, raw.where(F.col("doc") != first), raw):
        I.ingest_batch(spark, part, to_chunks=to_chunks, **at)
    chunks = I.read_index(spark, at["index_path"], at["manifest_path"])
    # every letter of a page comes back in its place and once: a chunk gives what lies beyond the one before it
    before = F.max(F.col("start") + F.length("text")).over(Window.partitionBy("doc").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1))
    new = F.expr("substring(text, 1 + greatest(_before - start, 0))")
    own = chunks.withColumn("_before", F.coalesce(before, F.lit(0))).select("doc", "chunk_no", new.alias("new"), (F.size("embedding") == E.DIM).alias("ok"))
    parts = own.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "new"))).alias("parts"), F.min("ok").alias("vectors_sound"))
    letters = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["new"]), ""), r"\s+", "")
    return parts.select("doc", letters.alias("letters"), "vectors_sound")


@register("chunk_reuse", """
SELECT count(*) AS n_documents, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_edited, TRUE AS equal_to_rebuild,
       TRUE AS only_new_encoded, TRUE AS mostly_reused
FROM documents""")
def chunk_reuse(spark, d):
    """Every tenth document gets a sentence in its middle; content-defined chunks are cut again, and only those
    that no document had before are encoded.  The index must equal a rebuild from nothing, and the chunks encoded must be
    few (under a quarter of the edited documents' chunks, and one a document for those of few chunks)."""
    root = I.scratch_path(spark, "reuse")
    docs = _docs(spark, d).select(F.col("doc_id").alias("doc"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edit = F.concat(F.expr("left(text, cast(length(text) / 2 as int))"), F.lit(" A sentence that was not there. "), F.substring("text", half + 1, F.lit(1 << 30)))
    edited = docs.withColumn("text", F.when(F.col("doc") % 10 == 0, edit).otherwise(F.col("text")))

    def encoded(chunks):
        return E.encode(chunks, "text", "embedding").select("chunk_id", "embedding")

    before, after = CC.chunk_by_content(docs).checkpoint(), CC.chunk_by_content(edited).checkpoint()
    encoded(before.select("chunk_id", "text").dropDuplicates(["chunk_id"])).write.parquet(f"{root}/vectors/version=0")
    stored = spark.read.parquet(f"{root}/vectors").select("chunk_id", "embedding")
    fresh = CC.unseen_chunks(after, stored).checkpoint()
    encoded(fresh).write.parquet(f"{root}/vectors/version=1")
    index = CC.with_vectors(after, spark.read.parquet(f"{root}/vectors").select("chunk_id", "embedding"))
    rebuilt = CC.with_vectors(after, encoded(after.select("chunk_id", "text").dropDuplicates(["chunk_id"])))

    def digest(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc", "chunk_no", "text", "embedding")).alias("x"))

    a, b = digest(index).select(F.col("n").alias("na"), F.col("x").alias("xa")), digest(rebuilt).select(F.col("n").alias("nb"), F.col("x").alias("xb"))
    touched = after.where(F.col("doc") % 10 == 0)
    counts = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("doc") % 10 == 0).alias("n_edited"))
    sizes = touched.agg(F.count(F.lit(1)).alias("_touched"))
    new = fresh.join(touched.select("chunk_id").distinct().withColumn("_in", F.lit(1)), "chunk_id", "left").agg(
        F.count(F.lit(1)).alias("_new"), F.count("_in").alias("_new_in"))
    out = counts
    for one in (a, b, sizes, new):
        out = with_scalars(out, one)
    return out.select("n_documents", "n_edited", ((F.col("na") == F.col("nb")) & F.col("xa").eqNullSafe(F.col("xb"))).alias("equal_to_rebuild"),
                      (F.col("_new") == F.col("_new_in")).alias("only_new_encoded"),
                      (F.col("_new") <= F.col("_touched") / 4 + 3 * F.col("n_edited")).alias("mostly_reused"))
