"""Stored documents and chunks: Parquet tables, source files, and the one-file JSON store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from . import schemas

#: Chunks are partitioned by a bucket of their document, so one document's chunks are replaced without touching others.
BUCKETS = 64


def scan_sources(spark: SparkSession, path: str, max_mb: int = vocab.MAX_UPLOAD_MB) -> DataFrame:
    """PDF files under a path within the size limit: path, length and content; name and length are filtered before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".pdf") & (F.col("length") <= max_mb * 1024 * 1024))


def validate_uploads(files: DataFrame, max_mb: int = vocab.MAX_UPLOAD_MB) -> DataFrame:
    """Adds ``error`` to uploads (filename, mime, length): not a PDF by type or name, or too large; null if fine."""
    is_pdf = (F.coalesce("mime", F.lit("")) == "application/pdf") | F.lower("filename").endswith(".pdf")
    return files.withColumn(
        "error",
        F.when(~is_pdf, "Only PDF uploads are supported.").when(F.col("length") > max_mb * 1024 * 1024, f"This file exceeds the {max_mb} MB upload limit."),
    ).withColumn("blob_name", T.sanitize_filename(F.col("filename")))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of one source file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_json_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a one-file JSON store."""
    store = spark.read.schema(schemas.JSON_STORE).json(path, multiLine=True)
    documents = store.selectExpr("inline(documents)")
    chunks = store.selectExpr("inline(chunks)").select(
        F.col("documentId").alias("document_id"),
        "id",
        F.col("sourceId").alias("source_id"),
        F.col("pageFrom").alias("page_from"),
        F.col("pageTo").alias("page_to"),
        F.coalesce("sectionPath", F.expr("cast(array() as array<string>)")).alias("section_path"),
        F.col("chunkType").alias("chunk_type"),
        "text",
    )
    return documents, chunks


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_json_store(documents: DataFrame, chunks: DataFrame, path: str) -> None:
    """What ``read_json_store`` reads: one object with both lists. It is written beside the path, which it replaces by a rename.

    A store of this kind is one object, so it is for as much as one task holds; tables by bucket are for more.
    """
    spark = documents.sparkSession
    renamed = {"documentId": "document_id", "sourceId": "source_id", "pageFrom": "page_from", "pageTo": "page_to", "sectionPath": "section_path", "chunkType": "chunk_type"}
    fields = {f.name: [x.name for x in f.dataType.elementType.fields] for f in spark.createDataFrame([], schemas.JSON_STORE).schema}
    listed = lambda rows, own: rows.agg(F.sort_array(F.collect_list(F.struct(*(F.col(renamed.get(c, c)).alias(c) for c in own)))).alias("x"))
    both = listed(documents, fields["documents"]).select(F.col("x").alias("documents")).crossJoin(listed(chunks, fields["chunks"]).select(F.col("x").alias("chunks")))
    beside = f"{path.rstrip('/')}.next"
    both.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(beside)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    remove(spark, path)
    if not files.rename(place(beside), place(path)):
        raise OSError(f"cannot rename {beside} to {path}")


def save_source(files: DataFrame, path: str) -> DataFrame:
    """Keep the bytes of uploads (document_id, filename, content) under a path; returns document_id, blob_path and length.

    The bytes go into a table by bucket of the document, so one source is read from one bucket.
    """
    named = files.select("document_id", F.concat(F.lit("documents/"), "document_id", F.lit("/"), T.sanitize_filename(F.col("filename"))).alias("blob_path"), "content", F.length("content").cast("long").alias("length"))
    with_bucket(named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "document_id").parquet(path)
    return files.sparkSession.read.parquet(path).join(files.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "blob_path", "length")


def read_saved_source(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """blob_path, length and content of one kept source."""
    rows = spark.read.option("inferSchema", "false").parquet(path)
    return rows.filter((F.col("bucket") == _bucket(spark, document_id)) & (F.col("document_id").cast("string") == document_id)).select("blob_path", "length", "content")


def with_bucket(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))


def replace_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks with all of the fresh chunks' documents replaced by the fresh ones."""
    kept = stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    return kept.select(*stored.columns).unionByName(fresh.select(*stored.columns))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks by bucket; only buckets that occur are overwritten, each as a whole."""
    with_bucket(chunks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _bucket(spark: SparkSession, document_id: str) -> int:
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(document_id)), F.lit(BUCKETS)).cast("int")).first()[0]


def write_index(index: DataFrame, path: str) -> None:
    """Store indexed chunks (``search.index_chunks``) by bucket, so that questions read columns instead of texts."""
    write_chunks(index, path)


def read_chunks(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """Stored chunks; for one document only its bucket is read."""
    rows = spark.read.parquet(path)
    if document_id is None:
        return rows.drop("bucket")
    return rows.filter((F.col("bucket") == _bucket(spark, document_id)) & (F.col("document_id") == document_id)).drop("bucket")


def without_deleted(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Chunks of documents that were not deleted (column document_id)."""
    return chunks.join(deleted.select("document_id").distinct(), "document_id", "left_anti")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id and chunk_count of every document, 0 for those without chunks."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return documents.select(F.col("id").alias("document_id")).join(n, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
