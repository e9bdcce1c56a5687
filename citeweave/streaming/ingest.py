"""Streaming ingestion: new markdown pages become chunks as they arrive.

Pages are kept in a table of their own, by bucket of their document. A micro-batch adds
or replaces the pages that it brings, and the documents it touches are chunked anew from
all of their pages; a repeated batch gives the same tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab
from ..operators import chunking
from ..sources import store

PAGES = "document_id string, page int, text string"


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PAGES).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # no table yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _replace(spark: SparkSession, rows: DataFrame, path: str, scratch: str) -> None:
    """Overwrite the buckets of a table that occur in the rows; these may be read from it, so they are cut from it first."""
    rows.write.mode("overwrite").parquet(scratch)
    spark.read.schema(rows.schema).parquet(scratch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    store.remove(spark, scratch)


def ingest_stream(pages: DataFrame, table: str, checkpoint: str, target: int = vocab.CHUNK_TARGET_TOKENS) -> StreamingQuery:
    """Keep a chunk table and, beside it, a page table up to date with a stream of pages; available data first, then it ends.

    A page that comes again replaces the old one; of one that comes twice in a batch the greater text counts.
    """
    kept = f"{table.rstrip('/')}-pages"

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = store.with_bucket(batch.groupBy("document_id", "page").agg(F.max("text").alias("text")))
        touched = fresh.select("document_id", "bucket").distinct()
        buckets = touched.select("bucket").distinct()
        old = _stored(spark, kept)
        if old is not None:
            same = old.join(buckets, "bucket", "left_semi").join(fresh.select("document_id", "page"), ["document_id", "page"], "left_anti")
            fresh = same.select(*fresh.columns).unionByName(fresh)
        _replace(spark, fresh, kept, f"{kept}-batch-{number}")
        whole = spark.read.parquet(kept).join(touched, ["bucket", "document_id"], "left_semi")
        chunks = store.with_bucket(chunking.chunk_markdown(whole.select("document_id", "page", "text"), target))
        old = _stored(spark, table)
        if old is not None:
            rest = old.join(buckets, "bucket", "left_semi").join(touched.select("document_id"), "document_id", "left_anti")
            chunks = rest.select(*chunks.columns).unionByName(chunks)
        _replace(spark, chunks, table, f"{table.rstrip('/')}-batch-{number}")

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/progress").trigger(availableNow=True).start()


def status_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type) counted in tumbling windows; late ones are dropped behind the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
