"""Documents over time: an append-only history of events, and what follows from it.

A status change is a row, not an update; the present state is the last value of each
field by sequence number, a grouped ``max_by`` that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import chunking, layout

LOCAL_MODES = ("local-layout-parser", "local-text-parser")
LOCAL_PROVIDER = "pdf-parse"
FIELDS = ("status", "workflow_run_id", "page_count", "parser_meta", "outline", "ingestion_version", "filename", "blob_path")


def current_state(events: DataFrame) -> DataFrame:
    """document_id and the last value of every field; the error message goes with the last status."""
    last = lambda f, c: F.max_by(c, F.when(F.col("field") == f, F.col("seq")))
    return events.groupBy("document_id").agg(*(last(f, "value").alias(f) for f in FIELDS), last("status", "error_message").alias("error_message"), F.max("at").alias("updated_at"))


def create_documents(events: DataFrame, documents: DataFrame, at: Column | None = None) -> DataFrame:
    """The history with new documents (id, filename, blob_path) in their first status; an id that the history has fails the job."""
    known = events.select(F.col("document_id").alias("id")).distinct().withColumn("__known", F.lit(True))
    met = documents.select("id", "filename", "blob_path").join(known, "id", "left")
    own = F.when(F.col("__known"), F.raise_error(F.concat(F.lit("Document exists: "), "id"))).otherwise(F.col("id"))
    first = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("filename", F.col("filename")), ("blob_path", F.col("blob_path")), ("status", F.lit(vocab.STATUSES[0])))))
    rows = met.select(own.alias("document_id"), F.posexplode(first).alias("pos", "e"))
    fresh = rows.select("document_id", (F.col("pos") + 1).cast("long").alias("seq"), "e.field", "e.value", F.lit(None).cast("string").alias("error_message"), (at if at is not None else F.current_timestamp()).alias("at"))
    return events.unionByName(fresh.select(*events.columns))


def append_events(events: DataFrame, changes: DataFrame, at: Column | None = None) -> DataFrame:
    """The history with changes (document_id, field, value, error_message; ``n`` orders those of one document) behind it.

    A change of a document or field that does not exist fails the job. Only the last
    number of each document is looked up, a grouped maximum.
    """
    last = events.groupBy("document_id").agg(F.max("seq").alias("__last"))
    met = changes.join(last, "document_id", "left")
    missing = F.raise_error(F.concat(F.lit("Document not found: "), F.coalesce("document_id", F.lit("null"))))
    seq = F.when(F.col("__last").isNull(), missing.cast("long")).otherwise(F.col("__last") + F.col("n"))
    field = F.when(F.col("field").isin(*FIELDS), F.col("field")).otherwise(F.raise_error(F.concat(F.lit("Unknown field: "), "field")))
    fresh = met.select("document_id", seq.cast("long").alias("seq"), field.alias("field"), "value", "error_message", (at if at is not None else F.current_timestamp()).alias("at"))
    return events.unionByName(fresh.select(*events.columns))


def _changes(documents: DataFrame, **fields: Column) -> DataFrame:
    error = F.col("error_message") if "error_message" in documents.columns else F.lit(None).cast("string")
    listed = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(f).alias("field"), v.cast("string").alias("value")) for n, (f, v) in enumerate(fields.items(), 1)))
    return documents.select("document_id", error.alias("error_message"), F.explode(listed).alias("e")).select("document_id", "e.n", "e.field", "e.value", "error_message")


def set_status(events: DataFrame, documents: DataFrame, status: str) -> DataFrame:
    """Documents (document_id, error_message if any) enter a status; unknown ones fail the job."""
    if status not in vocab.STATUSES:
        raise ValueError(f"unknown status: {status}")
    return append_events(events, _changes(documents, status=F.lit(status)))


def mark_ready(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, page_count) are ready, parsed by the present version."""
    return append_events(events, _changes(documents, page_count=F.col("page_count"), ingestion_version=F.lit(vocab.INGESTION_VERSION), status=F.lit("ready")))


def mark_failed(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, error_message) have failed; a missing message becomes the general one."""
    return append_events(events, _changes(documents.withColumn("error_message", T.summarize_error(F.col("error_message"))), status=F.lit("failed")))


def set_run(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, workflow_run_id) are worked on by a run."""
    return append_events(events, _changes(documents, workflow_run_id=F.col("workflow_run_id")))


def set_parsed(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, outline, parser_meta, page_count) carry what a parser found; the first two as JSON."""
    return append_events(events, _changes(documents, outline=F.to_json("outline"), parser_meta=F.to_json("parser_meta"), page_count=F.col("page_count")))


def read_document(events: DataFrame, document_id: str) -> DataFrame:
    """The present state of one document; its history is filtered before it is grouped."""
    return current_state(events.filter(F.col("document_id") == document_id))


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document (column id) does not exist."""
    return chunks.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")


def status_step(status: Column) -> Column:
    """Position of a status in the life of a document, from 1; failed is last, unknown is null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, vocab.STATUSES)), status), F.lit(0))


def is_local_parser(meta: Column) -> Column:
    found = (F.try_element_at(meta, F.lit("provider")) == LOCAL_PROVIDER) | F.try_element_at(meta, F.lit("mode")).isin(*LOCAL_MODES)
    return F.coalesce(found, F.lit(False))


def needs_reingestion(status: Column, meta: Column, version: Column) -> Column:
    """Ready, parsed locally, and by another version than the present one; a version that is no number is another one."""
    return F.coalesce(status == "ready", F.lit(False)) & is_local_parser(meta) & ~F.equal_null(version, F.lit(vocab.INGESTION_VERSION))


def public_documents(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """What a reader sees of documents: no storage path, but the source's address, staleness, chunk count and status label."""
    rows = documents.join(counts.select(F.col("document_id").alias("id"), "chunk_count"), "id", "left")
    return rows.drop("blob_path").withColumns(
        {
            "chunk_count": F.coalesce("chunk_count", F.lit(0)),
            "source_url": F.concat(F.lit("/api/documents/"), F.col("id"), F.lit("/source")),
            "needs_reingestion": needs_reingestion(F.col("status"), F.col("parser_meta"), F.col("ingestion_version")),
            "status_label": T.status_label(F.col("status")),
        }
    )


def gate_questions(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``error`` to questions: too short, unknown mode, missing document, not ready, or stale; null if it may be asked.

    A missing mode is ``answer``; a history, where that column is, is empty if it is null.
    """
    if "history" in questions.columns:
        questions = questions.withColumn("history", F.coalesce("history", F.lit("")))
    state = documents.select(F.col("id").alias("document_id"), "status", needs_reingestion(F.col("status"), F.col("parser_meta"), F.col("ingestion_version")).alias("__stale"))
    rows = questions.withColumn("mode", F.coalesce("mode", F.lit("answer"))).join(state, "document_id", "left")
    error = (
        F.when((F.length(T.trim(F.coalesce("question", F.lit("")))) < 3) | ~F.col("mode").isin("answer", "draft"), "Invalid question.")
        .when(F.col("status").isNull(), "Document not found.")
        .when(F.col("status") != "ready", "The PDF is still processing. Wait until the document is ready.")
        .when(F.col("__stale"), "This PDF is refreshing its document map. Please wait a moment and ask again.")
    )
    return rows.withColumn("error", error).drop("status", "__stale")


def ingest_layout(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outline, chunks, documents) of parsed text items: lines, cleanup, segmentation; one row a document with its counts.

    A document whose pages leave no line fails with a message.
    """
    lines = layout.clean_pages(layout.layout_from_items(items))
    sections = chunking.outline(chunking.layout_lines(lines))
    chunks = chunking.chunk_layout(lines)
    return sections, chunks, _summaries(items.select("document_id").distinct(), lines.groupBy("document_id").agg(F.countDistinct("page").alias("page_count")), chunks, "layout")


def ingest_markdown(pages: DataFrame, target: int = vocab.CHUNK_TARGET_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outline, chunks, documents) of markdown pages; blank pages do not count."""
    full = pages.filter(T.trim(F.col("text")) != "")
    sections = chunking.outline(chunking.markdown_lines(full))
    chunks = chunking.chunk_markdown(full, target)
    return sections, chunks, _summaries(pages.select("document_id").distinct(), full.groupBy("document_id").agg(F.countDistinct("page").alias("page_count")), chunks, "markdown")


def _summaries(known: DataFrame, pages: DataFrame, chunks: DataFrame, form: str) -> DataFrame:
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rows = known.join(pages, "document_id", "left").join(n, "document_id", "left")
    ready = F.col("page_count").isNotNull()
    return rows.select(
        "document_id",
        F.when(ready, "ready").otherwise("failed").alias("status"),
        F.when(~ready, "The local PDF parser could not extract text from this file.").alias("error_message"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.lit(form).alias("content_format"),
        F.lit(vocab.INGESTION_VERSION).alias("ingestion_version"),
    )


def classify_errors(rows: DataFrame) -> DataFrame:
    """Adds ``fatal`` to rows with error_message: encrypted files are not worth another try."""
    return rows.withColumn("fatal", T.password_protected(F.col("error_message")))
