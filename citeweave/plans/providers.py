"""Adapters for what is called outside: parsers, embedding models, answer models.

A provider is a plain callable that runs on executors, on one file or a bounded batch at
a time. The adapters give it its rows, check what it returns against a schema, fill in
defaults, and turn its failures into rows. Retries of a lost task call it again, so a
provider should not mind the same request twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import citations
from ..operators.answer import CLARIFY, NOT_FOUND

#: Bytes of a source to its pages as markdown, in order.
PageParser = Callable[[bytes], list[str]]
#: Bytes of a source to text items of pages: (page, text, transform of six numbers).
ItemParser = Callable[[bytes], list[tuple[int, str, list[float]]]]
#: Texts, at most ``EMBED_BATCH`` of them, to their vectors.
Embedder = Callable[[list[str]], list[list[float]]]
#: System prompt and prompt to a JSON object as text.
Answerer = Callable[[str, str], str]

EMBED_BATCH = 16

_PAGES = pa.schema([("document_id", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error_message", pa.string())])
_ITEMS = pa.schema([("document_id", pa.string()), ("page", pa.int32()), ("item_no", pa.int32()), ("str", pa.string()), ("transform", pa.list_(pa.float64())), ("error_message", pa.string())])


class _Parse:
    """One source at a time; a failure is one row that has only the id and its message."""

    def __init__(self, parser: Callable, schema: pa.Schema, rows: Callable[[list], list[tuple]]):
        self.parser, self.schema, self.rows = parser, schema, rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("document_id")[i].as_py()
                try:
                    found = [(key, *r, None) for r in self.rows(self.parser(batch.column("content")[i].as_py()))]
                except Exception as e:  # what a parser raises is the document's state, not the job's
                    found = [(key, *[None] * (len(self.schema) - 2), str(e) or type(e).__name__)]
                columns = list(zip(*found, strict=True)) or [()] * len(self.schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _number(pages: list[str]) -> list[tuple]:
    return [(n, text) for n, text in enumerate(pages, 1)]


def _place(items: list[tuple]) -> list[tuple]:
    return [(page, n, text, list(map(float, transform))) for n, (page, text, transform) in enumerate(items)]


def parse_pages(sources: DataFrame, parser: PageParser) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of sources (document_id, content): document_id, page, text; and document_id, error_message, fatal."""
    rows = sources.select("document_id", "content").mapInArrow(_Parse(parser, _PAGES, _number), "document_id string, page int, text string, error_message string")
    return rows.filter("error_message is null").drop("error_message"), _failures(rows)


def parse_items(sources: DataFrame, parser: ItemParser) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of sources (document_id, content), items as ``layout.layout_from_items`` takes them."""
    rows = sources.select("document_id", "content").mapInArrow(
        _Parse(parser, _ITEMS, _place), "document_id string, page int, item_no int, str string, transform array<double>, error_message string"
    )
    return rows.filter("error_message is null").drop("error_message"), _failures(rows)


def _failures(rows: DataFrame) -> DataFrame:
    failed = rows.filter("error_message is not null").select("document_id", "error_message")
    return failed.withColumn("fatal", T.password_protected(F.col("error_message")))


class _Embed:
    def __init__(self, embedder: Embedder, dimensions: int):
        self.embedder, self.dimensions = embedder, dimensions

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_BATCH):
                part = batch.slice(at, EMBED_BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                vectors = self.embedder(texts)
                if len(vectors) != len(texts) or any(len(v) != self.dimensions for v in vectors):
                    raise ValueError(f"the embedder must give {len(texts)} vectors of {self.dimensions} numbers")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))], ["id", "vector"])


def embed(chunks: DataFrame, embedder: Embedder, dimensions: int = vocab.VECTOR_DIMENSIONS) -> DataFrame:
    """id and vector of every chunk (id, text), ``EMBED_BATCH`` texts a call; a wrong number or size of vectors fails the job."""
    return chunks.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(_Embed(embedder, dimensions), "id string, vector array<double>")


class _Ask:
    def __init__(self, answerer: Answerer):
        self.answerer = answerer

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [self.answerer(citations.SYSTEM_PROMPT, p) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(said, pa.string())], ["qid", "said"])


_SAID = "struct<type:string,answer:string,clarifyingQuestion:string,usedSourceIds:array<string>,missing:array<string>>"


def hosted_answers(prompts: DataFrame, retrieved: DataFrame, answerer: Answerer) -> DataFrame:
    """Answers of a model to prompts (qid, prompt), in the form of ``answer.answers``.

    What is missing or empty gets its default; a type that is neither ``answer`` nor
    ``clarification``, and a reply that is no JSON object, fail the job. Cited ids that
    are no label of the question's excerpts are dropped, repeated ones counted once.
    """
    replies = prompts.select(F.col("qid").cast("long").alias("qid"), "prompt").mapInArrow(_Ask(answerer), "qid long, said string")
    labels = retrieved.groupBy("qid").agg(F.collect_set("label").alias("labels"))
    rows = replies.withColumn("r", F.from_json("said", _SAID)).join(labels, "qid", "left")
    none = F.expr("cast(array() as array<string>)")
    asks = F.col("r.type") == "clarification"
    bad = F.raise_error(F.concat(F.lit("no answer by the schema: "), F.substring(F.coalesce("said", F.lit("")), 1, 200)))
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "qid",
        F.when(F.col("r.type").isin("answer", "clarification"), F.col("r.type")).otherwise(bad).alias("type"),
        F.coalesce(full("r.answer"), F.when(asks, F.lit("")).otherwise(F.lit(NOT_FOUND))).alias("answer"),
        F.when(asks, F.coalesce(full("r.clarifyingQuestion"), full("r.answer"), F.lit(CLARIFY))).alias("clarifying_question"),
        citations.allowed_citations(F.coalesce("r.usedSourceIds", none), F.coalesce("labels", none)).alias("used_source_ids"),
        F.array_distinct(F.coalesce("r.missing", none)).alias("missing"),
    )
