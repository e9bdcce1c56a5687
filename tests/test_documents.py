"""Stores, document lifecycle, settings, and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.functions import vocab
from citeweave.operators.answer import NOT_FOUND
from citeweave.plans import lifecycle, providers
from citeweave.plans.runtime import Settings
from citeweave.sources import schemas, store
from citeweave.streaming import ingest

CHUNK = "document_id string, id string, text string"


def test_version_gate(spark):
    rows = [("a", "ready", {"provider": "pdf-parse"}, vocab.INGESTION_VERSION - 1), ("b", "ready", {"provider": "pdf-parse"}, vocab.INGESTION_VERSION), ("c", "ready", {"provider": "cloud"}, 1), ("d", "ready", {"mode": "local-text-parser"}, None), ("e", "parsing", {"provider": "pdf-parse"}, 1), ("f", "ready", None, None)]
    frame = spark.createDataFrame(rows, "id string, status string, meta map<string,string>, version int")
    stale = {r.id for r in frame.filter(lifecycle.needs_reingestion(F.col("status"), F.col("meta"), F.col("version"))).collect()}
    assert stale == {"a", "d"}


def test_history_gives_the_present(spark):
    events = [("d", 1, "status", "uploaded", None), ("d", 3, "status", "failed", "boom"), ("d", 2, "status", "parsing", None), ("d", 4, "page_count", "7", None), ("e", 5, "status", "ready", None), ("e", 4, "status", "failed", "old")]
    frame = spark.createDataFrame([(*e, None) for e in events], schemas.EVENTS)
    got = {r.document_id: (r.status, r.error_message, r.page_count) for r in lifecycle.current_state(frame).collect()}
    assert got == {"d": ("failed", "boom", "7"), "e": ("ready", None, None)}
    assert spark.range(1).select(lifecycle.status_step(F.lit("chunking")), lifecycle.status_step(F.lit("nope"))).first()[:] == (3, None)


def documents(spark):
    rows = [("a", "ready", {"provider": "cloud"}, 3), ("b", "parsing", None, None), ("c", "ready", {"provider": "pdf-parse"}, 1)]
    return spark.createDataFrame([(*r, "p") for r in rows], "id string, status string, parser_meta map<string,string>, ingestion_version int, blob_path string")


def test_gates(spark):
    asked = [(1, "a", "fine question", None), (2, "a", " x ", "answer"), (3, "zz", "fine question", "draft"), (4, "b", "fine question", "answer"), (5, "c", "fine question", "answer"), (6, "a", "fine question", "poem")]
    got = {r.qid: r.error for r in lifecycle.gate_questions(spark.createDataFrame(asked, "qid long, document_id string, question string, mode string"), documents(spark)).collect()}
    assert got[1] is None and got[2] == got[6] == "Invalid question." and got[3] == "Document not found." and "processing" in got[4] and "refreshing" in got[5]


def test_public_documents(spark):
    counts = spark.createDataFrame([("a", 4)], "document_id string, chunk_count long")
    got = {r.id: r for r in lifecycle.public_documents(documents(spark), counts).collect()}
    assert "blob_path" not in got["a"].asDict() and got["a"].chunk_count == 4 and got["b"].chunk_count == 0
    assert got["c"].needs_reingestion and got["b"].status_label == "Parsing PDF" and got["a"].source_url == "/api/documents/a/source"


def test_chunks_are_replaced_by_bucket(spark, tmp_path):
    path = str(tmp_path / "chunks")
    store.write_chunks(spark.createDataFrame([(f"d{i}", f"c{i}-{j}", "old") for i in range(20) for j in range(3)], CHUNK), path)
    stored = store.read_chunks(spark, path)
    fresh = spark.createDataFrame([("d3", "n", "new")], CHUNK)
    got = store.replace_chunks(stored, fresh)
    assert got.count() == 58 and [r.id for r in got.filter("document_id = 'd3'").collect()] == ["n"]
    one = store.read_chunks(spark, path, "d7")
    assert one.count() == 3 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert store.without_deleted(stored, fresh).count() == 57
    counted = {r.document_id: r.chunk_count for r in store.chunk_counts(spark.createDataFrame([("d1",), ("none",)], "id string"), stored).collect()}
    assert counted == {"d1": 3, "none": 0}


def test_json_store(spark, tmp_path):
    path = tmp_path / "store.json"
    path.write_text(json.dumps({"documents": [{"id": "d", "filename": "f.pdf", "status": "ready", "pageCount": 2}], "chunks": [{"id": "c", "documentId": "d", "sourceId": "src-0001", "pageFrom": 1, "pageTo": 1, "sectionPath": [None, "T"], "chunkType": "list", "text": "x"}]}, indent=2))
    docs, chunks = store.read_json_store(spark, str(path))
    assert docs.first().pageCount == 2 and chunks.first().section_path == [None, "T"]
    out = str(tmp_path / "out")
    store.write_json_store(docs, chunks, out)
    again = store.read_json_store(spark, out)
    assert again[0].collect() == docs.collect() and again[1].collect() == chunks.collect()
    store.write_json_store(again[0].limit(0), again[1], out)
    assert store.read_json_store(spark, out)[0].count() == 0 and store.read_json_store(spark, out)[1].count() == 1


def test_kept_sources(spark, tmp_path):
    files = spark.createDataFrame([("d1", "a b.pdf", bytearray(b"%PDF-1")), ("d2", "", bytearray(b"x"))], "document_id string, filename string, content binary")
    got = {r.document_id: (r.blob_path, r.length) for r in store.save_source(files, str(tmp_path / "blobs")).collect()}
    assert got == {"d1": ("documents/d1/a-b.pdf", 6), "d2": ("documents/d2/document.pdf", 1)}
    assert bytes(store.read_saved_source(spark, str(tmp_path / "blobs"), "d1").first().content) == b"%PDF-1"


def test_documents_are_written(spark):
    none = spark.createDataFrame([], schemas.EVENTS)
    new = spark.createDataFrame([("d", "f.pdf", "p"), ("e", "g.pdf", "q")], "id string, filename string, blob_path string")
    events = lifecycle.create_documents(none, new)
    one = spark.createDataFrame([("d", 7, "run-1", None)], "document_id string, page_count int, workflow_run_id string, error_message string")
    events = lifecycle.mark_ready(lifecycle.set_run(lifecycle.set_status(events, one, "parsing"), one), one)
    got = {r.document_id: r for r in lifecycle.current_state(events).collect()}
    assert (got["d"].status, got["d"].page_count, got["d"].workflow_run_id, got["d"].filename, got["d"].ingestion_version) == ("ready", "7", "run-1", "f.pdf", str(vocab.INGESTION_VERSION))
    assert got["e"].status == "uploaded" and lifecycle.read_document(events, "e").first().blob_path == "q"
    failed = lifecycle.mark_failed(events, spark.createDataFrame([("e", None)], "document_id string, error_message string"))
    assert lifecycle.read_document(failed, "e").first().error_message == "An unexpected error occurred."
    parsed = spark.createDataFrame([("d", [("outline-1", "T")], {"provider": "x"}, 2)], "document_id string, outline array<struct<id:string,title:string>>, parser_meta map<string,string>, page_count int")
    assert json.loads(lifecycle.read_document(lifecycle.set_parsed(events, parsed), "d").first().outline) == [{"id": "outline-1", "title": "T"}]
    for broken in (lambda: lifecycle.set_status(events, one.withColumn("document_id", F.lit("zz")), "ready"), lambda: lifecycle.create_documents(events, new)):
        with pytest.raises(Exception, match="Document not found: zz|Document exists"):
            broken().collect()
    with pytest.raises(ValueError):
        lifecycle.set_status(events, one, "done")
    chunks = spark.createDataFrame([("d", "c"), ("zz", "c2")], "document_id string, id string")
    assert [r.id for r in lifecycle.orphans(chunks, new).collect()] == ["c2"]


def test_iso_times(spark):
    got = spark.sql("SELECT timestamp_micros(1700000000123456) AS t").select(T.iso_time(F.col("t"))).first()[0]
    assert got == "2023-11-14T22:13:20.123Z"


def test_providers(spark):
    # inside the test, so that workers get the functions themselves
    def _pages_of(content):
        if content == b"locked":
            raise ValueError("File is encrypted")
        return content.decode().split("|")

    def _answerer(system, prompt):
        assert "usedSourceIds" in system
        return json.dumps({"clear": {"type": "answer", "answer": "Yes [S2].", "usedSourceIds": ["S2", "S9", "S2"], "missing": ["a", "a"]}, "vague": {"type": "clarification", "answer": "Which one?"}, "empty": {"type": "answer", "answer": ""}}.get(prompt, {"type": "poem"}))

    sources = spark.createDataFrame([("d", bytearray(b"# A|two")), ("e", bytearray(b"locked")), ("f", bytearray(b""))], "document_id string, content binary")
    pages, failures = providers.parse_pages(sources, _pages_of)
    assert sorted((r.document_id, r.page, r.text) for r in pages.collect()) == [("d", 1, "# A"), ("d", 2, "two"), ("f", 1, "")]
    assert [(r.document_id, r.error_message, r.fatal) for r in failures.collect()] == [("e", "File is encrypted", True)]
    items, _ = providers.parse_items(sources.limit(1), lambda content: [(1, "x", [1, 0, 0, 1, 5, 6])])
    assert items.first()[:] == ("d", 1, 0, "x", [1.0, 0.0, 0.0, 1.0, 5.0, 6.0])
    chunks = spark.createDataFrame([(f"c{i}", "x" * i) for i in range(40)], "id string, text string").coalesce(1)
    sizes = providers.embed(chunks, lambda texts: [[len(t), len(texts)] for t in texts], 2).collect()
    assert {r.id: r.vector[0] for r in sizes} == {f"c{i}": float(i) for i in range(40)} and {r.vector[1] for r in sizes} == {16.0, 8.0}
    with pytest.raises(Exception, match="must give"):
        providers.embed(chunks, lambda texts: [[0.0]], 2).collect()
    prompts = spark.createDataFrame([(1, "clear"), (2, "vague"), (3, "empty")], "qid long, prompt string")
    shown = spark.createDataFrame([(1, "S1"), (1, "S2")], "qid long, label string")
    got = {r.qid: r[1:] for r in providers.hosted_answers(prompts, shown, _answerer).collect()}
    assert got == {1: ("answer", "Yes [S2].", None, ["S2"], ["a"]), 2: ("clarification", "Which one?", "Which one?", [], []), 3: ("answer", NOT_FOUND, None, [], [])}
    with pytest.raises(Exception, match="no answer by the schema"):
        providers.hosted_answers(prompts.withColumn("prompt", F.lit("odd")), shown, _answerer).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "big.pdf").write_bytes(b"x" * 1_200_000)
    got = store.scan_sources(spark, str(tmp_path), max_mb=1).select("content").collect()
    assert [bytes(r.content) for r in got] == [b"%PDF-1"] and bytes(store.read_source(spark, str(tmp_path / "a.PDF")).first().content) == b"%PDF-1"
    uploads = spark.createDataFrame([("x.pdf", None, 5), ("x.doc", "text/plain", 5), ("y", "application/pdf", 10**9), ("a b.pdf", "", 1)], "filename string, mime string, length long")
    got = [(r.error, r.blob_name) for r in store.validate_uploads(uploads).collect()]
    assert got == [(None, "x.pdf"), ("Only PDF uploads are supported.", "x.doc"), ("This file exceeds the 50 MB upload limit.", "y"), (None, "a-b.pdf")]


def test_ingestion(spark):
    pages = spark.createDataFrame([("d", 1, "# A\ntext"), ("d", 2, "  "), ("e", 1, "\n")], ingest.PAGES)
    outline, chunks, summaries = lifecycle.ingest_markdown(pages)
    got = {r.document_id: (r.status, r.page_count, r.chunk_count) for r in summaries.collect()}
    assert got == {"d": ("ready", 1, 1), "e": ("failed", 0, 0)} and outline.count() == 1 and chunks.count() == 1
    items = spark.createDataFrame([("d", 1, i, s, [12.0, 0.0, 0.0, 12.0, 40.0, 800.0 - 20 * i]) for i, s in enumerate(["some ordinary line of prose", "and one more line of it"])], schemas.ITEMS)
    outline, chunks, summaries = lifecycle.ingest_layout(items)
    assert chunks.first().text == "some ordinary line of prose\nand one more line of it" and summaries.first().status == "ready"
    assert lifecycle.classify_errors(spark.createDataFrame([("needs a password",), (None,)], "error_message string")).collect()[0].fatal


def test_streaming_ingestion_is_repeatable(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    spark.createDataFrame([("d", 1, "# A\none"), ("e", 1, "two")], ingest.PAGES).write.parquet(source)
    ingest.ingest_stream(ingest.stream_pages(spark, source), table, check).awaitTermination()
    assert {r.text for r in store.read_chunks(spark, table).collect()} == {"A\none", "two"}
    spark.createDataFrame([("d", 1, "# A\nthree")], ingest.PAGES).write.mode("append").parquet(source)
    ingest.ingest_stream(ingest.stream_pages(spark, source), table, check).awaitTermination()
    spark.catalog.clearCache()
    assert {r.text for r in spark.read.parquet(table).collect()} == {"A\nthree", "two"}


def test_streamed_pages_join_their_documents(spark, tmp_path):
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    for page, text in ((1, "# A\nfirst page"), (2, "second page"), (1, "# B\nfirst again")):
        spark.createDataFrame([("d", page, text)], ingest.PAGES).write.mode("append").parquet(source)
        ingest.ingest_stream(ingest.stream_pages(spark, source), table, check).awaitTermination()
    got = spark.read.parquet(table).collect()
    assert [(r.page_from, r.text) for r in sorted(got, key=lambda r: r.ord)] == [(1, "B\nfirst again"), (2, "B\nsecond page")]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["check", "in", "table", "table-pages"]


NAMES = {"database": ("DB_URL",), "storage": ("BLOB_TOKEN",), "hosted": ("HOSTED", "HOSTED_ENV"), "ai": ("AI_KEY",), "parser": ("PARSER_KEY",)}


def test_settings():
    local = Settings.load({}, NAMES)
    assert local.readiness().deployment == "local" and local.readiness().uploads_enabled and local.inline_ingestion and local.chunk_target_tokens == 800
    bare = Settings.load({"HOSTED": "1"}, NAMES)
    assert bare.readiness().status == "setup-required" and bare.readiness().missing == ("DB_URL", "BLOB_TOKEN") and bare.inline_ingestion
    with pytest.raises(RuntimeError, match="DB_URL, BLOB_TOKEN"):
        bare.require_uploads()
    full = Settings.load({"HOSTED_ENV": "1", "DB_URL": "x", "BLOB_TOKEN": "y", "MAX_UPLOAD_MB": "9"}, NAMES)
    assert full.readiness().status == "ready" and not full.inline_ingestion and full.max_upload_mb == 9 and full.capabilities()["ai"] == "local-heuristic"
    assert Settings.load({"HOSTED": "1"}).readiness().deployment == "local" and Settings.load({"AI_KEY": "k"}, NAMES).capabilities()["ai"] == "hosted-model"
    for env, names in (({"VECTOR_DIMENSIONS": "many"}, NAMES), ({}, {"colour": ("X",)})):
        with pytest.raises(ValueError):
            Settings.load(env, names)
