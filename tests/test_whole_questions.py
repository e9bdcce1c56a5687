"""Questions are whole benchmark texts, asked of workspaces that are there."""

import pytest

from citeweave.plans import registry, views

SF = "/root/testdata/sf0.001"
HEAD = "one common opening of eight words stands here"


@pytest.fixture
def tables(spark, tmp_path):
    documents = [(1, f"{HEAD}\nquarries yield granite blocks\nnothing of note", "en", "beta"), (2, f"{HEAD}\nsailors mended canvas", "en", "alpha"), (3, "no source", "en", None)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    benchmark = [(0, f"{HEAD} canvas sailors mended"), (1, f"{HEAD} granite quarries\nyield blocks"), (-1, f"{HEAD} granite")]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_whole_texts_are_asked_of_workspaces_present(spark, tables):
    got = {r.qid: (r.document_id, r.question) for r in views.whole_questions(spark, tables).collect()}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    assert got == {q: ("alpha" if q == 0 else "beta", t) for q, t in texts.items()}
    asked = {r.question for r in views.whole_questions(spark, SF).collect()}
    assert asked == {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


@pytest.mark.parametrize("name", ["retrieve_chunks", "hybrid_search"])
def test_words_behind_the_eighth_find_chunks(spark, tables, name):
    got = {(r.qid, r.id) for r in registry.QUERIES[name](spark, tables).collect()}
    assert {(0, "2-1"), (1, "1-1"), (-1, "1-1")} <= got


def test_prompts_and_answers_cover_every_question(spark, tables):
    prompts = {r.qid: r.prompt for r in registry.QUERIES["answer_prompts"](spark, tables).collect()}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    assert set(prompts) == set(texts) and all(texts[q] in prompts[q] for q in texts)
    assert {r.qid for r in registry.QUERIES["grounded_answers"](spark, tables).collect()} == set(texts)


def test_base_scores_cover_every_candidate(spark):
    found = {(r.qid, r.id) for r in registry.QUERIES["local_search_scores"](spark, SF).collect()}
    scored = [(r.qid, r.id) for r in registry.QUERIES["rerank_base"](spark, SF).collect()]
    assert len(scored) == len(set(scored)) > 32 * 40 and set(scored) == found
