"""Questions of few characters meet any number of chunks: what moves is narrow, and results are those of the plain path."""

import random

from pyspark.sql import functions as F

from citeweave.operators import rerank, search
from citeweave.plans import registry, views

CHUNK = "document_id string, id string, page_from int, page_to int, section_path array<string>, chunk_type string, text string, ord long"
SMALL = "/root/testdata/sf0.001"
QUESTIONS = (
    "How should the lime floor be cured after laying?",
    "What tools or methods are used for compaction?",
    "Can a bamboo stick be used?",
    "What ratio of fat lime, sand and ash does the mix need?",
    "Which 3 sections mention the cost per kg?",
    "river stone",
)
WORDS = "lime sand ash water mix cured curing tools rammer bamboo compaction ratio 25kg 72 hours cost kg river stone yes no measure by volume the of step lay".split()
PATHS = ([], ["A"], ["A", "CURING REGIME"], ["Tools"], ["B", "2 Mix"], ["River stone"])
KINDS = ("paragraph", "table", "procedure", "list")


def workspace(spark, seed, documents=("d", "e", "f"), n=150, pages=40):
    """Chunks of several documents, copies among them, and questions on all but the last document."""
    draw, rows = random.Random(seed), []
    for d in documents:
        for i in range(n):
            page = draw.randrange(1, pages)
            text = " ".join(draw.choice(WORDS) for _ in range(draw.choice((1, 4, 12))))
            kind = draw.choice((*KINDS, "faq"))
            if kind == "faq":
                text = f"Question: {draw.choice(QUESTIONS)}\nAnswer: {text}"
            rows.append((d, f"c{i}", page, page, draw.choice(PATHS), kind, text, i))
    asked = [(10 * i + j, d, q) for i, q in enumerate(QUESTIONS) for j, d in enumerate(documents[:-1])]
    return spark.createDataFrame(asked, "qid long, document_id string, question string"), spark.createDataFrame(rows, CHUNK)


def test_patterns_are_looked_for_where_asked(spark):
    asked, chunks = workspace(spark, 1)
    # a document of one question alone: all other patterns are passed over there
    asked = asked.filter("document_id = 'd' or qid = 21")
    held = {few is None: sorted(map(tuple, rerank.scored(asked, chunks, few).select("qid", "id", F.round("first", 9), F.round("base", 9), *(f"f_{k}" for k in ("hay", "title"))).collect())) for few in (None, search.at_hand(asked))}
    assert held[True] == held[False] and len(held[True]) == 150 * (len(QUESTIONS) + 1)


def test_rerank_base_moves_no_texts(spark):
    plan = registry.QUERIES["rerank_base"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Join Inner, (document_id" in line]
    assert met and all("strategy=broadcast" in line for line in met)
    assert search.at_hand(views.whole_questions(spark, SMALL)).count() == 40


def rows_of(frame):
    return sorted((r.qid, r.place, r.id, r.text, r.question, tuple(r.section_path), r.page_from, round(r.score, 9)) for r in frame.collect())


def test_best_is_the_plain_path(spark):
    """Thousands of pairs with ties, copies and many pages; also without the broadcast, where questions are too many."""
    for seed, limit, n, pages in ((2, 12, 400, 300), (3, 3, 300, 6)):
        asked, chunks = workspace(spark, seed, n=n, pages=pages)
        chunks = chunks.union(chunks.filter("id = 'c7'")).cache()
        plain = rerank.diversify(rerank.rerank(rerank.candidates(asked, rerank.with_features(search.index_chunks(chunks)))), limit)
        want = [r[:-1] for r in rows_of(plain)]
        found = rerank.best(asked, chunks, limit)
        assert [r[:-1] for r in rows_of(found)] == want and found.groupBy("qid").count().filter(f"count != {limit}").isEmpty()
    limit, search.HANDED_OUT = search.HANDED_OUT, 0
    try:
        assert [r[:-1] for r in rows_of(rerank.best(asked, chunks, 3))] == want
    finally:
        search.HANDED_OUT = limit


def test_pairs_that_move_have_no_texts(spark, tmp_path):
    """What retrieval writes for every pair are scores and places; questions that meet nothing and absent pages are no failure."""
    asked, chunks = workspace(spark, 4, n=30)
    chunks = chunks.withColumn("page_to", F.when(F.col("ord") % 3 != 0, F.col("page_to"))).withColumn("page_from", F.when(F.col("ord") % 4 != 0, F.col("page_from")))
    found = rerank.best(asked, chunks, 12)
    assert found.count() == 12 * asked.count() and found.filter("text is null").isEmpty()
    assert rerank.best(asked.filter("false"), chunks, 12).isEmpty()
    assert rerank.best(asked, chunks.filter("false"), 12).isEmpty()
