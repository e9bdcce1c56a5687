"""What grounded answers compute for every pair of question and chunk: once, as batches, and in methods that the JVM compiles."""

import math
import random

import pytest

from citeweave.functions import kernels, vocab
from citeweave.operators import rerank, search
from citeweave.plans import views
from citeweave.sources.scratch import small_methods

SMALL = "/root/testdata/sf0.001"
WORDS = "lime sand ash Water mixes cured Kelvin İstanbul naïve x 25kg 72 studies glass the river river- stone_wall".split()
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def plain(asked, path, text):
    """Hits and cosine of one chunk and one question, word by word."""
    q_terms, q, square = asked
    found = kernels.slots(text, vocab.VECTOR_DIMENSIONS)
    total = sum(v * v for v in found.values())
    inner = norm = 0.0
    for slot, v in found.items():
        value = kernels._units[v, total]
        norm += value * value
        inner += q.get(slot, 0.0) * value
    return len(set(q_terms) & {*kernels.terms(path), *kernels.terms(text)}), inner / math.sqrt(square * norm) if inner > 0 else 0.0


def test_batches_are_word_by_word(monkeypatch):
    draw = random.Random(7)
    text = lambda n: " ".join(draw.choice((*WORDS, f"word{draw.randrange(300)}")) for _ in range(n))
    questions = {}
    for d, n in (("a", 5), ("b", 1), ("none", 0)):
        for q in (*(text(30) for _ in range(n)), *[""] * (d == "a")):
            found = kernels.slots(q, vocab.VECTOR_DIMENSIONS)
            total = sum(v * v for v in found.values())
            units = {slot: kernels._units[v, total] for slot, v in found.items()}
            questions.setdefault(d, []).append((list(dict.fromkeys(kernels.terms(q))), units, sum(v * v for v in units.values())))
    asked = {}
    for d, own in questions.items():
        for one in own:
            asked.setdefault(d, kernels.Asked()).add(*one)
    # texts of many repeats and of many words leave the table of values
    texts = [text(draw.choice((0, 1, 8, 60))) for _ in range(300)] + ["river " * 50, text(9000), ""]
    documents = [draw.choice(("a", "b", "c", "none")) for _ in texts[:-2]] + ["a", "b"]
    paths = [draw.choice(("", "Lime", "word7 river")) for _ in texts]
    for at_once, remembered in ((kernels.AT_ONCE, kernels.REMEMBERED), (3_000, 20)):
        monkeypatch.setattr(kernels, "AT_ONCE", at_once)
        monkeypatch.setattr(kernels, "REMEMBERED", remembered)
        meeting = kernels.Meeting(asked, vocab.VECTOR_DIMENSIONS)
        runs = list(meeting.slices(documents, texts))
        assert [i for s in runs for i in range(s.start, s.stop)] == list(range(len(texts)))
        met = []
        for s in runs:
            sizes, hits, similar = meeting.meet(documents[s], paths[s], texts[s])
            assert sizes.tolist() == [len(questions.get(d, ())) for d in documents[s]]
            met += zip(hits.tolist(), similar.tolist(), strict=True)
        assert met == [plain(q, p, t) for d, p, t in zip(documents, paths, texts, strict=True) for q in questions.get(d, ())]


def test_chunks_meet_questions_once(spark):
    """A filter on nulls that the kernel never gives made Spark compute it a second time, below the join."""
    asked = views.whole_questions(spark, SMALL)
    rows = rerank.scored(asked, views.workspace_chunks(spark, SMALL), search.at_hand(asked)).select("qid", "id", "base")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sum("meet(" in line for line in plan.splitlines() if "ArrowEvalPython" in line) == 1


def test_pairs_are_written_by_compiled_methods(spark, monkeypatch):
    seen, before = {}, spark.conf.get(LIMIT)
    write = rerank.materialize
    monkeypatch.setattr(rerank, "materialize", lambda rows, name: seen.setdefault(name, spark.conf.get(LIMIT)) and write(rows, name))
    asked = views.whole_questions(spark, SMALL).filter("qid < 4")
    assert not rerank.best(asked, views.workspace_chunks(spark, SMALL), 3).isEmpty()
    assert int(seen["pairs"]) <= 8000 and spark.conf.get(LIMIT) == before
    with pytest.raises(ValueError), small_methods(spark):
        raise ValueError
    assert spark.conf.get(LIMIT) == before
