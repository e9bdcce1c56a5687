"""Answers from small sets of excerpts."""

import pytest

from citeweave.operators import answer as A


def chunk(label, page, section, text, score, kind="paragraph", page_to=None):
    path = [section] if section else []
    body = f"{section}\n{text}" if section else text
    return {"label": label, "page_from": page, "page_to": page_to or page, "section_path": path, "chunk_type": kind, "text": body, "score": score}


MIX = [
    chunk("S1", 4, "1 PART LIME", "1 ASH\n2.5 river sand", 4.3),
    chunk("S2", 4, "1 PART LIME", "0.5 stone aggregate", 4.1),
    chunk("S3", 4, "1 PART LIME", "~1 water\n60 gram Booster 7", 4.4),
    chunk("S4", 4, "1 PART LIME", "for every 25kg bag of lime", 3.9),
]
CURING = [
    chunk("S1", 6, "CURING REGIME", "Keep the floor wet.\nDo not let it dry out in the first 72 hours.\nThen go on with daily watering.", 4.5),
    chunk("S2", 7, "CURING REGIME", "Wait 4-6 days after laying.\nThen begin the second layer.", 4.1),
]
TOOLS = [
    chunk("S1", 8, "COMPACTION", "Compact the surface by hand with heavy rammers.\nMore effort gives a denser floor.", 4.3),
    chunk("S2", 8, "COMPACTION", "Repeat 3-4 times a day until the tool bounces back.", 4.0),
    chunk("S3", 11, "FAQ COMPACTION", "Question: Can vibrators be used on the floor?\nAnswer: Vibrators can be used at first. Weighted rammers are needed later.", 4.6, "faq"),
    chunk("S4", 11, "FAQ COMPACTION", "Question: Can a bamboo stick be used for compaction?\nAnswer: It works very slowly.", 4.2, "faq"),
]
FAQ = [
    chunk("S1", 10, "FAQ SUBSTRATE", "Question: Can lime be laid over foam directly?\nAnswer: No! It does not hold on foam.", 4.8, "faq"),
    chunk("S2", 3, "SUBSTRATES", "Lime may be laid on stone or brick.", 2.8),
]
OTHER = [chunk("S1", 1, "WHY LIME?", "Lime gains strength over time.", 1.2), chunk("S2", 2, "SAFETY", "Use gloves and avoid contact.", 1.0)]


def test_mixture():
    got = A.answer("What is the mix ratio and water / booster requirement for lime?", "answer", MIX)
    assert got["type"] == "answer" and got["answer"].startswith(A.LEAD_VALUES)
    for part in ("1 PART LIME", "2.5 river sand", "60 gram Booster 7", "25kg bag"):
        assert part in got["answer"]
    assert {"S1", "S3", "S4"} <= set(got["used_source_ids"])


def test_mixture_leaves_prose_out():
    got = A.answer("What is the mix ratio and water / booster requirement for lime?", "answer", [*MIX, chunk("S5", 5, "MIXING", "Stir the lime into water to form a slurry.\nMeasure by weight.", 3.7)])
    assert "~1 water" in got["answer"] and "form a slurry" not in got["answer"]


def test_curing_steps_in_order():
    got = A.answer("What is the curing regime after laying?", "answer", CURING)
    lines = got["answer"].split("\n")
    assert lines[0] == A.LEAD_STEPS and lines[1].startswith("1. ") and set(got["used_source_ids"]) == {"S1", "S2"}
    assert [x for x in ("72 hours", "daily watering", "4-6 days") if x not in got["answer"]] == []


def test_curing_is_not_answered_by_laying():
    laying = chunk("S0", 6, "LAYING", "Wet the ground thoroughly.\nLay the lime in layers up to 4 inches thick.", 4.6)
    got = A.answer("How should the lime be cured after laying?", "answer", [laying, *CURING])
    assert "72 hours" in got["answer"] and "4-6 days" in got["answer"] and "Wet the ground" not in got["answer"]


def test_tools_from_text_and_faq():
    got = A.answer("What tools should be used for compaction?", "answer", TOOLS)
    assert "rammers" in got["answer"] and "Vibrators can be used" in got["answer"] and {"S1", "S2", "S3"} <= set(got["used_source_ids"])


def test_exact_faq_answers_alone():
    got = A.answer("Can lime be laid over foam directly?", "answer", FAQ)
    assert got["answer"] == "No.\n- No! It does not hold on foam. [S1]" and got["used_source_ids"] == ["S1"]


def test_unsupported_question():
    got = A.answer("What is the warranty period for exported shipments?", "answer", OTHER)
    assert got["answer"] == A.NOT_FOUND and got["used_source_ids"] == [] and got["missing"] == [A.NOTE_NOTHING]
    assert A.answer("What is the warranty period?", "answer", [])["answer"] == A.NOT_FOUND


def test_unclear_question():
    assert A.answer("What is this?", "answer", [OTHER[0]])["type"] == "clarification"
    assert A.answer("What is this?", "answer", OTHER)["type"] == "answer"  # scores are far apart


def test_draft():
    got = A.answer("What is the curing regime after laying?", "draft", CURING)["answer"]
    assert got.startswith(A.DRAFT_OPEN + "keep the floor wet") or got.startswith(A.DRAFT_OPEN + "do not let")
    assert got.endswith(A.DRAFT_CLOSE) and "[S1]" in got


def test_partial_support_is_noted():
    got = A.answer("Which substrate carries lime and granite countertops outdoors?", "answer", [chunk("S1", 1, "SUBSTRATES", "Lime is laid on brick.", 3.0), chunk("S2", 9, "", "Nothing else.", 1.0)])
    assert got["missing"] in ([A.NOTE_PART], [A.NOTE_NOTHING])


@pytest.mark.parametrize(
    ("question", "kind"),
    [("What tools are used?", "explanation"), ("How thick is it, 5 mm?", "value"), ("How is the floor laid?", "procedure"), ("Can it be painted?", "yesno"), ("Is curing needed?", "procedure"), ("Tell me about strength", "explanation")],
)
def test_intents(question, kind):
    assert A.Intent.of(question).kind == kind


def test_wrapped_lines():
    assert A.unwrapped(["If possible, make", "an embankment and let", "water stand.", "Then go on."], "paragraph") == ["If possible, make an embankment and let water stand.", "Then go on."]
    assert A.unwrapped(["a", "b"], "table") == ["a", "b"]
    assert A.unwrapped(["mix well", "~1 water", "for every 5 kg", "add sand"], "paragraph") == ["mix well", "~1 water", "for every 5 kg", "add sand"]
    assert A.unwrapped(["one thing", "MAIN HEADING", "two"], "paragraph") == ["one thing", "MAIN HEADING two"]


def test_yes_or_no_is_a_prefix():
    assert [A.yes_or_no(x) for x in ("Yes, it is", "Not at all", "Northern", "Maybe")] == ["yes", "no", "no", None]


def test_facts_that_read_alike_merge():
    spans = [A.Span(f"S{i}", "paragraph", "", "", 3 - i, 3, i, ("Same  line", f"line {i}")) for i in (1, 2)]
    facts = A.merged([(x, s) for s in spans for x in s.lines])
    assert [(f.text, f.sources) for f in facts] == [("Same  line", ["S1", "S2"]), ("line 2", ["S2"]), ("line 1", ["S1"])]


def test_column_form(spark):
    rows = [{"qid": 7, "question": "Can lime be laid over foam directly?", "mode": "answer", "place": i, **c} for i, c in enumerate(FAQ, 1)]
    got = A.answers(spark.createDataFrame(rows, "qid long, question string, mode string, place int, label string, page_from int, page_to int, section_path array<string>, chunk_type string, text string, score double")).first()
    assert got.qid == 7 and got.used_source_ids == ["S1"]
    asked = spark.createDataFrame([(7,), (8,)], "qid long")
    found = {r.qid: r for r in A.answers(spark.createDataFrame(rows, "qid long, question string, mode string, place int, label string, page_from int, page_to int, section_path array<string>, chunk_type string, text string, score double"), asked).collect()}
    assert found[7] == got and found[8][1:] == ("answer", A.NOT_FOUND, None, [], [A.NOTE_UNRETRIEVED])
