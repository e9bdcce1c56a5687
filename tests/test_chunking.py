"""Markdown and layout chunking, and page cleanup."""

import random
import re

import pytest
from pyspark.sql import functions as F

from citeweave.operators import chunking, layout

PAGES = "document_id string, page int, text string"
LINES = "document_id string, page int, line_no int, text string, x double, y double, font_size double"


def markdown(spark, *pages, target=800):
    frame = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages, 1)], PAGES)
    return [(r.chunk_type, r.page_from, list(r.section_path), r.text) for r in chunking.chunk_markdown(frame, target).orderBy("ord").collect()]


def test_kinds_of_blocks(spark):
    text = "# Guide\nIntro line\nsecond\n\n> take care\n> really\n- one\n  more of one\n- two\n1. step\n\n| a | b |\n|---|---|\nplain again\nWarning: hot\nHow is it done?\nLike this.\n- and that\n\nafter"
    got = markdown(spark, text)
    assert [(k, t.split("\n", 1)[1]) for k, _, _, t in got] == [
        ("paragraph", "Intro line\nsecond"),
        ("warning", "take care\nreally"),
        ("procedure", "- one\nmore of one\n- two\n1. step"),
        ("table", "| a | b |\n|---|---|"),
        ("paragraph", "plain again"),
        ("warning", "Warning: hot"),
        ("faq", "Question: How is it done?\nAnswer: Like this.\n- and that"),
        ("paragraph", "after"),
    ]
    assert all(path == ["Guide"] for _, _, path, _ in got)


def test_unanswered_questions_are_dropped(spark):
    assert [t for *_, t in markdown(spark, "What is this thing?\n\nWhy is it so?\nBecause.")] == ["Question: Why is it so?\nAnswer: Because."]


def test_faq_ends_with_its_page(spark):
    got = markdown(spark, "What is this thing?\nAn answer.", "not an answer")
    assert [(k, p) for k, p, *_ in got] == [("faq", 1), ("paragraph", 2)]


def test_questions_in_a_faq_section_need_no_question_word(spark):
    assert markdown(spark, "# FAQ list\nAnd over foam then?\nNo.")[0][0] == "faq"
    assert markdown(spark, "# Other\nAnd over foam then?\nNo.")[0][0] == "paragraph"


def test_section_paths_with_holes(spark):
    frame = spark.createDataFrame([("d", 1, "## two\na\n# one\nb\n### three\nc\n#### four\nd\n## back\ne")], PAGES)
    lines = {r.trimmed: (r.section_path, r.p) for r in chunking.markdown_lines(frame).withColumn("p", F.array_join("section_path", " > ", "")).collect()}
    assert lines["a"][0] == [None, "two"] and lines["a"][1] == " > two"
    assert lines["c"][0] == ["one", None, "three"]
    assert lines["d"][0] == ["one", "three", None, "four"]
    assert lines["e"][0] == ["one", "back"]


def test_outline_ends(spark):
    frame = spark.createDataFrame([("d", 1, "# A\n## B"), ("d", 2, "text"), ("d", 3, "## C"), ("d", 4, "# D"), ("d", 6, "end")], PAGES)
    got = [(r.id, r.title, r.level, r.page_start, r.page_end) for r in chunking.outline(chunking.markdown_lines(frame)).orderBy("ord").collect()]
    assert got == [("outline-1", "A", 1, 1, 4), ("outline-2", "B", 2, 1, 3), ("outline-3", "C", 2, 3, 4), ("outline-4", "D", 1, 4, 6)]


@pytest.mark.parametrize("target", [10, 30, 800])
def test_packing_keeps_every_line_within_the_target(spark, target):
    text = "\n\n".join(f"p{i} " + "word " * (i % 7) for i in range(40)) + "\n\n- item\n\nlast"
    got = markdown(spark, text, target=target)
    assert re.findall(r"p\d+", " ".join(t for *_, t in got)) == [f"p{i}" for i in range(40)]
    for kind, _, _, t in got:
        assert -(-len(t.split()) * 13 // 10) <= target or "\n\n" not in t
        assert (kind == "list") == ("- item" in t)


def line_rows(*pages):
    return [("d", p, i, t, 40.0, float(y), float(f)) for p, rows in pages for i, (t, y, f) in enumerate(rows)]


def test_prose_with_numbers_is_no_table(spark):
    rows = line_rows((1, [("DESIGN NOTES FOR BUILDERS", 120, 24), ("They are often coated with 4-8mm thick finishes.", 100, 12), ("Round edges help against chipping in daily use.", 84, 12)]), (2, [("MATERIAL & COST ESTIMATION", 120, 24), ("50kg lime @ INR 900", 100, 12), ("20 sq.ft assumption", 84, 12)]))
    got = chunking.chunk_layout(spark.createDataFrame(rows, LINES), 300).orderBy("ord").collect()
    assert [(r.page_from, r.chunk_type) for r in got] == [(1, "paragraph"), (2, "table")]
    assert got[1].section_path == ["MATERIAL & COST ESTIMATION"] and got[1].source_id == "src-0002" and got[1].id == "d-chunk-0002"


def test_layout_paragraphs_end_at_their_limit(spark):
    rows = line_rows((1, [(f"line {i} " + "quite ordinary words follow here " * 8, 800 - i, 12) for i in range(20)]))
    got = chunking.chunk_layout(spark.createDataFrame(rows, LINES), 600).orderBy("ord").collect()
    words = [len(r.text.split()) for r in got]
    assert all(-(-n * 13 // 10) >= 300 for n in words[:-1]) and all(-(-(n - 42) * 13 // 10) < 300 for n in words)
    assert re.findall(r"line (\d+)", " ".join(r.text for r in got)) == [str(i) for i in range(20)]


def test_layout_lists_and_questions(spark):
    rows = [("d", 1, i, t, x, 800.0 - i, 12.0) for i, (t, x) in enumerate([("1. first step of the work", 40.0), ("goes on here", 120.0), ("- bullet stays", 40.0), ("plain text beside", 40.0), ("What is lime plaster?", 40.0), ("A mineral coat.", 40.0), ("Note that it sets slowly", 40.0)])]
    got = chunking.chunk_layout(spark.createDataFrame(rows, LINES)).orderBy("ord").collect()
    assert [(r.chunk_type, r.text) for r in got] == [
        ("procedure", "1. first step of the work\ngoes on here\n- bullet stays"),
        ("paragraph", "plain text beside"),
        ("faq", "Question: What is lime plaster?\nAnswer: A mineral coat.\nNote that it sets slowly"),
    ]


def test_body_font_is_the_upper_median(spark):
    rows = line_rows((1, [("some ordinary line of prose", 1, f) for f in (10, 12, 14, 16)] + [("SHOUTED LINE OF CAPITALS HERE", 2, 40), ("short", 3, 50)]))
    assert chunking.body_fonts(spark.createDataFrame(rows, LINES)).first().body_font == 14
    assert chunking.body_fonts(spark.createDataFrame(line_rows((1, [("x", 1, 9)])), LINES)).first().body_font == 14


def test_headings_and_questions_merge_in_pairs(spark):
    faq = line_rows((1, [("FAQ SUBSTRATE", 120, 22), ("Can lime be applied over underfloor heating?", 104, 16)]))
    assert [r.text for r in layout.merge_wrapped(spark.createDataFrame(faq, LINES)).orderBy("line_no").collect()] == ["FAQ SUBSTRATE", "Can lime be applied over underfloor heating?"]
    rows = line_rows((1, [("BIG TITLE", 300, 30), ("GOES ON", 270, 30), ("AND ON", 240, 30), ("body", 200, 12), ("more body", 190, 12), ("body text", 180, 12), ("Is it really possible to lay", 150, 12), ("this over foam?", 140, 12)]))
    assert [r.text for r in layout.merge_wrapped(spark.createDataFrame(rows, LINES)).orderBy("line_no").collect()] == ["BIG TITLE GOES ON", "AND ON", "body", "more body", "body text", "Is it really possible to lay this over foam?"]


def test_cleanup(spark):
    pages = [(p, [("Field Guide 2024", 900, 10), (f"Body of page {p} which is unique {'abc'[p - 12]}", 500, 12), ("write to x@y.z", 50, 9), (f"{p} {p}", 40, 9), ("77", 30, 9), ("100", 20, 9)]) for p in (12, 13, 14)]
    got = layout.clean_pages(spark.createDataFrame(line_rows(*pages), LINES)).orderBy("page", "line_no").collect()
    assert [r.text for r in got if r.page == 14] == ["Body of page 14 which is unique c", "100"]
    assert layout.clean_pages(spark.createDataFrame(line_rows((1, [("Contact Acme today", 1, 9)])), LINES), "acme").count() == 0


def test_lines_from_items(spark):
    items = [("d", 1, i, s, [f, 0.0, 0.0, f, x, y]) for i, (s, x, y, f) in enumerate([("world", 50.0, 700.4, 12.0), ("Hello", 10.0, 700.0, 12.0), (",", 80.0, 700.0, 12.0), ("next", 10.0, 680.0, 11.0), ("line", 31.0, 680.5, 11.0), ("  ", 1.0, 1.0, 5.0), ("•", 10.0, 650.0, 12.0), ("itâ€™s", 20.0, 650.0, 12.0)])]
    frame = spark.createDataFrame(items, "document_id string, page int, item_no int, str string, transform array<double>")
    got = [(r.text, r.x) for r in layout.layout_from_items(frame).orderBy("line_no").collect()]
    assert got == [("Hello world,", 10.0), ("next line", 10.0), ("-it's", 10.0)]


def test_uneven_heights_of_one_line(spark):
    """Pieces within 1.25 in height are read from left to right, whichever stands higher; farther ones are not."""
    items = [("d", 1, i, s, [12.0, 0.0, 0.0, 12.0, x, y]) for i, (s, x, y) in enumerate([("two", 40.0, 701.2), ("one", 10.0, 700.0), ("three", 70.0, 700.6), ("last", 10.0, 690.0), ("first", 10.0, 702.6)])]
    frame = spark.createDataFrame(items, "document_id string, page int, item_no int, str string, transform array<double>")
    order = layout._reading_order(layout.items_to_pieces(frame).toPandas())
    assert list(order["text"]) == ["first", "one", "two", "three", "last"]


@pytest.mark.parametrize("seed", range(3))
def test_body_font_is_the_upper_median(spark, seed):
    draw, rows, want = random.Random(seed), [], {}
    for d in range(12):
        sizes = [draw.choice([9.0, 10.0, 10.5, 11.0, 14.0]) for _ in range(draw.randrange(0, 9))]
        rows += [(f"d{d}", 1, n, "a line of prose that is long enough", 1.0, 1.0, s) for n, s in enumerate(sizes)]
        rows.append((f"d{d}", 2, 0, "short", 1.0, 1.0, 50.0))
        want[f"d{d}"] = sorted(sizes)[len(sizes) // 2] if sizes else 14.0
    got = {r.document_id: r.body_font for r in chunking.body_fonts(spark.createDataFrame(rows, LINES)).collect()}
    assert got == want


def test_repairs(spark):
    broken = ["â€œquotedâ€\u009d", "aâ€“b", "Â x\u0000 ", " item", "â\u0080\u0099s", "â€¦"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in broken], "s string").select(layout.repair_text(F.col("s"))).collect()]
    assert got[1:] == ["a-b", "x", "- item", "'s", "..."]
    assert got[0].startswith('"quoted')
