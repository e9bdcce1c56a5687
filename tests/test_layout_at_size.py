"""Layout of many long lines: what is computed for a line is in proportion to what can decide about it."""

import re

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import layout

LINE = "document_id string, page int, line_no int, text string, x double, y double, font_size double"


def test_ends_are_freed_of_the_same_characters(spark):
    odd = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"]
    rows = [(c, f"{c} {c}a{c}b{c} {c}") for c in odd]
    got = spark.createDataFrame(rows, "c string, t string").select("c", T.trim(F.col("t")).alias("now"), F.regexp_replace("t", rf"\A{T.SPACE}+|{T.SPACE}+\z", "").alias("plain")).filter("now <> plain")
    assert got.isEmpty() and "regexp" not in str(T.trim(F.col("t")))
    counted = spark.createDataFrame([("aB1 éC.",), ("",), ("ABC",), ("..",)], "t string").select(T.letters(F.col("t")), F.round(T.upper_share(F.col("t")), 6)).collect()
    assert [tuple(r) for r in counted] == [(3, round(2 / 3, 6)), (0, 0.0), (3, 1.0), (0, 0.0)]


def test_lines_that_are_no_header_do_not_meet_by_an_absent_key(spark):
    long = "long " * 40
    rows = [("d", p, i, t, 0.0, -float(i), 10.0) for p in range(1, 41) for i, t in enumerate(["Head", long, f"{p}", "12 7 x", long, "body", "Head", long, long, long, "Foot"])]
    lines = spark.createDataFrame(rows, LINE)
    cleaned = layout.clean_pages(lines)
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "__dealt" in next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    left = {}
    for r in cleaned.collect():
        left.setdefault(r.page, []).append((r.line_no, r.text))
    want = {p: [(i, t) for _, q, i, t, *_ in rows if q == p and i not in (0, 10) and not re.fullmatch(r"\d+", t)] for p in range(1, 41)}
    assert {p: sorted(x) for p, x in left.items()} == want
