"""Page layout: positioned text items of parsed pages to clean lines.

Items of one page are grouped into lines by a running height, which is a fold; a
page is small, so each is folded in one pandas group. What looks across pages
(repeated headers and footers) is plain aggregation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sequences that broken decoding leaves in extracted text, in the order of their replacement.
_QUOTES = (("â€™|â€˜", "'"), ("â€œ|â€\u009d|â€\u009c", '"'), ("â€“|â€”", "-"), ("â€¦", "..."))
REPAIRS = (
    *_QUOTES,
    ("\u0000", ""),
    ("Â", ""),
    _QUOTES[0],
    ("â\u0080\u0098|â\u0080\u0099", "'"),
    _QUOTES[1],
    ("â\u0080\u009c|â\u0080\u009d", '"'),
    _QUOTES[2],
    _QUOTES[3],
    ("ï‚§||•", "-"),
)
FOOTER = r"(?i)www\.|@|email|whatsapp|instagram"


def repair_text(x: Column) -> Column:
    for pattern, to in REPAIRS:
        x = F.regexp_replace(x, pattern, to)
    return T.clean_line(x)


def items_to_pieces(items: DataFrame) -> DataFrame:
    """Items (document_id, page, item_no, str, transform) with repaired text, place and font size; empty ones go."""
    at = lambda i: F.coalesce(F.get("transform", F.lit(i)), F.lit(0.0)).cast("double")
    rows = items.select("document_id", "page", "item_no", repair_text(F.col("str")).alias("text"), at(4).alias("x"), at(5).alias("y"), F.greatest(F.abs(at(0)), F.abs(at(3)), F.lit(1.0)).alias("font_size"))
    return rows.filter("text <> ''")


_LINE = "document_id string, page int, line_no int, text string, x double, y double, font_size double"


#: Fixed value: pieces this near in height stand side by side.
LEVEL = 1.25


def _reading_order(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces in bands from top to bottom, each from left to right; a band is what lies at most LEVEL below its highest piece."""
    down = pieces.sort_values("y", ascending=False, kind="stable")
    bands, top = [], None
    for y in down["y"]:
        if top is None or top - y > LEVEL:
            top = y
        bands.append(top)
    return down.assign(band=bands).sort_values(["band", "x", "item_no"], ascending=[False, True, True]).drop(columns="band")


def _group_page(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one page in reading order; one joins the line before it if it is near the line's running height."""
    rows: list[dict] = []
    for p in _reading_order(pieces).itertuples():
        line = rows[-1] if rows else None
        if line is not None and abs(line["y"] - p.y) <= max(1.8, 0.18 * p.font_size):
            line["parts"].append((p.x, p.item_no, p.text))
            line["y"] = (line["y"] + p.y) / 2
            line["font_size"] = max(line["font_size"], p.font_size)
        else:
            rows.append({"y": p.y, "font_size": p.font_size, "parts": [(p.x, p.item_no, p.text)]})
    out = []
    for line in rows:
        parts = sorted(line["parts"])
        text = parts[0][2]
        for (x0, _, before), (x1, _, after) in zip(parts, parts[1:], strict=False):
            tight = after[0] in ",.;:!?)}]" or before[-1] in "([{/-" or x1 - x0 < 2
            text += after if tight else " " + after
        out.append((pieces["document_id"].iloc[0], pieces["page"].iloc[0], len(out), text.strip(), parts[0][0], line["y"], line["font_size"]))
    return pd.DataFrame(out, columns=["document_id", "page", "line_no", "text", "x", "y", "font_size"])


def layout_from_items(items: DataFrame) -> DataFrame:
    """Lines of every page, headings that wrap merged."""
    grouped = items_to_pieces(items).groupBy("document_id", "page").applyInPandas(_group_page, _LINE)
    return merge_wrapped(grouped.filter("text <> ''"))


def page_medians(lines: DataFrame) -> DataFrame:
    """document_id, page and the median font size of the page's lines; 12 where that is 0."""
    return lines.groupBy("document_id", "page").agg(F.coalesce(F.nullif(F.median("font_size"), F.lit(0.0)), F.lit(12.0)).alias("median_font"))


def _heading_candidate(text: Column, font: Column, body: Column) -> Column:
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("double"), T.letters(text).cast("double")), F.lit(-1.0))
    return F.length(text).between(4, 90) & ~text.rlike(r"[.!]\z") & ((font >= body + 5) | ((font >= body + 2) & (share >= 0.72)))


def merge_wrapped(lines: DataFrame) -> DataFrame:
    """Two lines that are one heading, or one question, become one.

    Whether a line merges with the next depends on these two alone, and a merged pair
    is not merged further: in a run of such lines the first goes with the second, the
    third with the fourth, and so on.
    """
    page = Window.partitionBy("document_id", "page").orderBy("line_no")
    rows = lines.join(page_medians(lines), ["document_id", "page"])
    rows = rows.withColumn("__next", F.lead(F.struct("text", "x", "y", "font_size")).over(page))
    nxt, text = F.col("__next"), T.trim(F.col("text"))
    drop = F.col("y") - nxt["y"] < F.greatest(F.col("font_size"), nxt["font_size"]) * 1.7
    apart = F.abs(F.col("x") - nxt["x"])
    headings = _heading_candidate(text, F.col("font_size"), F.col("median_font")) & _heading_candidate(T.trim(nxt["text"]), nxt["font_size"], F.col("median_font")) & (apart < 32) & drop
    question = (
        (apart < 24) & drop & ~text.rlike(T.leading("faq")) & (F.size(F.split("text", rf"{T.SPACE}+")) > 4) & ~F.col("text").rlike(r"[.!?]\z") & nxt["text"].endswith("?") & (F.length("text") >= 12)
    )
    several = F.count("*").over(Window.partitionBy("document_id", "page")) >= 2
    rows = rows.withColumn("__merges", F.coalesce((headings | question) & several, F.lit(False)))
    # runs of merging lines; every other line of a run starts a pair
    rows = rows.withColumn("__run", F.sum((~F.col("__merges")).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__run", F.coalesce("__run", F.lit(0)))
    in_run = Window.partitionBy("document_id", "page", "__run").orderBy("line_no")
    rows = rows.withColumn("__starts", F.col("__merges") & (F.row_number().over(in_run) % 2 == 1))
    rows = rows.withColumn("__taken", F.coalesce(F.lag("__starts").over(page), F.lit(False))).filter(~F.col("__taken"))
    pair = F.col("__starts")
    merged = rows.select(
        "document_id",
        "page",
        F.row_number().over(page).alias("line_no"),
        F.when(pair, T.normalize_whitespace(F.concat_ws(" ", "text", nxt["text"]))).otherwise(F.col("text")).alias("text"),
        "x",
        F.when(pair, (F.col("y") + nxt["y"]) / 2).otherwise(F.col("y")).alias("y"),
        F.when(pair, F.greatest("font_size", nxt["font_size"])).otherwise(F.col("font_size")).alias("font_size"),
    )
    return merged.withColumn("line_no", F.col("line_no") - 1)


def boundary_key(x: Column) -> Column:
    """A line without its digits, to find it on other pages; null if too short or too long to be a header."""
    key = T.trim(F.regexp_replace(F.regexp_replace(F.lower(x), rf"{T.SPACE}+", " "), "[0-9]+", ""))
    return F.when(F.length(key).between(3, 80), key)


def _placed(lines: DataFrame) -> DataFrame:
    page = Window.partitionBy("document_id", "page")
    return lines.withColumns({"__i": F.row_number().over(page.orderBy("line_no")) - 1, "__n": F.count("*").over(page), "__key": boundary_key(F.col("text"))})


def boundary_counts(lines: DataFrame) -> DataFrame:
    """document_id, key, n: how often a line stands among the first three or last four of a page. On short pages it counts for both."""
    rows = _placed(lines).filter("__key is not null")
    at_ends = rows.filter("__i < 3").unionAll(rows.filter("__i >= __n - 4"))
    return at_ends.groupBy("document_id", F.col("__key").alias("key")).agg(F.count("*").alias("n"))


def is_page_artifact(x: Column, page: Column) -> Column:
    """A line of one to three short numbers, one of which is the page's; a lone number of two digits at most is one anyway."""
    text = T.trim(x)
    parts = T.split_words(text)
    # a line with any other character is out at once
    numeric = text.rlike(rf"\A(?:[0-9]|{T.SPACE})+\z") & (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"\A\d{1,3}\z"))
    own = F.exists(parts, lambda p: p.try_cast("int") == page)
    return numeric & (((F.size(parts) == 1) & (F.length(text) <= 2)) | ((F.size(parts) <= 3) & own))


def clean_pages(lines: DataFrame, vendor: str | None = None) -> DataFrame:
    """Lines without page numbers, contact footers and headers or footers that repeat on three pages.

    ``vendor`` is the name in a "contact ..." footer of the publisher at hand.
    """
    rows = _placed(lines)
    counts = boundary_counts(lines).select("document_id", F.col("key").alias("__key"), F.col("n").alias("__hits"))
    # lines that cannot be a header or footer meet nothing, so they are dealt out by place instead of all by the absent key
    at_end = ((F.col("__i") <= 2) | (F.col("__i") >= F.col("__n") - 4)) & F.col("__key").isNotNull()
    rows = rows.withColumn("__dealt", F.when(at_end, 0).otherwise(F.pmod(F.hash("page", "line_no"), F.lit(1000)) + 1)).withColumn("__key", F.when(at_end, F.col("__key")).otherwise(""))
    rows = rows.join(counts.filter("__hits >= 3").withColumn("__dealt", F.lit(0)), ["document_id", "__key", "__dealt"], "left")
    repeated = F.col("__hits").isNotNull()
    noise = is_page_artifact(F.col("text"), F.col("page")) | F.col("text").rlike(FOOTER + (rf"|contact {vendor}" if vendor else "")) | repeated
    return rows.filter(~noise).select(*lines.columns)


def page_texts(lines: DataFrame) -> DataFrame:
    """document_id, page, text: the lines of a page joined."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("document_id", "page").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))
