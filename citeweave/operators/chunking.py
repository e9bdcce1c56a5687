"""Chunking: parsed lines to an outline and typed, section-aware chunks.

Everything is windows over lines in document order. The open headings of a line
need no stack: the heading of level k that is still open is the last one of level k
or above, if that one's level is k. Blocks are runs of one kind of line. Only the
packing of short blocks up to a token target is a fold, over the blocks of one page
and section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

DOC = ("document_id",)
_ORDER = ("page", "line_no")
_LEVELS = range(1, 7)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy(*[c for c in _ORDER if c not in keys])


def with_sections(lines: DataFrame) -> DataFrame:
    """Adds ``section_path`` to lines that have ``level`` (0 for no heading) and ``title``.

    A level that was skipped leaves a null entry in the path.
    """
    past = _before(*DOC).rowsBetween(Window.unboundedPreceding, -1)
    seen = {k: F.last(F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct("level", "title")), ignorenulls=True).over(past) for k in _LEVELS}
    rows = lines.withColumns({f"__open{k}": F.when(seen[k]["level"] == k, seen[k]["title"]) for k in _LEVELS})
    titles = F.filter(F.array(*(F.when(F.col("level") > k, F.col(f"__open{k}")) for k in _LEVELS)), lambda t: t.isNotNull())
    holes = F.array_repeat(F.lit(None).cast("string"), F.greatest(F.col("level") - 1 - F.size(titles), F.lit(0)))
    path = F.when(F.col("level") > 0, F.slice(F.concat(titles, holes, F.array("title")), F.lit(1), F.greatest(F.col("level"), F.lit(1))))
    so_far = _before(*DOC).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__path", path).drop(*(f"__open{k}" for k in _LEVELS))
    return rows.withColumn("section_path", F.coalesce(F.last("__path", ignorenulls=True).over(so_far), F.expr("cast(array() as array<string>)"))).drop("__path")


def outline(lines: DataFrame) -> DataFrame:
    """document_id, ord, id, title, level, page_start, page_end of every heading.

    A section ends on the page of the next heading of its level or above, or on the
    document's last page, and never before it starts.
    """
    coming = _before(*DOC).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*DOC)
    closing = F.coalesce(*(F.when(F.col("level") == k, F.first(F.when((F.col("level") > 0) & (F.col("level") <= k), F.col("page")), ignorenulls=True).over(coming)) for k in _LEVELS))
    ended = lines.withColumn("__close", closing).withColumn("__last", F.max("page").over(whole)).filter("level > 0")
    numbered = ended.withColumn("ord", F.row_number().over(_before(*DOC)))
    return numbered.select(*DOC, "ord", F.concat(F.lit("outline-"), F.col("ord")).alias("id"), "title", "level", F.col("page").alias("page_start"), F.greatest("page", F.coalesce("__close", "__last")).alias("page_end"))


def _blocks(lines: DataFrame, extends: Column, list_type_from: str) -> DataFrame:
    """Runs of lines as blocks: document_id, block, page, section_path, type, text, n_words.

    ``lines`` carry ``kind``: heading, blank, question, warning, table, list or
    paragraph, and ``marker``, the type a list line asks for. ``extends`` says that a
    plain line continues an open list.
    """
    page = _before(*DOC, "page")
    past, so_far = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(Window.unboundedPreceding, 0)
    # after a question all lines answer it until a heading, a blank line, another question or the page's end
    event = F.when(F.col("kind").isin("heading", "blank", "question"), F.col("kind"))
    rows = lines.withColumn("__event", F.last(event, ignorenulls=True).over(so_far))
    rows = rows.withColumn("kind", F.when((F.col("__event") == "question") & (F.col("kind") != "question"), "answer").otherwise(F.col("kind")))
    loose = (F.col("kind") == "paragraph") & extends
    rows = rows.withColumn("__firm", F.last(F.when(~loose, F.col("kind")), ignorenulls=True).over(past))
    rows = rows.withColumn("kind", F.when(loose & (F.col("__firm") == "list"), "list").otherwise(F.col("kind")))
    family = F.when(F.col("kind") == "answer", "question").otherwise(F.col("kind"))
    begins = F.coalesce((F.lag(family).over(page) != family) | F.col("kind").isin("heading", "blank", "question"), F.lit(True))
    rows = rows.withColumn("__family", family).withColumn("block", F.sum(begins.cast("int")).over(_before(*DOC).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(~F.col("__family").isin("heading", "blank"))
    item = F.struct("line_no", "kind", F.when(F.col("kind") == "warning", F.regexp_replace("trimmed", rf"\A>{T.SPACE}*", "")).otherwise(F.col("trimmed")).alias("text"), "marker")
    grouped = rows.groupBy(*DOC, "block").agg(F.min("page").alias("page"), F.first("section_path").alias("section_path"), F.first("__family").alias("family"), F.sort_array(F.collect_list(item)).alias("items"))
    texts = lambda kinds: F.transform(F.filter("items", lambda i: i["kind"].isin(*kinds)), lambda i: i["text"])
    body = T.normalize_whitespace(F.array_join(texts(["answer", "warning", "table", "list", "paragraph"]), "\n"))
    markers = F.filter(F.transform("items", lambda i: i["marker"]), lambda m: m.isNotNull())
    list_type = F.element_at(markers, -1 if list_type_from == "last" else 1)
    typed = (
        F.when(F.col("family") == "question", "faq").when(F.col("family") == "list", F.coalesce(F.when(F.size(markers) > 0, list_type), F.lit("list"))).otherwise(F.col("family"))
    )
    question = F.get(texts(["question"]), F.lit(0))
    whole = F.when(F.col("family") == "question", F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), body)).otherwise(body)
    return grouped.filter(body != "").select(*DOC, "block", "page", "section_path", typed.alias("type"), whole.alias("text"))


def _packed(blocks: DataFrame, target: int) -> DataFrame:
    """Paragraph and list blocks joined up to a token target, within one page and section; other types stand alone."""
    order = Window.partitionBy(*DOC).orderBy("block")
    loose = F.col("type").isin("paragraph", "list")
    key = F.struct(loose, "page", T.joined_path(F.col("section_path")))
    rows = blocks.withColumn("__loose", loose).withColumn("__new", F.coalesce(~F.col("__loose") | (F.lag(key).over(order) != key), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("block", "type", "text", F.size(T.split_words(F.col("text"))).alias("n"))
    runs = rows.groupBy(*DOC, "run").agg(F.min("page").alias("page"), F.first("section_path").alias("section_path"), F.sort_array(F.collect_list(item)).alias("items"))
    return _split_runs(runs, "items", lambda total, n: F.ceil((total + n) * F.lit(1.3)) > target)


def _split_runs(runs: DataFrame, items: str, full) -> DataFrame:
    """Cut each run's items into groups: an item that ``full(sum so far, its words)`` says no to opens the next group."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("g"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["n"] > 0) & full(acc["n"], x["n"])
        g = F.when(opens, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(opens, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    grouped = runs.withColumn("groups", F.aggregate(items, start, step, lambda acc: acc["out"]))
    return grouped.withColumn("group", F.explode(F.array_distinct("groups"))).withColumn(
        "members", F.filter(F.arrays_zip(F.col(items).alias("item"), F.col("groups").alias("at")), lambda z: z["at"] == F.col("group"))
    )


def _numbered(chunks: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*DOC).orderBy("ord"))
    ranked = chunks.withColumn("n", n)
    return ranked.select(
        *DOC,
        T.numbered(F.concat(F.col("document_id").cast("string"), F.lit("-chunk-")), F.col("n")).alias("id"),
        T.numbered(F.lit("src-"), F.col("n")).alias("source_id"),
        F.col("page").alias("page_from"),
        F.col("page").alias("page_to"),
        "section_path",
        F.col("type").alias("chunk_type"),
        "text",
        F.col("n").alias("ord"),
    )


def markdown_lines(pages: DataFrame) -> DataFrame:
    """Lines of markdown pages (document_id, page, text) with their kind, heading level, title and section path."""
    cut = pages.select(*DOC, "page", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = cut.withColumn("trimmed", T.trim(F.col("raw")))
    rows = with_sections(rows.withColumn("level", T.heading_level(F.col("trimmed"))).withColumn("title", T.heading_title(F.col("trimmed"))))
    line = F.col("trimmed")
    kind = (
        F.when(F.col("level") > 0, "heading")
        .when(line == "", "blank")
        .when(T.is_faq_question(line, F.col("section_path")), "question")
        .when(T.is_callout(line), "warning")
        .when(T.is_table_line(line), "table")
        .when(T.is_ordered(line) | T.is_bullet(line), "list")
        .otherwise("paragraph")
    )
    marker = F.when(T.is_ordered(line), "procedure").when(T.is_bullet(line), "list")
    return rows.withColumn("kind", kind).withColumn("marker", F.when(F.col("kind") == "list", marker))


def markdown_blocks(lines: DataFrame) -> DataFrame:
    return _blocks(lines, F.col("raw").rlike(rf"\A{T.SPACE}{{2,}}[^\s]"), "last")


def chunk_markdown(pages: DataFrame, target: int = vocab.CHUNK_TARGET_TOKENS) -> DataFrame:
    """Chunks of markdown pages."""
    packed = _packed(markdown_blocks(markdown_lines(pages)), target)
    kinds = F.transform("members", lambda m: m["item"]["type"])
    # a packed chunk that holds a list is one; others are alone in their group or paragraphs
    one = F.when(F.array_contains(kinds, "list"), "list").otherwise(kinds[0])
    body = F.array_join(F.transform("members", lambda m: m["item"]["text"]), "\n\n")
    return _numbered(packed.select(*DOC, F.col("members")[0]["item"]["block"].alias("ord"), "page", "section_path", one.alias("type"), T.section_prefixed(F.col("section_path"), body).alias("text")))


def body_fonts(lines: DataFrame, default: float = 14.0) -> DataFrame:
    """document_id and body_font: the upper median font size of prose lines, the default where there are none.

    Lines are counted by size before they meet, so a document brings its distinct sizes
    to one task, not its lines. Lines that are no prose count 0.
    """
    text = T.trim(F.col("text"))
    prose = (F.length(text) >= 20) & (T.letters(text) >= 8) & (T.upper_share(text) < 0.65) & (F.col("font_size") > 0)
    sizes = lines.groupBy(*DOC, F.when(prose, F.col("font_size")).alias("__size")).agg(F.count(F.when(prose, 1)).alias("__n"))
    doc = Window.partitionBy(*DOC)
    up_to = F.sum("__n").over(doc.orderBy(F.asc_nulls_first("__size")))
    sizes = sizes.withColumn("__upper", up_to > F.floor(F.sum("__n").over(doc) / 2))
    return sizes.groupBy(*DOC).agg(F.coalesce(F.min(F.when(F.col("__upper"), F.col("__size"))), F.lit(default)).alias("body_font"))


def layout_lines(lines: DataFrame) -> DataFrame:
    """Positioned lines (document_id, page, line_no, text, x, y, font_size) with kind, level, title and section path."""
    rows = lines.join(body_fonts(lines), list(DOC))
    text, font, body = F.col("text"), F.col("font_size"), F.col("body_font")
    heading = T.looks_like_heading(text, font, body)
    rows = rows.withColumn("trimmed", T.trim(text)).withColumn("level", F.when(heading, T.layout_heading_level(text, font, body)).otherwise(0)).withColumn("title", T.clean_heading(text))
    rows = with_sections(rows)
    path = F.col("section_path")
    kind = (
        F.when(F.col("level") > 0, "heading")
        .when(T.is_faq_question(text, path), "question")
        .when(T.is_warning(text), "warning")
        .when(T.is_value_line(text, path), "table")
        .when(T.is_ordered(text) | T.is_bullet(text), "list")
        .otherwise("paragraph")
    )
    marker = F.when(T.is_ordered(text), "procedure").when(T.is_bullet(text), "list")
    return rows.withColumn("kind", kind).withColumn("marker", F.when(F.col("kind") == "list", marker)).withColumn("raw", text)


def chunk_layout(lines: DataFrame, target: int = vocab.CHUNK_TARGET_TOKENS) -> DataFrame:
    """Chunks of positioned lines. A paragraph ends with the line that brings it to half the target, 300 to 450 tokens."""
    limit = min(450, max(300, int(target * 0.5 + 0.5)))
    blocks = _blocks(layout_lines(lines), F.col("x") > 110, "first")
    rows = blocks.withColumn("rows", F.split("text", "\n"))
    item = lambda r: F.struct(r.alias("text"), F.size(T.split_words(r)).alias("n"))
    cut = F.when(F.col("type") == "paragraph", F.transform("rows", item)).otherwise(F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))))
    parts = _split_runs(rows.withColumn("items", cut).withColumnRenamed("block", "run"), "items", lambda total, n: F.ceil(total * F.lit(1.3)) >= limit)
    body = T.normalize_whitespace(F.array_join(F.transform("members", lambda m: m["item"]["text"]), "\n"))
    return _numbered(parts.select(*DOC, F.struct("run", "group").alias("ord"), "page", "section_path", "type", T.section_prefixed(F.col("section_path"), body).alias("text")))
