"""Second stage: base score, anchor, continuity, and diversified top-k.

The anchor is a window aggregate, so no join is needed to compare chunks with it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import discard, materialize, small_methods
from . import search
from .search import bonus, specificity

def _question():
    return Window.partitionBy("qid")


def _contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _match_tiers(found: str, same: float, part: float, overlap: float) -> Column:
    """Bonus for a title or FAQ question that equals, contains, or shares terms with the question; none if empty."""
    text = F.col(found)
    shared = F.size(F.array_intersect("q_terms", f"{found}_terms"))
    # a title of fewer than two terms shares too few, so it is not compared
    enough = (F.size(f"{found}_terms") >= 2) & (shared >= F.greatest(F.lit(2), F.floor(F.size("q_terms") * F.lit(0.6)).cast("int")))
    return F.when(text == "", 0.0).when(text == F.col("q_norm"), same).when(_contains_either(text, F.col("q_norm")), part).when(enough, overlap).otherwise(0.0)


def _formula_bonus(path: Column, body: Column) -> Column:
    numbers = T.count_matches(body, T.NUMBER)
    ingredients = T.count_matches(body, T.words("fat lime|ash|sand|aggregate|water|booster|bag|weight|volume"))
    return (
        bonus(T.deepest(path).rlike(r"\A\d"), 1.2)
        + F.when(numbers >= 1, F.least(F.lit(1.3), numbers * F.lit(0.45))).otherwise(0.0)
        + bonus(ingredients >= 2, 0.8)
        + bonus(body.rlike(T.words("measure by volume|measure by weight")), 0.35)
    )


# Patterns in a chunk's haystack, body, section line, and in both of the latter.
_IN_HAYSTACK = {
    "procedure": "mix|lay|cur(?:e|ing|ed)|compact|step|water",
    "composition": "fat lime|ash|sand|aggregate|water|booster|ratio|mix",
    "tooling": "tool|rammer|vibrator|bamboo|mechanical|manual",
    "curing": "cur(?:e|ing|ed)|watering|72 hours|dry out",
}
_IN_BODY = {
    "yesno": T.leading("yes|no"),
    "faq_tools": "rammer|vibrator|bamboo|mechanical|manual",
    "ingredients": T.words("fat lime|ash|sand|aggregate|water|booster|25kg"),
    "cures": T.words("cur(?:e|ing|ed)|72 hours|daily watering|wait about 4-6 days|dry out"),
    "tools": T.words("rammers?|vibrators?|bamboo|mechanical|manual"),
}
_IN_SECTION = {"regime": "(?i)curing regime", "tool_section": T.words("tools?|compaction")}
_IN_BOTH = {
    "curing_chunk": T.words("cur(?:e|ing|ed)|72 hours|daily watering|dry out|watering"),
    "tooling_chunk": T.words("tools?|compaction|rammers?|vibrators?|bamboo|mechanical|manual"),
}
#: The kind of question that asks for each of them; those of the haystack are named by theirs.
_FOR = {"yesno": "yesno", "faq_tools": "tooling", "ingredients": "composition", "cures": "curing", "tools": "tooling", "regime": "curing", "tool_section": "tooling", "curing_chunk": "curing", "tooling_chunk": "tooling"}
_FAQ_QUESTION = rf"(?is)Question:{T.SPACE}*(.+?)\nAnswer:"
_FAQ_IN_BODY = rf"(?i)question:{T.SPACE}*(.+?){T.SPACE}+answer:{T.SPACE}*([\s\S]+)"


def with_features(chunks: DataFrame) -> DataFrame:
    """Adds all that reranking asks of a chunk alone, as ``f_`` columns: computed once a chunk, not once a question."""
    path, text, kind = F.col("section_path"), F.col("text"), F.col("chunk_type")
    on = lambda kinds, value, otherwise=False: search.if_wanted(chunks, kinds, value, otherwise)
    hay = F.col("haystack") if "haystack" in chunks.columns else T.haystack(path, text)
    body = on(("yesno", "composition", "tooling", "curing"), T.clean_body(path, text), "")
    rows = chunks.withColumns({"f_hay": hay, "f_body": body, "f_section": T.joined_path(path, " "), "f_title": T.normalize_query(T.deepest(path))})
    rows = rows.withColumns(
        {
            "f_asked": F.when(kind == "faq", T.normalize_query(F.regexp_extract(text, _FAQ_QUESTION, 1))).otherwise(""),
            "f_told": on(("composition",), F.when(kind == "faq", T.normalize_query(F.regexp_extract("f_body", _FAQ_IN_BODY, 1))).otherwise(""), ""),
            "f_digit": on(("value",), text.rlike(r"\d")),
            "f_formula": on(("composition",), _formula_bonus(path, F.col("f_body")), 0.0),
            "f_few_numbers": on(("composition",), F.when(kind == "faq", T.count_matches(F.col("f_body"), T.NUMBER) < 2).otherwise(False)),
            **{f"f_{k}": on((k,), F.col("f_hay").rlike(p)) for k, p in _IN_HAYSTACK.items()},
            **{f"f_{k}": on((_FOR[k],), F.col("f_body").rlike(p)) for k, p in _IN_BODY.items()},
            **{f"f_{k}": on((_FOR[k],), F.col("f_section").rlike(p)) for k, p in _IN_SECTION.items()},
            **{f"f_{k}": on((_FOR[k],), F.concat_ws(" ", "f_section", "f_body").rlike(p)) for k, p in _IN_BOTH.items()},
        }
    )
    terms = lambda c: F.array_distinct(T.search_terms(F.col(c)))
    rows = rows.withColumns({"f_title_terms": terms("f_title"), "f_asked_terms": terms("f_asked"), "f_terms": F.col("terms") if "terms" in chunks.columns else terms("f_hay")})
    return rows.withColumn("f_off_topic", on(("composition",), ~F.col("f_told").rlike(T.words("ratio|mix|water|booster|quantity|how much|proportion")))).drop("f_section")


def _composition_faq_penalty() -> Column:
    told = F.col("f_told")
    worse = F.lit(1.6) + bonus(F.col("f_off_topic"), 0.6) + bonus(F.col("f_few_numbers"), 0.6)
    return F.when(told == "", -1.8).when(_contains_either(told, F.col("q_norm")), 0.0).otherwise(-worse)


def base_score(rows: DataFrame) -> DataFrame:
    """Replaces ``score`` by the base score of question and chunk; needs the question's signals, and adds the chunk's features if it lacks them."""
    if "f_hay" not in rows.columns:
        rows = with_features(rows)
    kind, faq = F.col("chunk_type"), F.col("chunk_type") == "faq"
    hits = F.col("hits") if "hits" in rows.columns else F.size(F.array_intersect("q_terms", "f_terms"))
    coverage = F.coalesce(F.try_divide(hits.cast("double"), F.size("q_terms").cast("double")), F.lit(0.0))
    # Weights of the base score.
    parts = [
        F.coalesce("vector_score", F.lit(0.0)) * 0.68,
        F.coalesce("keyword_score", F.lit(0.0)) * 0.32,
        coverage,
        bonus(F.contains("f_hay", F.col("q_norm")), 2.1),
        _match_tiers("f_title", 3.2, 2.25, 1.15),
        F.when(faq & ~F.col("q_composition"), _match_tiers("f_asked", 3.2, 2.2, 1.4)).otherwise(0.0),
        bonus(F.col("q_procedure") & ((kind == "procedure") | F.col("f_procedure")), 0.95),
        bonus(F.col("q_value") & ((kind == "table") | F.col("f_digit")), 0.95),
        bonus(F.col("q_composition") & F.col("f_composition"), 0.9),
        F.when(F.col("q_composition"), F.col("f_formula")).otherwise(0.0),
        F.when(F.col("q_composition") & faq, _composition_faq_penalty()).otherwise(0.0),
        bonus(F.col("q_tooling") & F.col("f_tooling"), 0.95),
        bonus(F.col("q_curing") & F.col("f_curing"), 0.9),
        bonus(F.col("q_curing") & F.col("f_regime"), 1.35),
        bonus(F.col("q_tooling") & ~faq & F.col("f_tool_section"), 0.65),
        bonus(F.col("q_tooling") & ~F.col("q_yesno") & faq, -0.25),
        bonus(F.col("q_yesno") & F.col("f_yesno"), 0.7),
        specificity(1.25),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.withColumn("score", total)


def candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """First-stage candidates with their base score already computed (``f_base``) and without what it was computed from.

    Ranking sorts every chunk of a question's document several times. The base score
    needs one row at a time, so it comes before: what is sorted are narrow rows.
    """
    rows = search.local_scores(questions, chunks).filter(F.col("score") > search.LEAST_SCORE)
    rows = base_score(rows.withColumn("__first", F.col("score"))).withColumnRenamed("score", "f_base").withColumnRenamed("__first", "score")
    bulky = [c for c in rows.columns if c in ("haystack", "terms", "path_terms", "embedding", "q_norm", "q_terms", "f_hay", "f_body", "f_told") or c.startswith(("f_title", "f_asked", "f_terms"))]
    return search.ranked(rows.drop(*bulky))


def base_order() -> tuple[Column, ...]:
    """The order by base score; equal ones stand in the order of the first stage."""
    return F.desc("base"), F.desc("first"), F.col("ord"), F.col("id")


def scored(questions: DataFrame, chunks: DataFrame, few: DataFrame | None) -> DataFrame:
    """First-stage candidates with their scores of both stages, ``first`` and ``base``, and without a rank; ``chunks`` are as parsed.

    ``few`` are the questions if they are ``at_hand``: these are sent to the chunks, so that
    no chunk moves and rows leave this join as narrow as they are asked for.
    """
    index = with_features(search.index_chunks(chunks if few is None else search.wanted(few, chunks)))
    rows = search.local_scores(questions if few is None else few, index).filter(F.col("score") > search.LEAST_SCORE)
    return base_score(rows.withColumn("first", F.col("score"))).withColumnRenamed("score", "base")


def page_distance(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    return F.when((from_a <= to_b) & (from_b <= to_a), 0).when(from_a > to_b, from_a - to_b).otherwise(from_b - to_a)


def _root(path: Column) -> Column:
    return F.get(path, F.lit(0))


def _place(first: Column) -> Column:
    """What later comparisons need of a chunk, behind its rank."""
    return F.struct(first.alias("rank"), F.col("id"), T.section_key(F.col("section_path")).alias("section"), _root(F.col("section_path")).alias("root"), F.col("page_from"), F.col("page_to"))


def with_anchor(rows: DataFrame) -> DataFrame:
    """Adds ``base_rank`` and ``anchor``: the first fitting chunk near the top for curing and tooling questions, else the first."""
    rows = rows.withColumn("base_rank", F.row_number().over(_question().orderBy(F.desc("score"), "rank")))
    near = lambda share: F.col("score") >= F.max("score").over(_question()) * share
    rows = rows.withColumns(
        {
            "__curing": F.col("q_curing") & F.col("f_curing_chunk") & near(0.68),
            "__tooling": F.col("q_tooling") & ~F.col("q_yesno") & (F.col("chunk_type") != "faq") & F.col("f_tooling_chunk") & near(0.72),
        }
    )
    rows = rows.withColumn("__place", _place(F.col("base_rank")))
    first = lambda condition: F.min(F.when(condition, F.col("__place"))).over(_question())
    return rows.withColumn("anchor", F.coalesce(first(F.col("__curing")), first(F.col("__tooling")), first(F.lit(True)))).drop("__curing", "__tooling", "__place")


def _continuity(anchor: Column, in_order: Column) -> Column:
    same_section = T.section_key(F.col("section_path")) == anchor["section"]
    same_root = F.equal_null(_root(F.col("section_path")), anchor["root"])
    gap = page_distance(F.col("page_from"), F.col("page_to"), anchor["page_from"], anchor["page_to"])
    # Bonuses for standing near the anchor.
    return (
        F.when(same_section, 0.55).when(same_root & (gap <= 1), 0.3).otherwise(0.0)
        + F.when(gap == 0, 0.12).when(gap == 1, 0.18).otherwise(0.0)
        + bonus(in_order & same_section & (gap <= 1), 0.3)
    )


def _support() -> Column:
    faq = F.col("chunk_type") == "faq"
    # Bonuses for supporting what is asked.
    return (
        F.when(F.col("q_tooling") & faq & F.col("f_faq_tools"), 0.4)
        .when(F.col("q_composition") & F.col("f_ingredients"), 0.35)
        .when(F.col("q_curing") & F.col("f_cures"), F.when(F.col("f_regime"), 0.5).otherwise(0.35))
        .when(F.col("q_tooling") & ~faq & F.col("f_tools"), 0.35)
        .otherwise(0.0)
    )


def rerank(rows: DataFrame) -> DataFrame:
    """Scored candidates with a ``rank`` in, the same with final score and rank out; score order is stable."""
    rows = rows.withColumn("score", F.col("f_base")).drop("f_base") if "f_base" in rows.columns else base_score(rows)
    rows = with_anchor(rows)
    anchor = F.col("anchor")
    moved = rows.withColumn("score", F.col("score") + F.when(F.col("id") == anchor["id"], 0.0).otherwise(_continuity(anchor, F.col("q_procedure") | F.col("q_value"))) + _support())
    placed = moved.withColumn("rank", F.row_number().over(_question().orderBy(F.desc("score"), "base_rank"))).drop("base_rank", "anchor")
    return placed.drop(*(c for c in placed.columns if c.startswith("f_")))


def _beside_first(rows: DataFrame) -> DataFrame:
    """Adds what decides about a chunk beside the ``__first`` of its question: section, page, and whether they are the first's, near it, or under its root."""
    key = T.section_key(F.col("section_path"))
    rows = rows.withColumn("__section", key).withColumn("__page", F.concat_ws("-", "page_from", "page_to"))
    gap = page_distance(F.col("page_from"), F.col("page_to"), F.col("__first.page_from"), F.col("__first.page_to"))
    # a chunk without a section has no root, and no root is not the default one
    rooted = F.coalesce(_root(F.col("section_path")) == F.coalesce("__first.root", F.lit("Document")), F.lit(False))
    return rows.withColumns({"__same": key == F.col("__first.section"), "__near": gap <= 1, "__rooted": rooted})


def diversify(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` chunks of each question with few of one section or page, in the order chosen (``place``).

    A chunk is refused because its section or its page has had its share. Chunks that
    share section, page and root fare alike there, and once one is refused all later ones
    are, because counts only grow; so at most four of them are taken. Of chunks alike in
    section, root and nearness to the first, only their pages tell them apart; at most
    limit / 2 pages have two chunks, so a chunk is refused before the bound ``alike``
    below or not at all, and the same holds of one page's chunks with sections and pages
    exchanged, and then of all. Filling up needs the first 2 * limit. Counts beyond these
    bounds change nothing, so rows beyond them go before the rest is gathered: the walk is
    a fold over a number of rows that depends on ``limit`` alone, and rows are read once.
    """
    rows = _beside_first(rows.withColumn("__first", F.min(_place(F.col("rank"))).over(_question())))
    leading = F.col("rank") <= 2 * limit
    # at each step up to 2 * limit rows are there only because they are among the first
    alike = (
        (("__section", "__page", "__rooted"), 4),
        (("__section", "__rooted", "__near"), 4 + 4 * limit),
        (("__page", "__same"), 7 * limit),
        ((), 9 * limit + 15 * limit * limit),
    )
    for keys, most in alike:
        nth = F.row_number().over(Window.partitionBy("qid", *keys).orderBy("rank"))
        rows = rows.withColumn("__nth", nth).filter(leading | (F.col("__nth") <= most))
    items = F.sort_array(F.collect_list(F.struct("rank", "__section", "__page", "__same", "__near", "__rooted")))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("taken"), F.expr("cast(array() as array<string>)").alias("sections"), F.expr("cast(array() as array<string>)").alias("pages"))

    def step(acc: Column, x: Column) -> Column:
        hits = lambda a, v: F.size(a) - F.size(F.array_remove(a, v))
        sections, pages = hits(acc["sections"], x["__section"]), hits(acc["pages"], x["__page"])
        by_section = (sections < 2) | (x["__same"] & (sections < 4)) | (x["__rooted"] & x["__near"] & (sections < 3))
        by_page = (pages < 2) | (x["__same"] & x["__near"])
        takes = (F.size(acc["taken"]) < limit) & by_section & by_page
        more = lambda a, v: F.when(takes, F.array_append(a, v)).otherwise(a)
        return F.struct(more(acc["taken"], x["rank"]).alias("taken"), more(acc["sections"], x["__section"]).alias("sections"), more(acc["pages"], x["__page"]).alias("pages"))

    kept = [c for c in rows.columns if c != "qid" and not c.startswith("__")]
    chosen = rows.groupBy("qid").agg(F.aggregate(items, start, step, lambda acc: acc["taken"]).alias("__taken"), F.max("rank").alias("__n"), F.collect_list(F.struct(*kept)).alias("__rows"))
    filled = F.array_except(F.sequence(F.lit(1), F.least(F.col("__n"), F.lit(2 * limit))), F.col("__taken"))
    chosen = chosen.select("qid", F.slice(F.concat("__taken", filled), 1, limit).alias("__order"), "__rows")
    found = chosen.select("qid", "__order", F.explode(F.filter("__rows", lambda r: F.array_contains("__order", r["rank"]))).alias("__row"))
    return found.select("qid", "__row.*", F.array_position("__order", F.col("__row.rank")).cast("int").alias("place"))


def _only_first(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(_question().orderBy(*order))).filter("__n = 1").drop("__n")


def best(questions: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """What ``diversify(rerank(candidates(...)), limit)`` chooses, with the texts, where pairs are too many to be sorted or moved.

    Pairs are written once, scores and places only. Anchors and first chunks are found
    from maxima by question, with ties resolved by the order of ``rerank``. Diversifying
    takes at most ``4 + 4 * limit`` chunks of one section, rootedness and nearness, one of
    each page at least; so a chunk that scores less than the best of as many pages of its
    class is never looked at, nor is it among the first. Only others are ranked, and those
    chosen meet their texts again.
    """
    few = search.at_hand(questions)
    sent = F.broadcast if few is not None else lambda rows: rows
    marked = chunks.withColumn("mark", F.xxhash64("text"))
    found = scored(questions, marked, few)
    pairs = found.select(
        *questions.columns,
        *("id", "ord", "mark", "section_path", "page_from", "page_to", "chunk_type", "first", "base"),
        _support().alias("support"),
        (F.col("q_procedure") | F.col("q_value")).alias("in_order"),
        (F.col("q_curing") & F.col("f_curing_chunk")).alias("curing"),
        (F.col("q_tooling") & ~F.col("q_yesno") & (F.col("chunk_type") != "faq") & F.col("f_tooling_chunk")).alias("tooling"),
    )
    with small_methods(chunks.sparkSession):
        held = materialize(pairs, "pairs")
    # the anchor is the best of one kind, and one of a kind is near the top if its best is
    base, kinds = F.col("base"), {"curing": 0.68, "tooling": 0.72}
    tops = held.groupBy("qid").agg(F.max("base").alias("top"), *(F.max(F.when(F.col(k), base)).alias(f"top_{k}") for k in kinds))
    near_top = [F.when(F.col(f"top_{k}") >= F.col("top") * share, F.lit(k)) for k, share in kinds.items()]
    tops = tops.select("qid", F.coalesce(*near_top, F.lit("any")).alias("kind"), *("top", "top_curing", "top_tooling"))
    tied = F.when(F.col("kind") == "curing", F.col("curing") & (base == F.col("top_curing"))).when(F.col("kind") == "tooling", F.col("tooling") & (base == F.col("top_tooling"))).otherwise(base == F.col("top"))
    anchors = _only_first(held.join(sent(tops), "qid").filter(tied), *base_order()[1:])
    anchors = materialize(anchors.select("qid", _place(F.lit(1)).alias("anchor")), "anchors")

    anchor = F.col("anchor")
    score = base + F.when(F.col("id") == anchor["id"], 0.0).otherwise(_continuity(anchor, F.col("in_order"))) + F.col("support")
    moved = held.join(sent(anchors), "qid").withColumn("score", score).drop("anchor", "support", "in_order", "curing", "tooling")
    highest = moved.groupBy("qid").agg(F.max("score").alias("highest"))
    firsts = _only_first(moved.join(sent(highest), "qid").filter("score = highest"), *base_order())
    firsts = materialize(firsts.select("qid", _place(F.lit(1)).alias("__first")), "firsts")

    keys = ["qid", "__section", "__rooted", "__nearness"]
    classed = _beside_first(moved.join(sent(firsts), "qid"))
    # null-safe keys: chunks may lack a path or pages
    classed = classed.withColumn("__nearness", F.coalesce(F.col("__near").cast("int"), F.lit(-1))).withColumn("__section", F.coalesce("__section", F.lit("\u0000")))
    pages = classed.groupBy(*keys, "__page").agg(F.max("score").alias("highest"))
    most = 4 + 4 * limit
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("highest")))
    bounds = pages.withColumn("__n", nth).filter(F.col("__n") <= most).groupBy(*keys).agg(F.when(F.count("*") >= most, F.min("highest")).alias("least"))
    bounds = materialize(bounds, "bounds")
    likely = classed.join(sent(bounds), keys).filter("least is null or score >= least").select(*moved.columns)
    ranked = likely.withColumn("rank", F.row_number().over(_question().orderBy(F.desc("score"), *base_order())))
    chosen = materialize(diversify(ranked, limit).drop("rank", "first", "base"), "chosen")

    # a document may hold copies of a chunk, of which each has the text
    def alike(keys: list[str]) -> Column:
        return reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))

    key, pages = ["document_id", "id", "mark"], ["document_id", "page_from", "page_to"]
    near = marked.alias("a").join(sent(chosen.select(*pages).distinct()).alias("b"), alike(pages), "left_semi")
    texts = near.select(*key, "text").alias("a").join(sent(chosen.select(*key).distinct()).alias("b"), alike(key), "left_semi").dropDuplicates(key)
    out = materialize(chosen.alias("a").join(texts.alias("b"), alike(key)).select("a.*", "b.text").drop("mark"), "retrieved")
    for rows in (held, anchors, firsts, bounds, chosen):
        discard(rows)
    return out


def label(rows: DataFrame) -> DataFrame:
    """Adds the labels S1, S2, ... in the order chosen."""
    return rows.withColumn("label", F.concat(F.lit("S"), F.col("place")))
