"""First-stage search: questions meet the chunks of their document.

All that depends on one side alone is computed before the join, on chunks once and
on questions once; the join adds only what needs both.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import kernels
from ..functions import text as T
from ..functions import vectors as V
from ..functions import vocab

#: Characters of questions (and 100 more for each) that are sent to every executor; more questions meet chunks by a shuffle.
HANDED_OUT = 2_000_000

#: What questions may want of a chunk, as the ``q_`` signals name it.
WANTED = ("procedure", "value", "yesno", "composition", "tooling", "curing")

CURING_QUESTION = T.words("cur(?:e|ed|ing)|watering|72 hours|dry out")


def question_signals(questions: DataFrame) -> DataFrame:
    """Adds what search and answers ask of a question: normal form, terms, and the kinds of detail it wants."""
    q, terms = F.col("question"), F.col("q_terms")
    rows = questions.withColumn("q_norm", T.normalize_query(q)).withColumn("q_terms", T.distinct_nonempty(T.search_terms(q)))
    rows = rows.withColumn("q_value", q.rlike(r"\d") | T.any_of(terms, vocab.VALUE_TERMS))
    return rows.withColumns(
        {
            "q_procedure": q.rlike(T.leading("how|steps?|procedure|process")) | (~F.col("q_value") & T.any_of(terms, vocab.PROCEDURE_TERMS)),
            "q_yesno": F.col("q_norm").rlike(T.leading("can|is|are|do|does|should|will|would|could|did")),
            "q_composition": T.any_of(terms, vocab.COMPOSITION_TERMS),
            "q_tooling": T.any_of(terms, vocab.TOOLING_TERMS),
            "q_curing": q.rlike(CURING_QUESTION),
        }
    )


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Adds the search columns of chunks: haystack, full-text terms in order, distinct terms, path terms, and the lexical embedding with its square.

    Meant to be stored with the chunks (``store.write_index``), so that questions read them instead of texts.
    """
    path, text = F.col("section_path"), F.col("text")
    # the haystack is path and text side by side, so its terms are those of both, and each is cut into terms once
    own = chunks.withColumns({"__path": T.search_terms(T.joined_path(path, " ")), "__text": T.search_terms(text)})
    own = own.withColumns({"embedding": V.sparse_embedding(text), "fts": F.concat("__path", "__text")})
    indexed = own.withColumns({"haystack": T.haystack(path, text), "terms": F.array_distinct("fts"), "path_terms": F.array_distinct("__path"), "square": V.square(F.col("embedding"))})
    return indexed.drop("__path", "__text")


def at_hand(questions: DataFrame) -> DataFrame | None:
    """Few questions as rows of the driver, with ``__at``, their place among those of their document; None if they are too many. They are looked up at once."""
    if (questions.agg(F.sum(F.coalesce(F.length("question"), F.lit(0)) + 100)).first()[0] or 0) > HANDED_OUT:
        return None
    seen: Counter = Counter()
    rows = []
    for r in questions.filter("document_id is not null").collect():
        rows.append((*r, seen[r["document_id"]]))
        seen[r["document_id"]] += 1
    schema = StructType([*questions.schema.fields, StructField("__at", IntegerType(), False)])
    return questions.sparkSession.createDataFrame(rows, schema)


def wanted(few: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the documents that questions ``at_hand`` ask, with what both sides share and with ``d_`` flags: what any question of the document wants of a chunk.

    Shared terms and cosines are computed where a chunk is cut into terms, for all
    questions of its document, so neither terms nor embeddings leave that place. Patterns
    that only some kind of question asks for are looked for where one does.
    """
    wants = question_signals(few).groupBy("document_id").agg(*(F.coalesce(F.bool_or(f"q_{k}"), F.lit(False)).alias(f"d_{k}") for k in WANTED))
    own: dict[str, kernels.Asked] = {}
    for r in _asked(few).select("document_id", "__at", "q_terms", "q_embedding", "q_square").orderBy("document_id", "__at").collect():
        own.setdefault(r["document_id"], kernels.Asked()).add(r["q_terms"] or (), r["q_embedding"] or {}, r["q_square"] or 0.0)
    met = kernels.met_by(own, vocab.VECTOR_DIMENSIONS)(F.col("document_id"), T.joined_path(F.col("section_path"), " "), F.col("text"))
    return chunks.join(F.broadcast(wants), "document_id").withColumn("__met", met)


def if_wanted(rows: DataFrame, kinds: tuple[str, ...], value: Column, otherwise) -> Column:
    """``value``, or ``otherwise`` where ``wanted`` has said that no question is of one of the kinds."""
    if "d_value" not in rows.columns:
        return value
    return F.when(reduce(or_, (F.col(f"d_{k}") for k in kinds)), value).otherwise(F.lit(otherwise))


def _asked(questions: DataFrame) -> DataFrame:
    """Questions with their signals, embedding and its square."""
    rows = question_signals(questions).withColumn("q_embedding", V.sparse_embedding(F.col("question")))
    return rows.withColumn("q_square", V.square(F.col("q_embedding")))


def _similarity() -> Column:
    return F.greatest(F.lit(0.0), V.sparse_cosine(F.col("q_embedding"), F.col("embedding"), F.col("q_square"), F.col("square")))


def specificity(top: float) -> Column:
    span = F.greatest(F.col("page_to") - F.col("page_from"), F.lit(0))
    return F.greatest(F.lit(0.0), F.lit(top) - span * F.lit(0.25)) + F.least(F.lit(0.9), F.size("section_path") * F.lit(0.18))


def bonus(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


# Patterns in a chunk that a kind of question favours, and the weights of the first stage.
FIRST_STAGE = {
    "procedure": (T.words("mix|lay|cure|compact|step|water"), 0.55),
    "curing": (T.words("cur(?:e|ing|ed)|72 hours|daily watering|dry out"), 1.05),
    "tooling": (T.words("tool|rammer|vibrator|bamboo|mechanical|manual"), 0.85),
    "composition": (T.words("fat lime|ash|sand|aggregate|water|booster|ratio|mix"), 0.7),
}
VECTOR_WEIGHT, KEYWORD_WEIGHT, SECTION_BONUS, TYPE_BONUS, FAQ_PENALTY, LEAST_SCORE = 3.2, 0.8, 1.35, 0.85, 0.2, 0.2


def local_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Question and chunk columns with keyword_score, vector_score and score, for every chunk of a question's document.

    ``questions``: qid, document_id, question. ``chunks`` as ``index_chunks`` gives them,
    of ``wanted`` chunks if the questions are those ``at_hand``; these then meet by broadcast.
    """
    asked = _asked(F.broadcast(questions) if "__met" in chunks.columns else questions)
    hay = F.col("haystack")
    known = chunks.withColumns({f"__{kind}": if_wanted(chunks, (kind,), hay.rlike(pattern), False) for kind, (pattern, _) in FIRST_STAGE.items()})
    known = known.withColumn("__digit", if_wanted(chunks, ("value",), F.col("text").rlike(r"\d"), False)).withColumn("__specific", specificity(1.2))
    met = asked.join(known, "document_id")
    shared = "__met" in chunks.columns
    hits, n = F.get("__met.hits", F.col("__at")) if shared else F.size(F.array_intersect("q_terms", "terms")), F.size("q_terms")
    keyword = hits + F.coalesce(F.try_divide(hits.cast("double"), n.cast("double")), F.lit(0.0)) * 2 + bonus(F.contains(hay, F.col("q_norm")), 2.0)
    met = met.withColumn("keyword_score", keyword).withColumn("vector_score", F.get("__met.similarity", F.col("__at")) if shared else _similarity())
    met = met.withColumn("hits", hits).drop("__met", "__at") if shared else met
    score = (
        F.col("vector_score") * VECTOR_WEIGHT
        + F.col("keyword_score") * KEYWORD_WEIGHT
        + bonus(F.arrays_overlap("path_terms", "q_terms"), SECTION_BONUS)
        + bonus(F.col("q_procedure") & (F.col("chunk_type") == "procedure"), TYPE_BONUS)
        + bonus(F.col("q_procedure") & F.col("__procedure"), FIRST_STAGE["procedure"][1])
        + bonus(F.col("q_value") & ((F.col("chunk_type") == "table") | F.col("__digit")), TYPE_BONUS)
        + sum((bonus(F.col(f"q_{kind}") & F.col(f"__{kind}"), FIRST_STAGE[kind][1]) for kind in ("curing", "tooling", "composition")), F.lit(0.0))
        + F.col("__specific")
        - bonus(F.col("q_tooling") & ~F.col("q_yesno") & (F.col("chunk_type") == "faq"), FAQ_PENALTY)
    )
    return met.withColumn("score", score).drop(*(f"__{k}" for k in FIRST_STAGE), "__digit", "__specific", "q_embedding", "q_square", *(f"d_{k}" for k in WANTED))


def local_candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scored chunks above the least score with their ``rank`` within the question; ties by position in the document."""
    return ranked(local_scores(questions, chunks).filter(F.col("score") > LEAST_SCORE))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ord", "id")))


def _holds(doc: Column, item: Column) -> Column:
    """Whether the terms of an item stand side by side in a text's terms, or do not where they must be absent."""
    n = F.size(item["terms"])
    # no start is past the end; a text of fewer terms has none
    starts = F.when(F.size(doc) >= n, F.sequence(F.lit(1), F.size(doc) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    found = F.when(n == 1, F.array_contains(doc, item["terms"][0])).otherwise(F.exists(starts, lambda i: F.slice(doc, i, n) == item["terms"]))
    return found != item["absent"]


def full_text_match(doc: Column, query: Column) -> Column:
    """Whether a text's terms in order satisfy a ``kernels.web_queries`` query. Phrases are of terms: words that are none are passed over on both sides."""
    return F.exists(query["any"], lambda items: F.forall(items, lambda item: _holds(doc, item)))


def keyword_rank(fts: Column, query: Column) -> Column:
    """A cover-density rank of texts that match, else null: terms asked nearer together and oftener rank higher, damped by length.

    It stands in for the database's own ranking function, whose exact values are not
    public semantics here. A match by absent terms alone ranks 0.
    """

    def rank(doc: Column, asked: Column) -> Column:
        first = F.transform(asked, lambda t: F.array_position(doc, t))
        width = V.let(first, lambda p: (F.array_max(p) - F.array_min(p) + 1).cast("double"))
        often = F.aggregate(asked, F.lit(0), lambda a, t: a + (F.size(doc) - F.size(F.array_remove(doc, t))))
        value = F.try_divide(F.size(asked) * often.cast("double"), width * (1 + F.log(F.greatest(F.size(doc), F.lit(1)).cast("double"))))
        return F.coalesce(value, F.lit(0.0))

    return V.let(fts, lambda doc: F.when(full_text_match(doc, query), V.let(F.array_intersect(query["asked"], doc), lambda asked: rank(doc, asked))))


def hybrid_merge(vector_hits: DataFrame, keyword_hits: DataFrame, carried: list[str], limit: int = vocab.MERGED, digits: int | None = None) -> DataFrame:
    """Union of both branches, best score of each by chunk, 0.72 and 0.28 of them as score, and the top ``limit`` of a question.

    Branches have qid, id, the carried columns and vector_score or keyword_score. With
    ``digits`` the score is rounded before it is ranked, so that nearly equal ones tie.
    """
    both = vector_hits.select("qid", "id", *carried, "vector_score", F.lit(0.0).alias("keyword_score")).unionByName(keyword_hits.select("qid", "id", *carried, F.lit(0.0).alias("vector_score"), "keyword_score"))
    merged = both.groupBy("qid", "id").agg(*(F.first(c).alias(c) for c in carried), F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score"))
    score = F.col("vector_score") * 0.72 + F.col("keyword_score") * 0.28
    scored = merged.withColumn("score", score if digits is None else F.round(score, digits))
    return top(scored, "score", limit)


def top(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The ``limit`` best rows of each question, ties by id, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), "id"))).filter(F.col("rank") <= limit)


def hybrid_candidates(questions: DataFrame, chunks: DataFrame, candidates: int = vocab.CANDIDATES, limit: int = vocab.MERGED) -> DataFrame:
    """The hosted search: the best chunks by vector and by full text (web search syntax), merged."""
    met = _asked(questions.withColumn("__query", kernels.web_queries(F.col("question")))).join(chunks, "document_id")
    carried = [c for c in met.columns if c not in ("qid", "id", "embedding", "q_embedding", "square", "q_square", "fts", "__query")]
    similar = met.filter(F.size("embedding") > 0).withColumn("vector_score", _similarity())
    # a chunk that lacks a term which every alternative needs cannot match, and only others are looked at term by term
    required = F.col("__query")["required"]
    likely = met.filter(F.size(F.array_intersect(required, "terms")) == F.size(required))
    matched = likely.withColumn("keyword_score", keyword_rank(F.col("fts"), F.col("__query"))).filter(F.col("keyword_score").isNotNull())
    return hybrid_merge(top(similar, "vector_score", candidates), top(matched, "keyword_score", candidates), carried, limit)
