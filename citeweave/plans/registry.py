"""Queries over whole tables, one for each operator or group of operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions import vocab
from ..operators import answer, chunking, citations, layout, rerank, search
from ..sources import store
from ..sources.scratch import discard, materialize
from ..streaming import ingest
from . import lifecycle, views
from . import sql as S
from .views import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


@query(f"""
SELECT doc_id, len({S.terms('text')}) AS n_terms, len(list_distinct({S.terms('text')})) AS n_distinct,
  CASE WHEN regexp_matches(text, '\\S') THEN CAST(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER) ELSE 0 END AS est_tokens
FROM documents
""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.let(T.search_terms(F.col("text")), lambda t: F.struct(F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("d")))
    rows = table(spark, sf_dir, "documents").withColumn("c", counts)
    return rows.select("doc_id", F.col("c.n").alias("n_terms"), F.col("c.d").alias("n_distinct"), T.estimate_tokens(F.col("text")).alias("est_tokens"))


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, value FROM {S.embedding('documents', 'doc_id', 'text')}")
def lexical_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", V.sparse_embedding(F.col("text")).alias("e"))
    return rows.select("doc_id", F.explode("e").alias("idx", "value"))


@query("""
WITH pairs AS (
  SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0)
SELECT qid, id, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM pairs) WHERE rank <= 24
""")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of one label as a workspace; every twentieth vector asks its own."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("q"))
    met = asked.join(rows.select(F.col("vec_id").alias("id"), "label", "embedding"), "label")
    scored = met.select("qid", "id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    return search.top(scored, "similarity", vocab.CANDIDATES)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_chunks(views.workspace_chunks(spark, sf_dir))


def _scored(questions: str) -> str:
    return f"""
q AS (SELECT * FROM {S.signals(f'({questions})')}),
c AS (SELECT *, lower(section || ' ' || text) AS hay, list_distinct({S.terms("section || ' ' || text")}) AS terms, list_distinct({S.terms('section')}) AS path_terms FROM ({views.CHUNKS_SQL})),
qe AS (SELECT * FROM {S.embedding('q', 'qid', 'question')}),
ce AS (SELECT * FROM {S.embedding('c', 'id', 'text')}),
qn AS (SELECT qid, sum(value * value) AS s FROM qe GROUP BY qid),
cn AS (SELECT id, sum(value * value) AS s FROM ce GROUP BY id),
inner_product AS (
  SELECT q.qid, c.id, sum(qe.value * ce.value) AS p
  FROM q JOIN c USING (document_id) JOIN qe ON qe.qid = q.qid JOIN ce ON ce.id = c.id AND ce.idx = qe.idx GROUP BY ALL),
met AS (
  SELECT q.*, c.* EXCLUDE (document_id),
    greatest(0, coalesce(ip.p / nullif(sqrt(qn.s * cn.s), 0), 0)) AS vector_score,
    len(list_intersect(q_terms, terms)) + coalesce(len(list_intersect(q_terms, terms)) / nullif(len(q_terms), 0)::DOUBLE, 0) * 2 + {S.bonus('contains(hay, q_norm)', 2.0)} AS keyword_score
  FROM q JOIN c USING (document_id) LEFT JOIN inner_product ip ON ip.qid = q.qid AND ip.id = c.id
    LEFT JOIN qn ON qn.qid = q.qid LEFT JOIN cn ON cn.id = c.id),
scored AS (
  SELECT *, vector_score * 3.2::DOUBLE + keyword_score * 0.8::DOUBLE + {S.bonus('list_has_any(path_terms, q_terms)', 1.35)}
    + {S.bonus("q_procedure AND " + S.matches('hay', chr(92) + 'b(mix|lay|cure|compact|step|water)' + chr(92) + 'b'), 0.55)}
    + {S.bonus("q_value AND " + S.matches('text', chr(92) + 'd'), 0.85)}
    + {S.bonus("q_curing AND " + S.matches('hay', chr(92) + 'b(cur(?:e|ing|ed)|72 hours|daily watering|dry out)' + chr(92) + 'b'), 1.05)}
    + {S.bonus("q_tooling AND " + S.matches('hay', chr(92) + 'b(tool|rammer|vibrator|bamboo|mechanical|manual)' + chr(92) + 'b'), 0.85)}
    + {S.bonus("q_composition AND " + S.matches('hay', chr(92) + 'b(fat lime|ash|sand|aggregate|water|booster|ratio|mix)' + chr(92) + 'b'), 0.7)}
    + 1.2::DOUBLE + 0.18::DOUBLE AS score
  FROM met)
"""


_SCORED = _scored(views.WHOLE_QUESTIONS_SQL)


@query(f"WITH {_SCORED} SELECT qid, id, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(score, 6) AS score FROM scored WHERE score > 0.2")
def local_search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage: every chunk of a question's workspace above the least score."""
    rows = search.local_scores(views.whole_questions(spark, sf_dir), _indexed(spark, sf_dir)).filter(F.col("score") > search.LEAST_SCORE)
    return rows.select("qid", "id", *(F.round(c, 6).alias(c) for c in ("keyword_score", "vector_score", "score")))


_TOP_VECTOR = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(vector_score, 9) DESC, id) AS place FROM met WHERE id IN (SELECT id FROM ce)) WHERE place <= 24"
_TOP_KEYWORD = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(keyword_score, 9) DESC, id) AS place FROM met WHERE keyword_score > 0) WHERE place <= 24"


@query(f"""
WITH {_SCORED},
both_branches AS (
  SELECT qid, id, round(vector_score, 9) AS v, 0 AS k FROM ({_TOP_VECTOR})
  UNION ALL SELECT qid, id, 0, round(keyword_score, 9) FROM ({_TOP_KEYWORD})),
merged AS (SELECT qid, id, max(v) AS v, max(k) AS k, round(max(v) * 0.72::DOUBLE + max(k) * 0.28::DOUBLE, 6) AS score FROM both_branches GROUP BY qid, id)
SELECT qid, id, round(v, 6) AS vector_score, round(k, 6) AS keyword_score, score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM merged) WHERE rank <= 32
""")
def hybrid_search_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches' best chunks, merged; the keyword branch scores by matching terms here.

    Scores are rounded where ranks are taken, so that both engines see the same ties.
    """
    met = search.local_scores(views.whole_questions(spark, sf_dir), _indexed(spark, sf_dir))
    met = met.withColumn("vector_score", F.round("vector_score", 9)).withColumn("keyword_score", F.round("keyword_score", 9))
    by_vector = search.top(met.filter(F.size("embedding") > 0), "vector_score", vocab.CANDIDATES)
    by_keyword = search.top(met.filter("keyword_score > 0"), "keyword_score", vocab.CANDIDATES)
    merged = search.hybrid_merge(by_vector, by_keyword, [], digits=6)
    return merged.select("qid", "id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), "score", "rank")


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosted search with the full-text rank of the keyword branch; no SQL engine here shares that rank."""
    rows = search.hybrid_candidates(views.whole_questions(spark, sf_dir), _indexed(spark, sf_dir))
    return rows.select("qid", "id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), F.round("score", 6).alias("score"), "rank")


def retrieve(questions: DataFrame, chunks: DataFrame, limit: int = vocab.CHAT_LIMIT) -> DataFrame:
    """Search, rerank, diversify and label: the retrieval of a chat."""
    return rerank.label(rerank.best(questions, chunks, limit))


_BASE = rf"""
body_of AS (
  SELECT *, {S.normal('text')} AS flat FROM scored WHERE score > 0.2),
base AS (
  SELECT *, CASE WHEN starts_with(flat, lower(section)) THEN trim(flat[length(section) + 1:], ' ') ELSE flat END AS body,
    row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ord, id) AS first_rank FROM body_of),
weighed AS (
  SELECT *, round(vector_score * 0.68::DOUBLE + keyword_score * 0.32::DOUBLE
    + coalesce(len(list_intersect(q_terms, terms)) / nullif(len(q_terms), 0)::DOUBLE, 0)
    + {S.bonus('contains(hay, q_norm)', 2.1)}
    + CASE WHEN section = '' THEN 0 WHEN section = q_norm THEN 3.2::DOUBLE WHEN contains(section, q_norm) OR contains(q_norm, section) THEN 2.25::DOUBLE
        WHEN len(list_intersect(q_terms, path_terms)) >= greatest(2, floor(len(q_terms) * 0.6::DOUBLE)) THEN 1.15::DOUBLE ELSE 0 END
    + {S.bonus("q_procedure AND regexp_matches(hay, 'mix|lay|cur(?:e|ing|ed)|compact|step|water')", 0.95)}
    + {S.bonus(r"q_value AND regexp_matches(text, '\d')", 0.95)}
    + {S.bonus("q_composition AND regexp_matches(hay, 'fat lime|ash|sand|aggregate|water|booster|ratio|mix')", 0.9)}
    + CASE WHEN q_composition THEN
        least(1.3::DOUBLE, len(regexp_extract_all(body, '\d+(?:[.,]\d+)?')) * 0.45::DOUBLE)
        + CASE WHEN len(regexp_extract_all(body, '\b(fat lime|ash|sand|aggregate|water|booster|bag|weight|volume)\b')) >= 2 THEN 0.8::DOUBLE ELSE 0 END
        + CASE WHEN regexp_matches(body, '\b(measure by volume|measure by weight)\b') THEN 0.35::DOUBLE ELSE 0 END ELSE 0 END
    + {S.bonus("q_tooling AND regexp_matches(hay, 'tool|rammer|vibrator|bamboo|mechanical|manual')", 0.95)}
    + {S.bonus("q_curing AND regexp_matches(hay, 'cur(?:e|ing|ed)|watering|72 hours|dry out')", 0.9)}
    + {S.bonus(r"q_yesno AND regexp_matches(body, '^(yes|no)\b')", 0.7)}
    + 1.25::DOUBLE + 0.18::DOUBLE, 9) AS base_score
  FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY base_score DESC, first_rank) AS base_rank FROM weighed)
"""


@query(f"WITH {_SCORED}, {_BASE} SELECT qid, id, round(base_score, 6) AS base_score, CAST(base_rank AS INTEGER) AS base_rank FROM ranked")
def rerank_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base scores of all candidates, as the local path reranks them.

    First-stage scores that differ by the order of additions alone are ties, so that the
    place of every candidate is the same in both engines.
    """
    asked = views.whole_questions(spark, sf_dir)
    rows = rerank.scored(asked, views.workspace_chunks(spark, sf_dir), search.at_hand(asked))
    rows = rows.select("qid", "id", "ord", F.round("first", 9).alias("first"), F.round("base", 9).alias("base"))
    base_rank = F.row_number().over(Window.partitionBy("qid").orderBy(*rerank.base_order()))
    return rows.select("qid", "id", F.round("base", 6).alias("base_score"), base_rank.alias("base_rank"))


@query()
def retrieve_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the twelve labelled chunks of every question."""
    rows = retrieve(views.whole_questions(spark, sf_dir), views.workspace_chunks(spark, sf_dir))
    return rows.select("qid", "label", "place", "id", "page_from", F.round("score", 6).alias("score"))


_MD_LINES = rf"""
cut AS (SELECT document_id, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ({views.MARKDOWN_SQL})),
typed AS (
  SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS trimmed FROM cut),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(trimmed, '^#{{1,6}}\s+.+$') THEN 'heading' WHEN trimmed = '' THEN 'blank'
    WHEN regexp_matches(trimmed, '\?$') AND length(trimmed) >= 8 AND regexp_matches(trimmed, '(?i)^(what|why|how|can|is|are|do|does|should|will|when|where|which)\b') THEN 'question'
    WHEN regexp_matches(trimmed, '^>|(?i)^(warning|caution|note|important|alert)\b') THEN 'warning'
    WHEN regexp_matches(trimmed, '^\|.+\|$|^\|?[-: ]+\|[-|: ]+$') THEN 'table'
    WHEN regexp_matches(trimmed, '^\d+\.\s+|^[-*+]\s+') THEN 'list' ELSE 'paragraph' END AS kind,
    CASE WHEN regexp_matches(trimmed, '^#{{1,6}}\s+.+$') THEN regexp_replace(trimmed, '^#{{1,6}}\s+', '') END AS title
  FROM typed)
"""


@query(f"WITH {_MD_LINES} SELECT document_id, CAST(line_no AS INTEGER) AS line_no, kind, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no), '') AS section FROM kinds")
def markdown_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunking.markdown_lines(views.markdown_pages(spark, sf_dir))
    return lines.select("document_id", "line_no", "kind", T.joined_path(F.col("section_path")).alias("section"))


@query(f"""WITH {_MD_LINES}
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, line_no) AS INTEGER) AS ord, title, 1 AS level, page AS page_start,
  greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY page, line_no), max(page) OVER (PARTITION BY document_id))) AS page_end
FROM kinds WHERE kind = 'heading'""")
def markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.outline(chunking.markdown_lines(views.markdown_pages(spark, sf_dir))).drop("id")


_MD_BLOCKS = rf"""{_MD_LINES},
placed AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no), '') AS section,
  CASE WHEN kind IN ('heading', 'blank') OR lag(kind) OVER (PARTITION BY document_id, page ORDER BY line_no) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS begins FROM kinds),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY document_id ORDER BY page, line_no) AS block FROM placed),
blocks AS (
  SELECT document_id, CAST(block AS BIGINT) AS block, any_value(section) AS section, any_value(kind) AS type, string_agg(trimmed, chr(10) ORDER BY line_no) AS text
  FROM numbered WHERE kind NOT IN ('heading', 'blank') GROUP BY document_id, block)
"""


@query(f"WITH {_MD_BLOCKS} SELECT * FROM blocks")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no questions, callouts or tables; tests cover those kinds."""
    blocks = chunking.markdown_blocks(chunking.markdown_lines(views.markdown_pages(spark, sf_dir)))
    return blocks.select("document_id", "block", T.joined_path(F.col("section_path")).alias("section"), "type", "text")


@query(rf"""WITH RECURSIVE {_MD_BLOCKS},
sized AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, row_number() OVER (PARTITION BY document_id ORDER BY block) AS i FROM blocks),
walk AS (
  SELECT document_id, section, type, text, n, i, n AS total, 1 AS chunk FROM sized WHERE i = 1
  UNION ALL
  SELECT s.document_id, s.section, s.type, s.text, s.n, s.i,
    CASE WHEN s.section <> w.section OR ceil((w.total + s.n) * 1.3::DOUBLE) > 800 THEN s.n ELSE w.total + s.n END,
    CASE WHEN s.section <> w.section OR ceil((w.total + s.n) * 1.3::DOUBLE) > 800 THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN sized s ON s.document_id = w.document_id AND s.i = w.i + 1)
SELECT document_id, 'src-' || lpad(CAST(chunk AS VARCHAR), 4, '0') AS source_id, any_value(section) AS section,
  CASE WHEN bool_or(type = 'list') THEN 'list' ELSE 'paragraph' END AS chunk_type,
  CASE WHEN any_value(section) = '' THEN '' ELSE any_value(section) || chr(10) END || string_agg(text, chr(10) || chr(10) ORDER BY i) AS text
FROM walk GROUP BY document_id, chunk""")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_markdown(views.markdown_pages(spark, sf_dir))
    return chunks.select("document_id", "source_id", T.joined_path(F.col("section_path")).alias("section"), "chunk_type", "text")




# Structured rows as layout lines: each document's lines stand on pages of ten, with font sizes from their lengths.


def layout_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select(
        "document_id",
        F.col("doc_id").alias("page"),
        F.col("pos").alias("line_no"),
        "text",
        F.lit(40.0).alias("x"),
        (F.lit(800.0) - F.col("pos") * 14).alias("y"),
        (F.length("text") % 7 + 10).cast("double").alias("font_size"),
    )


_LAYOUT = r"""
layout AS (
  SELECT source AS document_id, doc_id AS page, line_no - 1 AS line_no, text, CAST(length(text) % 7 + 10 AS DOUBLE) AS font_size
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))
"""


@query(rf"""WITH {_LAYOUT},
prose AS (
  SELECT document_id, font_size, row_number() OVER (PARTITION BY document_id ORDER BY font_size) AS i, count(*) OVER (PARTITION BY document_id) AS n
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM layout)
  WHERE length(t) >= 20 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 8
    AND length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(regexp_replace(t, '[^A-Za-z]', '', 'g')) < 0.65 AND font_size > 0)
SELECT d.document_id, coalesce(max(p.font_size), 14) AS body_font
FROM (SELECT DISTINCT document_id FROM layout) d LEFT JOIN prose p ON p.document_id = d.document_id AND p.i = p.n // 2 + 1 GROUP BY d.document_id""")
def layout_body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.body_fonts(layout_view(spark, sf_dir))


@query(f"WITH {_LAYOUT} SELECT document_id, page, coalesce(nullif(median(font_size), 0), 12) AS median_font FROM layout GROUP BY ALL")
def layout_page_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_medians(layout_view(spark, sf_dir))


@query(rf"""WITH {_LAYOUT},
placed AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY document_id, page) AS n,
    trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[0-9]+', '', 'g'), ' ') AS key FROM layout),
ends AS (SELECT document_id, key FROM placed WHERE i < 3 UNION ALL SELECT document_id, key FROM placed WHERE i >= n - 4)
SELECT document_id, key, count(*) AS n FROM ends WHERE length(key) BETWEEN 3 AND 80 GROUP BY ALL""")
def layout_boundary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.boundary_counts(layout_view(spark, sf_dir))


@query()
def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pages of every workspace, chunked; fixtures in the tests hold the details."""
    # fonts and headers look at all lines before any is judged, so lines are written once instead of being computed for each reader
    merged = materialize(layout.merge_wrapped(layout_view(spark, sf_dir)), "merged-lines")
    lines = materialize(layout.clean_pages(merged), "clean-lines")
    discard(merged)
    return chunking.chunk_layout(lines).select("document_id", "id", "page_from", T.joined_path(F.col("section_path")).alias("section"), "chunk_type", "text")


@query("""
SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS history, count(*) AS n_turns
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id
""")
def history_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.last_turns(table(spark, sf_dir, "conversations"))


@query(f"""
SELECT d.document_id, count(c.id) AS chunk_count
FROM (SELECT DISTINCT source AS document_id FROM documents UNION SELECT 'none') d LEFT JOIN ({views.CHUNKS_SQL}) c USING (document_id) GROUP BY d.document_id
""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().union(spark.sql("SELECT 'none' AS id"))
    return store.chunk_counts(known, views.workspace_chunks(spark, sf_dir))


@query(f"""
WITH c AS (SELECT document_id, id, text FROM ({views.CHUNKS_SQL})),
fresh AS (SELECT document_id, 'new-' || id AS id, reverse(text) AS text FROM c WHERE document_id IN ('src1', 'src2') AND text LIKE '%the%')
SELECT * FROM c WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT * FROM fresh
""")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workspaces are chunked anew; all of their old chunks go."""
    stored = views.workspace_chunks(spark, sf_dir).select("document_id", "id", "text")
    fresh = stored.filter(F.col("document_id").isin("src1", "src2") & F.contains("text", F.lit("the")))
    return store.replace_chunks(stored, fresh.select("document_id", F.concat(F.lit("new-"), "id").alias("id"), F.reverse("text").alias("text")))


@query("""
SELECT CAST(user_id AS VARCHAR) AS document_id, arg_max(event_type, event_id) AS status, max(ts) AS updated_at FROM events GROUP BY user_id
""")
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the history of a document."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("seq"), F.lit("status").alias("field"), F.col("event_type").alias("value"), F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("at")
    )
    return lifecycle.current_state(events).select("document_id", "status", "updated_at")


_VERSIONS = "('a', 'ready', 'pdf-parse', 'local-layout-parser', 2), ('b', 'ready', 'pdf-parse', 'local-layout-parser', 3), ('c', 'ready', 'hosted', 'cloud', 2), ('d', 'ready', 'x', 'local-text-parser', NULL), ('e', 'parsing', 'pdf-parse', 'local-layout-parser', 2)"


@query(f"""
SELECT id, status = 'ready' AND (provider = 'pdf-parse' OR mode IN ('local-layout-parser', 'local-text-parser')) AND version IS DISTINCT FROM 3 AS stale
FROM (VALUES {_VERSIONS}) t(id, status, provider, mode, version)
""")
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_VERSIONS} AS t(id, status, provider, mode, version)")
    meta = F.create_map(F.lit("provider"), "provider", F.lit("mode"), "mode")
    return rows.select("id", lifecycle.needs_reingestion(F.col("status"), meta, F.col("version")).alias("stale"))


@query(r"""
SELECT p_partkey, lower(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'))[1:80] AS slug,
  regexp_replace(p_type, '[^a-zA-Z0-9._-]+', '-', 'g') AS filename, 'Pages ' || p_size || '-' || (p_size + 1) AS pages, 'src-' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS source_id,
  upper(p_name[1]) || p_name[2:] AS capital
FROM part
""")
def scalar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.slugify(F.col("p_name")).alias("slug"), T.sanitize_filename(F.col("p_type")).alias("filename"), T.page_label(n, n + 1).alias("pages"), T.numbered(F.lit("src-"), n).alias("source_id"), T.capitalize(F.col("p_name")).alias("capital")
    )


_CITED = "(1, array('S2', 'S9', 'S1', 'S2')), (2, array('S1')), (3, array('S7'))"


@query("""
WITH answers AS (SELECT * FROM (VALUES (1, ['S2', 'S9', 'S1', 'S2']), (2, ['S1']), (3, ['S7'])) t(qid, cited)),
labels AS (SELECT 1 AS qid, 'S1' AS label, 'Page 4' AS page_label UNION ALL SELECT 1, 'S2', 'Pages 5-6' UNION ALL SELECT 2, 'S1', 'Page 1'),
cited AS (SELECT qid, unnest(cited) AS label, generate_subscripts(cited, 1) AS pos FROM answers)
SELECT qid, label, page_label FROM cited JOIN labels USING (qid, label) GROUP BY ALL
""")
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that name retrieved excerpts, once each, with their page labels."""
    shown = spark.sql("SELECT * FROM VALUES (1L, 'S1', 4, 4), (1L, 'S2', 5, 6), (2L, 'S1', 1, 1) AS t(qid, label, page_from, page_to)").withColumn("section_path", F.expr("array('A')")).withColumn("chunk_type", F.lit("paragraph"))
    cited = spark.sql(f"SELECT CAST(qid AS BIGINT) AS qid, cited FROM VALUES {_CITED} AS t(qid, cited)")
    labels = shown.groupBy("qid").agg(F.collect_set("label").alias("labels"))
    kept = cited.join(labels, "qid", "left").select("qid", citations.allowed_citations(F.col("cited"), F.coalesce("labels", F.expr("cast(array() as array<string>)"))).alias("used_source_ids"))
    found = citations.resolve_sources(kept, shown)
    return found.select(F.col("qid").cast("int").alias("qid"), F.explode("sources").alias("s")).select("qid", F.col("s.id").alias("label"), F.col("s.page_label").alias("page_label"))


@query()
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all questions from their labelled chunks, every statement cited."""
    asked = views.whole_questions(spark, sf_dir)
    return answer.answers(retrieve(asked, views.workspace_chunks(spark, sf_dir)), asked)


@query()
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt that a hosted model would get for every question."""
    found = retrieve(views.whole_questions(spark, sf_dir), views.workspace_chunks(spark, sf_dir))
    asked = views.whole_questions(spark, sf_dir).join(citations.context_text(found), "qid", "left")
    nothing = F.lit(None).cast("string")
    return asked.select("qid", citations.prompt_text(F.col("question"), F.lit("answer"), nothing, nothing, F.col("context")).alias("prompt"))


@query("SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.status_counts(table(spark, sf_dir, "events"))
