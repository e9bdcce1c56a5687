"""The driver's tables seen as documents, pages, chunks and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. One of fewer files than cores may be a single row group, which one task reads, so its rows are dealt out first; larger tables are read as they lie."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and len(rows.inputFiles()) < cores else rows


def workspace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of every document as a chunk; documents of one source share a workspace, one page each."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.filter(F.trim("text") != "").select(
        F.col("source").alias("document_id"),
        F.concat_ws("-", "doc_id", "line_no").alias("id"),
        F.col("doc_id").alias("page_from"),
        F.col("doc_id").alias("page_to"),
        F.array("lang").alias("section_path"),
        F.lit("paragraph").alias("chunk_type"),
        "text",
        (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("ord"),
    )


def whole_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole benchmark text, asked of one of the workspaces present: the one at place id modulo their number, by name."""
    named = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("document_id")).distinct()
    placed = named.withColumn("place", F.row_number().over(Window.orderBy("document_id")) - 1)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    # the number of workspaces is one row, so that places are met by equality
    asked = asked.crossJoin(F.broadcast(named.agg(F.count("*").alias("n")))).withColumn("place", F.expr("pmod(qid, nullif(n, 0))"))
    return asked.join(placed, "place").select("qid", "document_id", "question")


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as markdown, one page a document: h1 as headings, li as list lines, p as paragraphs, blank lines after p."""
    html = F.col("html")
    md = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>", "")
    md = F.regexp_replace(md, r"(?s)<h1[^>]*>(.*?)</h1>", "\n# $1\n")
    md = F.regexp_replace(md, r"(?s)<li[^>]*>(.*?)</li>", "\n- $1\n")
    md = F.regexp_replace(md, r"(?s)<p[^>]*>(.*?)</p>", "\n$1\n\n")
    md = F.regexp_replace(md, r"<[^>]*>", "")
    # list items stand on adjoining lines
    md = F.regexp_replace(md, r"\n\n- ", "\n- ")
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page"), md.alias("text"))


MARKDOWN_SQL = r"""
SELECT CAST(page_id AS VARCHAR) AS document_id, 1 AS page,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<script.*?</script>|<style.*?</style>', '', 'g'),
    '(?s)<h1[^>]*>(.*?)</h1>', E'\n# \\1\n', 'g'),
    '(?s)<li[^>]*>(.*?)</li>', E'\n- \\1\n', 'g'),
    '(?s)<p[^>]*>(.*?)</p>', E'\n\\1\n\n', 'g'),
    '<[^>]*>', '', 'g'),
    E'\n\n- ', E'\n- ', 'g') AS text
FROM pages
"""

CHUNKS_SQL = """
SELECT source AS document_id, doc_id || '-' || (line_no - 1) AS id, doc_id AS page_from, doc_id AS page_to,
  lang AS section, text, doc_id * 1000000 + line_no - 1 AS ord
FROM (SELECT source, doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
WHERE trim(text, ' ') <> ''
"""

WHOLE_QUESTIONS_SQL = """
SELECT item_id AS qid, document_id, text AS question
FROM benchmark JOIN (
  SELECT source AS document_id, row_number() OVER (ORDER BY source) - 1 AS place, count(*) OVER () AS n
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) ON ((item_id % n) + n) % n = place
"""
