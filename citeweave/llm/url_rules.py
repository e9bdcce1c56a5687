"""URL filters by a sort-merge range join, in DataFrame functions only.

A host with its labels reversed and closed by dots is a key under which a domain
and all its subdomains are one interval: ``net.example.`` up to, not including,
``net.example/``, the next byte after the dot. Intervals of rules nest or are
disjoint. The join sorts urls and the ends of all intervals together and sweeps over
them with a stack of the rules that are open: one slot for each depth of nesting,
which keeps the last opening or closing met at that depth. What remains is to test
the paths of the few rules on the stack.

The urls are dealt to salts by their position and each salt gets the ends, so a
host that holds a third of all urls is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The verdict where no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def rule_ends(rules: DataFrame) -> DataFrame:
    """Both ends of every rule host's interval: key, ``slot`` and what is open from there on at that slot.

    A host's slot in the stack is the number of rule hosts it lies under. Intervals
    nest or are disjoint, so two that are open at once have different slots.
    """
    clean = rules.filter("verdict is not null and host is not null and path is not null").select("verdict", "host", "path").distinct()
    by_host = clean.groupBy("host").agg(F.collect_list(F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict", "path")).alias("own"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    under = by_host.select(F.col("host").alias("below"), F.explode(above).alias("host"))
    slots = under.join(by_host.select("host"), "host").groupBy(F.col("below").alias("host")).agg((F.count("*") - 1).cast("int").alias("slot"))
    keyed = by_host.join(slots, "host").select(host_key(F.col("host")).alias("key"), "slot", "own")
    closing = keyed.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), "slot", F.expr("cast(array() as array<struct<size:int,rule:string,verdict:string,path:string>>)").alias("own"))
    return keyed.unionByName(closing)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page by the longest rule that fits.

    A rule fits its host and all subdomains if the url's path starts with the rule's;
    of equally long rules that fit, the last in order wins, so ``block`` before
    ``allow``. A null url, or one without ``://``, has an empty host and path. Repeated
    rows are judged each; an empty table gives none. Columns other than page_id and url
    are not read.
    """
    spark = pages.sparkSession
    ends = rule_ends(rules)
    n_ends, depth = ends.agg(F.count("*"), F.coalesce(F.max("slot"), F.lit(-1)) + 1).first()
    # each salt gets all ends, so there are only as many salts as keep these fewer than the urls
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(most, pages.count() // max(1, n_ends)))
    top = F.substring_index("key", ".", 1)
    urls = (
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("key", host_key(F.col("host")))
        .select("page_id", "host", "path", "key", F.lit(1).alias("kind"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"))
    )
    events = ends.withColumn("kind", F.lit(0)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = urls.unionByName(events, allowMissingColumns=True)
    # a rule's interval stays under its last label, so that divides the sweep as well; a closing key has lost its dot
    sweep = Window.partitionBy(F.regexp_replace(top, "/$", ""), "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.last(F.when(F.col("slot") == d, F.col("own")), ignorenulls=True).over(sweep).alias(f"slot_{d}") for d in range(depth)]
    swept = both.select("page_id", "host", "path", "kind", *stack).filter("kind = 1")
    nothing = F.expr("cast(array() as array<struct<size:int,rule:string,verdict:string,path:string>>)")
    opened = F.concat(nothing, *(F.coalesce(F.col(f"slot_{d}"), nothing) for d in range(depth)))
    longest = F.array_max(F.filter(opened, lambda r: F.col("path").startswith(r["path"])))
    return swept.withColumn("longest", longest).select("page_id", "host", "path", F.col("longest.rule").alias("rule"), F.coalesce(F.col("longest.verdict"), F.lit(default)).alias("verdict"))


#: The same verdicts in plain SQL, for these few rules.
ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.rule_host || r.rule_path AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
