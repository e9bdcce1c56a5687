"""Top-k search and URL rules against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest

from citeweave.llm import queries, topk, url_rules

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


LONG = 2**63


def brute(rows, k=20):
    """Every row but those of the query's own id is a candidate; the rows of a query's id share its places."""
    f32 = lambda x: float(np.float32(x))
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [max(-LONG, min(LONG - 1, math.floor(64 * f32(x)))) for x in v]))
    out = []
    for q in sorted({i for i, _ in fine}):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(u, w, strict=False)), c) for i, u in fine if i == q for c, w in fine if c != q)
            scored = [(max(-LONG + 1, min(LONG, s)), c) for s, c in scored]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return out


def run(spark, rows, **sizes):
    frame = vectors(spark, rows)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(frame, topk.every_nth(frame), **sizes).collect())


@pytest.mark.parametrize("dense", [True, False])
def test_top_k(spark, dense, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    monkeypatch.setattr(topk, "SLICE", 60)
    draw = random.Random(3)
    value = lambda: draw.gauss(0, 0.2) if dense or draw.random() < 0.1 else 0.001
    rows = [(i, [value() for _ in range(16)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]  # one common vector: ties to the smaller id
    assert run(spark, rows) == brute(rows)


def test_edges_of_top_k(spark):
    rows = [(0, [0.5, -0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [float("inf"), 0.0]), (6, [0.25]), (20, [0.0, 0.0]), (40, [3e30, 3e30])]
    assert run(spark, rows) == brute(rows)
    many = [(0, [0.5, -0.5]), (20, [0.25, 1.0]), (20, [-1.0, 1.0])] + [(0, [1.0, 0.0])] * 30 + [(1, [1.0, 0.0])] * 30 + [(i, [i / 64, 1.0]) for i in range(2, 90) if i % 20]
    assert run(spark, many) == brute(many)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_top_k_is_the_sqls(spark, tmp_path):
    """The registered query and its SQL, also where ids repeat."""
    draw = random.Random(4)
    rows = [(draw.randrange(60), [draw.choice((-1.0, 0.0, 0.25, 0.5)) for _ in range(4)]) for _ in range(150)] + [(0, None), (20, [1.0, None, 0.0, 0.0]), (3, [float("nan")] * 4)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.QUERIES["op2_exact_top_k"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["op2_exact_top_k"]).fetchall()) and len(got) > 40
    three = [(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])]
    assert run(spark, three) == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 2048)]


def test_scores_beyond_an_int_stay_exact():
    q, c = np.array([[2**20, -(2**20)]]), np.array([[2**25, 3], [2**24, -(2**25)]])
    for _, scores in topk.accumulate(q, c):
        assert scores.tolist() == [[2**45 - 3 * 2**20, 2**44 + 2**45]]


URLS = [
    None, "", "no scheme", "http://net", "http://net/", "http://NET/x", "http://a.net/x", "http://planet/x", "https://example.net/en/1", "https://www.Example.net/en/1?q=/de/", "https://example.net/en", "https://example.net?x/en/",
    "http://example.com/de/x", "http://m.example.com/de/", "http://example.com/fr/", "http://org/fr/a", "http://x.org/fr", "http://x.org/fr/#y", "http://badexample.com/de/", "ftp://a://b.net/x", "http://example.net:80/en/", "http://é.net/", "http://a..net/x", "http://.net/x", "x\ny://a.net/\nz",
]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "block", "mine") for i, u in enumerate(URLS * 3)], "page_id long, url string, verdict string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.rule_table(spark)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS * 3)}
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def test_rules_are_the_sqls(spark, tmp_path):
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op7_url_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op7_url_rules']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_no_rules_and_nested_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge(pages, url_rules.rule_table(spark, ())).collect()} == {"allow"}
    nested = [("block", "net", "/"), ("allow", "example.net", "/"), ("block", "www.example.net", "/en/"), ("block", "www.example.net", "/en/"), ("allow", "www.example.net", "/en/"), ("block", "com", "/")]
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, url_rules.rule_table(spark, nested)).collect()}
    assert got[8] == "allow" and got[9] == "block" and got[6] == "block" and got[12] == "block"


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_rules.judge(pages, url_rules.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
