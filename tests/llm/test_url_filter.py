import random

from stocktake.llm import url_filter as u
from stocktake.llm.components import connected_components


def test_rules_and_aliases(spark):
    page = lambda href: f'<html><head><link rel="canonical" href="{href}"></head>'
    rows = [
        (1, "http://A.Example.ORG/es/1?q#f", None), (2, "https://x.example.org/en/12", ""), (3, "http://shop.net/a", page("http://example.org/es/9")), (4, "http://example.org/es/9", ""), (5, "http://shop.net/a#top", None),
        (6, "http://other.net/b", '<META content="0; URL=//shop.net/a" http-equiv=refresh>'), (7, "http://good.org/fr/", page("http://example.org/es/9")), (8, "http://free.net/x", ""), (9, None, None), (10, "no scheme", ""), (11, "http://org", ""), (12, "http://b.com/de/1", page("/z")), (13, "http://b.com/z", ""), (13, "http://b.com/z", ""),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert len(got) == len(rows)
    assert got[0][1:3] == ("a.example.org", "/es/1")
    assert verdict[1] == ("example.org/es/", "block") and verdict[2] == ("example.org/en/1", "block")
    # pages 3 to 7 are one component with blocked members, but page 7 is explicitly allowed
    assert verdict[7] == ("org/", "allow") and verdict[3] == verdict[5] == verdict[6] == (None, "allow")
    assert verdict[8] == verdict[9] == verdict[10] == verdict[11] == (None, "allow")
    assert verdict[12] == ("com/de/", "block") and verdict[13] == (None, "block")
    without = [r for r in rows if r[0] != 7]
    again = {r.page_id: r.verdict for r in u.judge_urls(spark.createDataFrame(without, "page_id bigint, url string, html string")).collect()}
    assert again[3] == again[5] == again[6] == "block"


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4100)] + [(1, None), (2, 2)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_empty_table(spark):
    assert u.judge_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_links_are_resolved(spark):
    from pyspark.sql import functions as F

    cases = [
        ("page2.html", "http://a.b/x/page2.html"), ("../y", "http://a.b/y"), ("./z?k=1&l=2", "http://a.b/x/z?k=1&l=2"), ("?id=3", "http://a.b/x/p?id=3"), ("/r/../s/.", "http://a.b/s/"), ("//c.d/e", "http://c.d/e"),
        ("https://c.d/e", "https://c.d/e"), ("mailto:x@y.z", None), ("#top", None), ("../../../q", "http://a.b/q"), ("a.b/c..d", "http://a.b/x/a.b/c..d"),
    ]
    rows = spark.createDataFrame([("http", "a.b", "/x/p", h, w) for h, w in cases], "s string, h string, p string, href string, want string")
    got = rows.select("href", "want", u.resolved(*[F.col(c) for c in ("s", "h", "p", "href")]).alias("got")).collect()
    assert all(r.got == r.want for r in got), got


def test_only_edges_join_and_targets_are_judged(spark):
    link = lambda href, rel='rel="alternate canonical"': f"<link {rel} href='{href}'>" + "x" * 100_000
    rows = [
        (1, "http://shop.net/a/x", link("http://example.org/es/none")),  # the target is no page, but blocked
        (2, "http://shop.net/a/y?p=1&q=2", link("x", "rel=canonical")), (3, "http://shop.net/b", link("/a/y?p=1&amp;q=2")),
        (4, "https://shop.net/a/x", None), (5, "http://shop.net/a/x/", ""), (6, "http://shop.net/a/x?utm_source=1", ""), (2, "http://shop.net/a/y?p=1&q=2", link("x", "rel=canonical")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'h' as host", "1 as _node", "2 as verdict", "3 as _id")
    got = sorted((r.page_id, r.verdict, r.reason) for r in u.judge_urls(pages).collect())
    assert got == [(1, "block", "alias"), (2, "block", "alias"), (2, "block", "alias"), (3, "block", "alias"), (4, "allow", "none"), (5, "allow", "none"), (6, "allow", "none")]


def test_sql_agrees_where_pages_have_links(spark, tmp_path):
    import duckdb

    rnd = random.Random(8)
    hosts = ["a.net", "b.net", "example.org", "x.com", "c.net"]
    paths = ["/es/1", "/en/12", "/fr/a", "/de/b", "/", "", "/p/q", "/p/r?k=1", "/p/./q", "/u/../p/q"]
    rows = []
    for k in range(300):
        href = rnd.choice(["", rnd.choice(paths), "../es/1", "q", "?k=1", "//" + rnd.choice(hosts) + rnd.choice(paths), "http://" + rnd.choice(hosts) + rnd.choice(paths), "#x"])
        html = rnd.choice([f'<link rel="canonical" href="{href}">', f'<meta http-equiv="refresh" content="0; url={href}">', ""])
        rows.append((k, rnd.choice(["http", "https"]) + "://" + rnd.choice(hosts) + f"/n{rnd.randrange(40)}" * rnd.randrange(2) + rnd.choice(paths), html))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, u.op10_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "reason").collect()), key=str)
    assert got == sorted(con.sql("select page_id, host, path, rule, verdict, reason from (" + u.ORACLE_SQL + ")").fetchall(), key=str)
    assert len({r[5] for r in got}) == 3
