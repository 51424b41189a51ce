from pyspark.sql import functions as F

from tracklake.llm import urls
from tracklake.llm.components import components


def judge(spark, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    return {r["page_id"]: r for r in urls.judge(pages, **kw).collect()}


def test_rules(spark):
    got = judge(spark, [
        (1, "http://a.b.COM/en/x?q#f", "", "z"), (2, "https://Example.com/en/77", None, None), (3, "http://x.net/de/1", "", ""), (4, "http://q.example.net/de/8/z", "", ""),
        (5, "http://org/es/", "", ""), (6, "http://notorg/es/", "", ""), (7, None, "", ""), (8, "no scheme/en/", "", ""), (9, "http://com", "", ""), (10, "http://a.com?x=/en/", "", ""), (10, "http://a.com?x=/en/", "", ""),
    ])
    cut = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert cut[1] == ("a.b.com", "/en/x", "com/en/", "block")
    assert cut[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert cut[3][2:] == ("net/de/", "allow") and cut[4][2:] == ("example.net/de/8", "block")
    assert cut[5][2:] == ("org/es/", "block") and cut[6][2:] == (None, "allow")
    assert cut[7] == cut[8] == ("", "", None, "allow") and cut[9] == ("com", "", None, "allow") and cut[10] == ("a.com", "", None, "allow")


def test_aliases(spark):
    link = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    got = judge(spark, [
        (1, "http://blocked.com/en/a", "", ""), (2, "http://alias.io/1", link("http://blocked.com/en/a"), ""),
        (3, "http://far.io/2#top", '<META http-equiv=Refresh content="0; URL=http://alias.io/1">', ""),
        (4, "http://x.io/3", link("http://gone.org/es/q"), ""), (5, "http://y.io/", "<!-- " + link("http://blocked.com/en/a") + " --><script>'" + link("http://blocked.com/en/a") + "'</script>", ""),
        (6, "http://ok.net/de/1", link("http://blocked.com/en/zz"), ""), (7, "http://mixed.io/7", link("http://ok.net/de/1"), ""),
        (8, "http://rel.io/d/p", '<link href="../x" rel="next"><link href="/t" rel="alternate canonical">', ""), (9, "http://rel.io/t", link("http://blocked.com/en/a?x=1&amp;y"), ""),
    ])
    verdicts = {i: (r["verdict"], r["decided_by"]) for i, r in got.items()}
    assert verdicts[1] == ("block", "rule") and verdicts[2] == ("block", "alias") and verdicts[3] == ("block", "alias")
    assert verdicts[4] == ("block", "alias") and verdicts[5] == ("allow", "default")
    assert verdicts[6] == ("allow", "rule") and verdicts[7] == ("allow", "alias")
    assert verdicts[8] == verdicts[9] == ("block", "alias")


def test_given_redirects_and_empty(spark):
    extra = spark.createDataFrame([("http://p.io/1", "http://q.com/en/"), (None, "http://p.io/1")], "a string, b string")
    assert judge(spark, [(1, "http://p.io/1", None, None)], redirects=extra)[1]["verdict"] == "block"
    assert judge(spark, []) == {}


def test_equal_lengths_and_long_pages(spark):
    rules = [("a.com/x/", "block"), ("b.a.com/", "allow"), ("com/x/yz/", "block")]
    got = judge(spark, [(1, "http://b.a.com/x/yz/", None, None), (2, "http://b.a.com/x/", None, None), (3, "http://c.a.com/x/", None, None)], rules=rules)
    assert [got[i]["rule"] for i in (1, 2, 3)] == ["com/x/yz/", "a.com/x/", "a.com/x/"]  # of equally long ones the first in order
    n = 300_000
    link = '<link rel=canonical href="http://blocked.com/en/a">'
    pages = ["<!-- " * n, "<script " * n, "<link rel=canonical " * n, "<meta http-equiv='refresh' content='" + "0 " * n, link + "x" * 5 * n + "<!--" + " " * n, "<script>" + "</script " * n + ">" + link, "<" * n + link + "<link rel=canonical href=http://ok.net/de/1"]
    got = judge(spark, [(i, f"http://long.io/{i}", html, None) for i, html in enumerate(pages)])
    assert [got[i]["verdict"] for i in range(7)] == ["allow"] * 4 + ["block", "block", "block"]


def test_sql_of_linked_pages(spark, tmp_path):
    import random

    import duckdb

    from tracklake.llm import queries

    rng = random.Random(5)
    url = lambda: rng.choice(["http://", "HTTPS://"]) + rng.choice(["a.io", "B.io", "x.com", "example.net", "q.example.com", "ok.net", "z.org"]) + rng.choice(["", "/", "/en/7", "/de/8", "/es/", "/d/e/f", "/t"]) + rng.choice(["", "", "?q=1", "#top", "?a&b#c"])
    target = lambda: rng.choice([url(), url(), "//a.io/t", "/t", "?q=1", "../d", "e/f", "#x", "mailto:a@b", "", "/en/7?a&amp;b"])
    tag = lambda: rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel='next canonical'/>", "<link rel=canonical href={}>", '<meta http-equiv="Refresh" content="0; URL={}">', "<meta content='5,url={}' http-equiv=refresh>", "<!-- <link rel=canonical href={}> -->", "<script><link rel=canonical href={}></script>", '<link rel="alternate" href="{}">', "<link rel=canonical href={}"]).format(target())
    rows = [(i, rng.choice([url(), url(), url(), None, "no scheme"]) if i % 9 == 0 else url(), None if i % 8 == 0 else "".join(rng.choice([tag(), "<p>text</p>"]) for _ in range(rng.randint(0, 3)))) for i in range(160)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "decided_by"]
    got = [tuple(r[n] for n in names) for r in queries.QUERIES["op2_urls"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op2_urls']})").fetchall()))
    assert {r[-1] for r in got} == {"rule", "alias", "default"}


def test_components_against_union_find(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(500)] + [(3, 3), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    text = components(spark.createDataFrame([("c", "b"), ("a", "b"), ("x", "y")], "a string, b string"))
    assert {r["node"]: r["component"] for r in text.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert text.where(F.col("node").isNull()).count() == 0
