import random
import re

from pagewright.llm import url_filters


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def test_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "COM", "example.com", "Www.Example.COM", "a.www.example.com", "xexample.com", "xcom", "net",
             "a.b.net", "", ".com", "com.", "example.com:8080", "u@example.com", "é.net", "ÀB.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/x", "/es/", "/fr/a/b", "/en//", "/en/\nx", "?en/", "#/en/", "/en/?a://b", "/a#b?c"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://com/", "a://b://com/en/"]
    urls += [rng.choice(urls) for _ in range(50)]  # repeated rows
    rows = [(i if i % 7 else None, u, 1, "r") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _short int, verdict string").repartition(3)
    for rules in (url_filters.RULES, [("block", "example.com", "/e"), ("allow", "com", "/en/"), ("block", "net", "")], []):
        got = [tuple(r) for r in url_filters.filter_urls(pages, rules).collect()]
        want = [(i, *judge(u, rules)) for i, u, *_ in rows]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        table = spark.createDataFrame([(v, h, p, 1) for v, h, p in rules + rules], "verdict string, host string, path string, _rh int")
        assert sorted(map(repr, (tuple(r) for r in url_filters.filter_urls(pages, table).collect()))) == sorted(map(repr, want))


def test_empty_and_plan(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    plan = url_filters.filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


def test_very_long_hosts_and_paths(spark):
    rows = [(1, "http://" + "a." * 20_000 + "example.com/en/" + "x/" * 50_000), (2, "http://" + "." * 9_000), (3, "http://" + "b" * 100_000 + ".net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = [tuple(r) for r in url_filters.filter_urls(pages).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *judge(u, url_filters.RULES))) for i, u in rows)
    assert {r[0]: r[3] for r in got} == {1: "example.com/en/", 2: None, 3: "net/es/"}


def test_a_million_rules_are_not_sent(spark):
    rules = spark.range(1_000_000).selectExpr("'block' AS verdict", "concat('h', id, '.org') AS host", "if(id % 2 = 0, '/', '/x/') AS path")
    rows = [(i, f"https://www.h{i * 1001}.org/{'x/' if i % 2 else ''}y") for i in range(50)] + [(90, "https://other.org/"), (91, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = url_filters.filter_urls(pages, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Broadcast" in x and "_rd" in x] and "Python" not in plan and plan.count("SortMergeJoin") >= 1
    assert {r["page_id"]: r["verdict"] for r in found.collect()} == {**{i: "block" for i in range(50)}, 90: "allow", 91: "allow"}
