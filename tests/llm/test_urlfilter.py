import random

from lumidoc.llm import queries, urlfilter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def brute(rows, rules, default="allow"):
    out = []
    for page_id, url in rows:
        host, path = split(url)
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if h is not None and p is not None and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page_id, host, path, best[3] if best else None, best[4] if best else default))
    return sorted(out, key=str)


def run(df, rules):
    return sorted((tuple(r) for r in urlfilter.judge(df, rules, groups=3, salts=4).collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    labels, steps = ["a", "b", "com", "x-y", "example", ""], ["a", "ab", "b", "7", "é", ""]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(25)]
    paths = ["/" + "/".join(rnd.choice(steps) for _ in range(rnd.randint(0, 3))) for _ in range(25)] + [""]
    rules = [(rnd.choice(["allow", "block"]), rnd.choice(hosts), rnd.choice(paths)) for _ in range(60)]
    rules += [("allow", "com", None), ("block", None, "/a"), ("maybe", "com", "/"), rules[0]]
    rows = [(k, rnd.choice(["http", "HTTPS", ""]) + "://" + rnd.choice(["", "w.", "W3."]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "?q=/a", "#/b", "/tail"])) for k in range(400)]
    rows += [(1, None), (2, ""), (3, "no scheme/a"), (4, "://"), (5, "a://b://c/d"), (6, "http://COM"), (None, "http://com/a"), (None, "http://com/a"), (8, "http://a.com/" + "b/" * 20_000), (9, "http://a\nb.com/x\ny")]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert run(df, table) == brute(rows, rules)


def test_production_rules(spark):
    rules = [(v, p.split("/", 1)[0], "/" + p.split("/", 1)[1]) for v, p in queries.URL_RULES]
    rows = [(1, "https://www.example.com/en/7x"), (2, "http://example.com/en/8"), (3, "http://Example.NET/de/8"), (4, "http://net/de/"), (5, "http://ample.org/es/"), (6, "http://example.com.au/en/"), (7, "http://notcom/en/"), (8, "http://com?/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, urlfilter.rule_table(spark, queries.URL_RULES)).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: ("org/es/", "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow")}
    assert sorted((k, *v) for k, v in got.items()) == sorted((r[0], r[3], r[4]) for r in brute(rows, rules))


def test_empty_tables(spark):
    urls = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    table = urlfilter.rule_table(spark, queries.URL_RULES)
    assert urlfilter.judge(urls.limit(0), table).count() == 0
    assert [tuple(r) for r in urlfilter.judge(urls, table.limit(0)).collect()] == [(1, "a.com", "/b", None, "allow")]


def test_plan_has_no_python(spark):
    urls = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    plan = urlfilter.judge(urls, urlfilter.rule_table(spark, queries.URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
