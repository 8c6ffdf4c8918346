from gridtide.llm import urls


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
    fit = [(len(h), len(p), h + p, v) for v, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fit, default=None)
    return host, path, won[2] if won else None, won[3] if won else default


RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.c", "/"), ("allow", "b.c", "/x"),
    ("block", "b.c", "/x/y"), ("allow", "z.a.b.c", ""), ("block", "b-c", "/"), ("block", "xb.c", "/"),
]
URLS = [
    None, "", "no scheme", "http://", "://net/", "http://NET/", "http://net", "http://net?x=/", "https://a.net/p?q#r", "https://www.Example.net/en/x", "https://example.net/en", "http://notexample.net/en/",
    "http://example.net.evil/en/", "http://example.com/de/1", "http://a.org/fr/", "http://org/fr", "x://b.c/x/y/z", "x://q.b.c/x", "x://a.b.c/x/y", "x://z.a.b.c", "x://b-c/", "x://b.c.d/", "x://xb.c/x",
    "http://u:p@a.net:80/", "http://a..net/", "http://é.net/é", "http://net/://b", "http://a/\nnet/",
]


def check(spark, rules, rows):
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, rules))
    assert sorted((r["page_id"] or -1, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got.collect()) == sorted(
        (i or -1, h, p, r or "", v) for i, u in rows for h, p, r, v in [plain(u, rules)]
    )


def test_equals_a_plain_loop(spark, monkeypatch):
    rows = list(enumerate(URLS))
    check(spark, RULES, rows)
    check(spark, [*RULES, ("block", "", "/en/")], rows)
    monkeypatch.setattr(urls, "PER_BUCKET", 9)  # many ranges
    check(spark, RULES, rows + [(100 + i, "https://www.example.net/en/x") for i in range(40)] + [(None, "http://net/")])


def test_edge_tables(spark):
    check(spark, RULES, [])
    check(spark, [], [(1, "http://net/"), (1, "http://net/")])
    check(spark, RULES, [(1, "http://" + "a." * 5000 + "net/" + "x" * 100_000)])
    clash = spark.createDataFrame([(1, "http://net/", 1, "k", 2)], "page_id long, url string, part int, key string, stack int")
    assert urls.judge(clash, urls.rule_table(spark, RULES)).columns == ["page_id", "host", "path", "rule", "verdict"]


def test_plan_has_no_python(spark, sf_dir):
    from gridtide.llm.queries import op7_url_rules

    plan = op7_url_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
