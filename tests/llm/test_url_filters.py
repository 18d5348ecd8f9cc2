import random

from mailrisk.llm import url_filters as uf


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def judge(url, rules):
    host, path = parse(url)
    best = None
    for h, p, v in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), len(h), v == "block")
            if best is None or rank > best[0]:
                best = rank, h + p, v
    return (host, path, best[1] if best else None, best[2] if best else uf.DEFAULT)


def test_equals_brute_force_over_many_ranges(spark):
    draw = random.Random(8)
    labels = ["a", "b", "c-d", "com", "net", "x1"]
    hosts = [".".join(draw.choices(labels, k=draw.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/x", "/en", "/es/1", "/e"]
    rules = list({(draw.choice([*hosts, "", "com"]), draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"{draw.choice(['http', 'HTTPS', ''])}://{draw.choice(hosts).upper() if draw.random() < 0.2 else draw.choice(hosts)}"
            f"{draw.choice(paths)}{draw.choice(['', '?q=/x', '#/en/', 'é'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "a://b://c", "http://com/en/\n?x"] + ["http://hot.com/en/x"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://com/")], "page_id int, url string")
    got = uf.judge(pages.repartition(5), "page_id", "url", spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = {i: judge(u, rules) for i, u in enumerate(urls)} | {None: judge("http://com/", rules)}
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]], urls[r["page_id"] or 0]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "k", "h")], "page_id int, url string, key string, host string")
    rules = spark.createDataFrame([("com", None, "block")], "host string, path string, verdict string")
    assert uf.judge(pages.limit(0), "page_id", "url", rules).count() == 0
    assert uf.judge(pages, "page_id", "url", rules.limit(0)).first()["verdict"] == "allow"
    assert uf.judge(pages, "page_id", "url", rules).first()["rule"] == "com"
