import random
import re

import pytest

from tunesift.llm import urlfilter as U


def fits(pattern, host, path):
    """Rule syntax, character by character."""
    front, body = ("dom", pattern[2:]) if pattern.startswith("||") else ("start", pattern[1:]) if pattern.startswith("|") else ("any", pattern)
    tied = body.endswith("|")
    body = body[:-1] if tied else body
    text = host + path

    def at(i, k):
        if k == len(body):
            return not tied or i == len(text)
        c = body[k]
        if c == "*":
            return any(at(j, k + 1) for j in range(i, len(text) + 1))
        if c == "^":
            return i == len(text) and at(i, k + 1) or i < len(text) and not re.match(r"[A-Za-z0-9_.%-]", text[i]) and at(i + 1, k + 1)
        return i < len(text) and text[i] == c and at(i + 1, k + 1)
    starts = {"any": range(len(text) + 1), "start": [0],
              "dom": [0] + [i for i in range(1, len(text) + 1) if text[i - 1] == "." and "/" not in text[:i]]}[front]
    return any(at(i, 0) for i in starts)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def expected(urls, rules, default="allow"):
    out = []
    for i, url in urls:
        host, path = split(url)
        fit = sorted((t, -len(p), a != "block", p, a) for t, p, a in set(rules) if p and fits(p, host, path))
        out.append((i, host, path, fit[0][3] if fit else None, fit[0][4] if fit else default))
    return sorted(out, key=str)


RULES = [(0, "||org/", "allow"), (0, "||example.org/es/", "block"), (0, "||example.org/en/1", "block"), (0, "||com/fr/", "allow"), (0, "||com/de/", "block"),
         (1, "/x*y/", "block"), (1, ".zip|", "block"), (1, "|http", "block"), (1, "ban^", "block"), (1, "/(a+b)?/", "block"), (1, "q", "allow"),
         (1, "/a/a/", "allow"), (1, "/a/a/", "block"), (1, "||", "block"), (2, "|", "allow"), (1, "$1\\", "block"), (1, "é/ü", "block")]
URLS = ["http://a.org/", "http://ORG/es/", "https://Example.org/es/x", "https://m.example.org/en/12", "http://xexample.org/es/", "http://example.com/fr/",
        "ftp://b.com/de/?/fr/", "http://b.com?/fr/", "http://b.com", "no scheme org/", None, "", "://", "http://u://org/fr/", "http://b.net/x1/2y/z",
        "http://b.net/f.zip", "http://b.net/f.zip?x", "http://b.net/f.zipx", "http://http", "http://b.net/ban", "http://b.net/ban/", "http://b.net/ban.d",
        "http://b.net/(a+b)/", "http://b.net/(a+b)?/", "http://b.net/a/a/", "http://b.net/$1\\", "http://b.net/é/ü", "http://b.net/\n/x\ny/", "http://b.com/fr/\n",
        "http://b.net/" + "x/" * 400, "http://b.net/" + "ban" * 50_000 + "/z"]


@pytest.mark.parametrize("most", [U.BROADCAST_BYTES, -1])
def test_verdicts_equal_those_of_trying_every_rule(spark, most):
    rnd = random.Random(3)
    made = ["http://" + ".".join(rnd.choice(["a", "example", "ORG", "com", "ban"]) for _ in range(rnd.randint(1, 3))) + "/" +
            "/".join(rnd.choice(["es", "en", "1", "fr", "de", "x", "y", "ban", "a"]) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "/", "?q", "#f"])
            for _ in range(300)]
    rows = list(enumerate(URLS + made))
    pages = spark.createDataFrame([(i, u, "h", 1, "t") for i, u in rows], "page_id long, url string, token string, times long, target string")
    for rules in (RULES, [r for r in RULES if r[1] not in ("||", "|", "q")]):
        got = U.judge(pages, U.rule_table(spark, rules), broadcast_bytes=most)
        assert sorted(((r.page_id, r.host, r.path, r.pattern, r.verdict) for r in got.collect()), key=str) == expected(rows, rules)


def test_rules_are_filed_under_their_rarest_whole_token(spark):
    targets = spark.createDataFrame([("a.com/fr/",), ("b.com/de/",), ("c.com/fr/1",)], "target string")
    rules = U.compiled(U.rule_table(spark, [(0, "||com/fr/", "allow"), (0, "||com/de/", "block"), (0, "||com/en/1", "block"), (1, "fr", "block"), (1, "/x*/", "block")]))
    got = {r.pattern: r.token for r in U.rarest_token_index(rules, targets).collect()}
    assert got == {"||com/fr/": "fr", "||com/de/": "de", "||com/en/1": "en", "fr": "", "/x*/": ""}


def test_repeats_null_ids_no_rules_and_no_rows(spark):
    rows = [(None, "http://b.com/de/")] * 2500 + [(1, "http://b.com/de/")] * 3 + [(1, None), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = U.rule_table(spark, RULES[:5])
    got = sorted(((r.page_id, r.url, r.verdict) for r in U.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, u, "block" if u else "allow") for i, u in rows), key=str)
    none = rules.filter("false")
    assert {r.verdict for r in U.judge(pages, none, default="block").collect()} == {"block"}
    odd = spark.createDataFrame([(0, None, "block"), (0, "", "block")], "tier int, pattern string, action string")
    assert U.judge(pages, odd).filter("verdict != 'allow'").count() == 0
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_plan_has_no_python_and_one_exchange_of_urls(spark):
    plan = U.op13_url_rarest_token(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|ExistingRDD|MapIn|Pandas", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(page_id", plan)) == 1
