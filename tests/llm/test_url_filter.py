import random
import re

from txguard.llm.url_filter import judge_urls

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "ab", "org", "com"]
    rules = {(".".join(rng.choices(labels, k=rng.randint(1, 3))), "".join(rng.choices(["/", "/x", "/y", "/xy/"], k=rng.randint(0, 3))))
             for _ in range(60)}
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in sorted(rules)]
    urls = ["https://" + ".".join(rng.choices([*labels, "A", ""], k=rng.randint(1, 5)))
            + "".join(rng.choices(["/", "/x", "/y", "/xy/", "?q=://z", "#f"], k=rng.randint(0, 5))) for _ in range(800)]
    urls += [None, "", "no scheme/x", "://org/", "x://", "http://ORG/x", "a://b://c/d", "http://org./x", "http://.org/", "http://org:80/"]
    urls += ["http://a.org/x"] * 400
    pages = spark.createDataFrame([(i % 700, u, "html", "own", "own") for i, u in enumerate(urls)],
                                  "page_id long, url string, html string, host string, key string")
    got = judge_urls(spark, pages, spark.createDataFrame(rules, RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        ((i % 700, *brute(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_no_rules_no_pages_null_ids_and_ties(spark):
    pages = spark.createDataFrame([(None, "http://a/x"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [r["verdict"] for r in judge_urls(spark, pages, none, default="block").collect()] == ["block"] * 2
    assert judge_urls(spark, pages.limit(0), none).count() == 0
    twice = spark.createDataFrame([("a", "/x", "allow"), ("a", "/x", "block"), (None, "/", "block"), ("a", None, "allow")], RULES)
    got = {r["path"]: (r["rule"], r["verdict"]) for r in judge_urls(spark, pages, twice).collect()}
    assert got == {"/x": ("a/x", "block"), "": (None, "allow")}


def test_main_path_has_no_python(spark):
    from txguard.llm.queries import QUERIES
    plan = QUERIES["op1_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
