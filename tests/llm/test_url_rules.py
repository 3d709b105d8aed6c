import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from longstats.llm.url_rules import host_suffixes, listed_rule, mine_rules, parsed, rule_verdicts, url_filter, url_host, url_path

URLS = [
    ("http://a.Example.NET/en/5?x=1#t", "a.example.net", "/en/5", "example.net/en/", "allow"),
    ("http://example.net/EN/5", "example.net", "/EN/5", "net/", "block"),
    ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("https://x.net", "x.net", "", None, None),
    ("https://x.net?q=/en/", "x.net", "", None, None),
    ("//x.net/en/", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://www.example.com/de/#x", "www.example.com", "/de/", "example.com/de/", "block"),
    ("http://www.example.com/de", "www.example.com", "/de", None, None),
    ("ftp://o.org/fr/1.html", "o.org", "/fr/1.html", "org/fr/", "allow"),
    ("http://É.ORG/fr/", "É.org", "/fr/", "org/fr/", "allow"),
    ("http:///fr/", "", "/fr/", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://x.org/fr/\nline", "x.org", "/fr/\nline", "org/fr/", "allow"),
]


def test_hosts_paths_and_listed_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id int, url string")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    got = df.select("page_id", host.alias("h"), path.alias("p"), listed_rule(host, path).alias("r")).collect()
    for r in got:
        _, h, p, rule, verdict = URLS[r["page_id"]]
        assert (r["h"], r["p"]) == (h, p)
        assert (r["r"] and (r["r"]["rule"], r["r"]["verdict"])) == (rule and (rule, verdict))


def test_host_suffixes(spark):
    assert spark.range(1).select(host_suffixes(F.lit("a.b.c"))).first()[0] == ["a.b.c", "b.c", "c"]


def brute_rules(examples, min_support, min_confidence):
    """Every token set and its best verdict, by counting all subsets."""
    counts, both = {}, {}
    for tokens, verdict in examples:
        for n in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), n):
                counts[s] = counts.get(s, 0) + 1
                both[s, verdict] = both.get((s, verdict), 0) + 1
    need = -(-min_support * len(examples) // 1)
    rules = {(s, v): n / counts[s] for (s, v), n in both.items() if n >= need and n / counts[s] >= min_confidence}
    return {(s, v): c for (s, v), c in rules.items()
            if not any(v2 == v and set(t) < set(s) and c2 >= c - 1e-9 for (t, v2), c2 in rules.items())}


def test_mined_rules_equal_brute_force(spark):
    examples = [(["a", "b"], "block"), (["a", "c"], "block"), (["a", "b", "c"], "allow"), (["b"], "allow"), (["b", "c"], "allow"),
                (["d"], "block"), (["d", "b"], "block"), (["d", "a"], "allow")] * 3
    rules = mine_rules(spark.createDataFrame(examples, "tokens array<string>, verdict string"), 0.1, 0.6)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    want = brute_rules(examples, 0.1, 0.6)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    probes = spark.createDataFrame([(["a", "b"],), (["b", "c", "z"],), (["z"],), ([],)], "tokens array<string>")
    found = {tuple(r["m_tokens"]): r["mined"] for r in rule_verdicts(probes, rules).collect()}
    best = {}
    for tokens in (("a", "b"), ("b", "c", "z")):
        fits = [(c, v) for (s, v), c in want.items() if set(s) <= set(tokens)]
        best[tokens] = max(fits)[0], {v for c, v in fits if c == max(fits)[0]}
        assert found[tokens] in best[tokens][1]
    assert ("z",) not in found


def test_tokens_of_the_same_examples_lose_no_rule(spark):
    """Three tokens always together, two others as well, ties between rules; the brute force counts every subset."""
    examples = [(["a", "b", "c", "x", "y"], "block")] * 6 + [(["a", "b", "c"], "allow")] * 3 + [(["x", "y", "z"], "allow")] * 4
    rules = mine_rules(spark.createDataFrame(examples, "tokens array<string>, verdict string"), 0.1, 0.5)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    want = brute_rules(examples, 0.1, 0.5)
    assert got.keys() == want.keys() and (("a", "x"), "block") in want and (("c", "y"), "block") in want
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_random_examples_equal_brute_force(spark):
    rng = random.Random(11)
    examples = []
    for _ in range(60):
        tokens = [t for t in "abcdef" if rng.random() < 0.5] or ["a"]
        examples.append((tokens + ["a2"] * ("a" in tokens), "block" if "b" in tokens and rng.random() < 0.8 else "allow"))
    rules = mine_rules(spark.createDataFrame(examples, "tokens array<string>, verdict string"), 0.05, 0.7)
    got = {(tuple(r["antecedent"]), r["verdict"]) for r in rules.collect()}
    assert got == brute_rules(examples, 0.05, 0.7).keys()


def test_deep_urls(spark):
    """What decides stands in the ninth segment and the sixth query key; the shared depth above it costs no rules."""
    deep = "/".join(f"s{i}" for i in range(8))
    keys = "&".join(f"k{i}=1" for i in range(5))
    url = "http://h.com/{}/{}/p?{}&{}=1"
    labels = [(url.format(deep, "bad" if i % 2 else "good", keys, "z" if i % 2 else "y"), "block" if i % 2 else "allow") for i in range(20)]
    pages = [(1, f"http://h.com/{deep}/bad/q"), (2, f"http://h.com/{deep}/good/q"), (3, f"http://o.com/q?{keys}&z=3"),
             (4, "http://o.com/" + "x/" * 5000), (5, "http://h.com/p?" + "&".join(f"u{i}" for i in range(3000)))]
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in url_filter(
        spark.createDataFrame(pages, "page_id int, url string"), listed=[("none.invalid/", "block")],
        labels=spark.createDataFrame(labels, "url string, verdict string")).collect()}
    assert got == {1: ("block", "p8:bad"), 2: ("allow", "p8:good"), 3: ("block", "q:z"), 4: ("allow", None), 5: ("allow", None)}


def test_filter_over_all_rows(spark):
    pages = [(i, f"http://s{i % 3}.{'example.net' if i % 2 else 'other.com'}/{'en' if i % 5 else 'de'}/{i}", "x", "y") for i in range(80)]
    pages += [(5, pages[5][1], "x", "y"), (None, None, None, None), (900, "junk", None, None)]
    got = url_filter(spark.createDataFrame(pages, "page_id int, url string, host string, tokens string")).collect()
    assert len(got) == len(pages)
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    assert all(r["verdict"] == "allow" for r in got if not r["host"])
    listed = [r for r in got if r["rule"]]
    assert listed and all(r["mined_rule"] is None for r in listed)
    # what the list says of example.net carries over by language
    assert {r["verdict"] for r in got if r["host"].endswith("other.com") and r["path"].startswith("/en/")} == {"allow"}


def test_given_labels(spark):
    pages = spark.createDataFrame([(1, "http://casino.example.com/a/1"), (2, "http://news.example.com/a/2")], "page_id int, url string")
    labels = spark.createDataFrame([(f"http://casino.site{i % 3}.com/a/{i}", "block") for i in range(6)]
                                   + [(f"http://news.site{i % 3}.com/a/{i}", "allow") for i in range(6)], "url string, verdict string")
    # places count from the right, so the third label from the right is the shared token
    got = {r["page_id"]: r["verdict"] for r in url_filter(pages, listed=[("none.invalid/", "block")], labels=labels).collect()}
    assert got == {1: "block", 2: "allow"}


def test_empty(spark):
    assert url_filter(spark.createDataFrame([], "page_id int, url string")).collect() == []


def test_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.org/fr/")], "page_id int, url string")
    plan = url_filter(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tokens_of_odd_urls(spark):
    got = parsed(spark.createDataFrame([("http://A..b./x//y.html?p=1&&p=2&q",), ("http://",), (None,)], "url string")).collect()
    assert got[0]["tokens"] == ["h0:b", "h1:a", "p0:x", "p1:y.html", "q:p", "q:q", "e:html"]
    assert got[1]["tokens"] == [] and got[2]["tokens"] == []
