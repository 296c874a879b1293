"""URL filters: fixed rules, mined rules, odd rows."""

import pytest
from pyspark.sql import functions as F

from tidesmith.llm.url_rules import FIXED, Mining, mine_rules, tokens, url_filter


def verdicts(df, *columns):
    return {r["page_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture
def none_mined(spark):
    return spark.createDataFrame([], "rank int, label string, tokens array<string>, token string, confidence double, support double")


def test_fixed_rules_longest_wins(spark, none_mined):
    urls = [
        "http://example.org/es/1", "http://a.Example.ORG/en/12?x", "http://example.org/en/2", "http://badexample.org/es/1", "https://x.com/fr/", "https://x.com/de/9#a", "https://com/de/", "http://x.net/de/", "http://x.org",
        None, "", "no scheme", "://", "a://b://c/d", "http://example.org:80/es/1", "HTTP://EXAMPLE.ORG/ES/1", "http://u@x.org/a\nb?q",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert verdicts(url_filter(pages, none_mined, FIXED), "host", "path", "rule", "verdict") == {
        0: ("example.org", "/es/1", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "/en/2", "org/", "allow"), 3: ("badexample.org", "/es/1", "org/", "allow"),
        4: ("x.com", "/fr/", "com/fr/", "allow"), 5: ("x.com", "/de/9", "com/de/", "block"), 6: ("com", "/de/", "com/de/", "block"), 7: ("x.net", "/de/", None, "allow"), 8: ("x.org", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("b:", "//c/d", None, "allow"), 14: ("example.org:80", "/es/1", None, "allow"),
        15: ("example.org", "/ES/1", "org/", "allow"), 16: ("u@x.org", "/a\nb", "org/", "allow"),
    }


def test_mined_rules_decide(spark):
    rows = [(f"http://a{i}.com/shop/{i}?ref=x", "allow") for i in range(40)] + [(f"http://a{i}.com/cheap-pills/{i}", "block") for i in range(20)] + [(f"http://b{i}.com/shop/{i}", "allow") for i in range(20)]
    rows += [(f"http://c{i}.com/shop/x/{i}?sid=1", "block") for i in range(20)] + [(f"http://d{i}.com/x/{i}", "allow") for i in range(20)] + [(None, "block"), ("http://a.com/", None)]
    mined = mine_rules(spark.createDataFrame(rows, "url string, label string"), Mining(min_confidence=0.8))
    found = {tuple(r["tokens"]): (r["label"], r["confidence"]) for r in mined.collect()}
    assert found[("p:cheap-pills",)] == ("block", 1.0) and found[("q:sid",)] == ("block", 1.0)
    # what a part says with no less confidence is no rule of its own, and tokens of all rows tell nothing
    assert not [t for t in found if "p:cheap-pills" in t and len(t) > 1] and not [t for t in found if "h:com" in t]
    pages = spark.createDataFrame([(1, "https://new.com/cheap-pills/7"), (2, "http://e.com/shop/x/1?sid=4"), (3, "http://e.com/shop/1?ref=y"), (4, "http://e.net/other"), (5, None), (1, "https://new.com/cheap-pills/7")], "page_id bigint, url string")
    out = url_filter(pages, mined, otherwise="unknown")
    assert out.count() == 6
    assert {k: v[0] for k, v in verdicts(out, "verdict").items()} == {1: "block", 2: "block", 3: "allow", 4: "unknown", 5: "unknown"}


def test_pairs_of_tokens_are_mined(spark):
    rows = [(f"http://x/{a}/{b}/{i}", "block" if (a, b) == ("p", "q") else "allow") for i in range(20) for a in "pr" for b in "qs"]
    mined = mine_rules(spark.createDataFrame(rows, "url string, label string"), Mining(min_confidence=0.9))
    assert ("p:p", "p:q") in {tuple(r["tokens"]) for r in mined.filter("label = 'block'").collect()}
    pages = spark.createDataFrame([(1, "http://x/p/q/"), (2, "http://x/p/s/"), (3, "http://x/r/q/")], "page_id bigint, url string")
    assert {k: v[0] for k, v in verdicts(url_filter(pages, mined), "verdict").items()} == {1: "block", 2: "allow", 3: "allow"}


@pytest.mark.parametrize("rows", [[], [("http://a/b", "allow")] * 20, [(None, None)] * 9])
def test_no_labels_or_one_kind(spark, rows):
    mined = mine_rules(spark.createDataFrame(rows, "url string, label string"))
    pages = spark.createDataFrame([(1, "http://a/b"), (2, None)], "page_id bigint, url string")
    assert {v[0] for v in verdicts(url_filter(pages, mined), "verdict").values()} == {"allow"}
    assert url_filter(pages.limit(0), mined).count() == 0


def test_tokens_are_bounded_and_long_urls_are_whole(spark):
    url = "https://a-b.c.org/" + "/".join(f"s{chr(97 + i % 26)}{'x' * (i % 90)}" for i in range(5000)) + "?a=1&a=2&b#f"
    found = spark.createDataFrame([(url,), (None,)], "url string").select(tokens(F.col("url")).alias("t")).collect()
    assert {"s:https", "h:a-b", "h:c", "w:a", "w:b", "q:a", "q:b", "f:#"} <= set(found[0]["t"]) and max(map(len, found[0]["t"])) <= 64 and found[1]["t"] == []
    assert len(found[0]["t"]) == len(set(found[0]["t"]))


def test_extra_columns_stay(spark, none_mined):
    pages = spark.createDataFrame([(1, "http://x.org/", "mine", "mine", {"k": 1})], "page_id bigint, url string, `a.b` string, verdict string, m map<string,int>").withColumn("we`ird", F.lit(3))
    out = url_filter(pages, none_mined, FIXED)
    assert out.columns == ["page_id", "url", "a.b", "m", "we`ird", "host", "path", "rule", "verdict", "mined_rule"]
    assert out.first()["a.b"] == "mine" and out.first()["verdict"] == "allow" and out.first()["m"] == {"k": 1}
