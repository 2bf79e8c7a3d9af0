import numpy as np
import pytest
from pyspark.sql import functions as F

from vakanz.llm import url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/de/", "block"),
         ("com/fr/", "allow")]
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x?y#z", "http://a.b.example.org/en/17", "http://example.org",
    "http://notexample.org/es/", "http://x.com/de/1", "http://com/fr/?q", "http://x.com?de/", "a://b://org/", "http://..org/",
    "http://ÄX.ORG/", "http://x.org:80/", "http://u@x.org/a b\nc", "x://" + "s." * 5000 + "org/es/" + "p" * 9000,
]


def judged(url):
    """The rule that holds, by trying all of them."""
    at = (url or "").find("://")
    rest = url[at + 3:] if url and at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, action in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule, action))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_against_every_rule(spark, limit):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumn(
        "host", F.lit("clash")).withColumn("keys", F.lit(1))
    rules = spark.createDataFrame(RULES, "rule string, action string")
    out = url_filter.judge_urls(urls, rules, keep=["page_id"], max_filter_bytes=limit)
    got = {r["page_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS * 2)}


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "rule string, action string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, rules, keep=["page_id"]).count() == 0
    some = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert url_filter.judge_urls(some, rules.limit(0), keep=["page_id"]).first()["verdict"] == "allow"


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("x"), "id").alias("h2"),
                                      (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    rows = keys.toPandas()
    found = cascade.has(rows["h1"].to_numpy(), rows["h2"].to_numpy())
    assert (found == rows["listed"].to_numpy()).all() and len(cascade.levels) > 2
    assert cascade.size_bytes < 30_000
    assert not url_filter.Cascade().has(np.array([1]), np.array([2])).any()
