import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vakanz.llm import quality_rules as rules


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    words = words_of(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    n, repeated = len(words), len(inside)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated,
            n < 20 or 100 * repeated > 30 * n)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark, odd_docs, odd_rows, no_docs, sf_dir):
    trusted = spark.createDataFrame([(8,)], "doc_id long")
    got = rules.judge(odd_docs, trusted).select("row.text", *NAMES).collect()
    assert len(got) == len(odd_rows)
    assert all(tuple(r)[1:] == counts(r["text"]) for r in got)
    assert rules.judge(no_docs, trusted).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900, "a b c d e f g h " * 5 + "x"), (901, "r " * 30), (902, "a b c d e f g h i a b c d e f g h i j k l m")],
                                  "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = rules.judge(both, trusted).select("row.text", *NAMES).collect()
    assert all(tuple(r)[1:] == counts(r["text"]) for r in got) and len(got) == docs.count() + 3


def test_keep_good_keeps_columns_and_threshold(spark, odd_docs):
    trusted = spark.createDataFrame([(8,)], "doc_id long")
    assert rules.keep_good(odd_docs, trusted).columns == odd_docs.columns
    judged = rules.judge(odd_docs, trusted, threshold=-0.05)
    wrong = judged.filter(F.col("kept") != (~F.col("base_failed") & (F.col("ratio") >= -0.05)))
    assert wrong.count() == 0


def test_ratio_separates(spark):
    good = [(i, " ".join(f"{'abcde'[(i + j) % 5]}{(i * j) % 7}" for j in range(40))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"#{'xyz'[(i + j) % 3]}{(i * j) % 7}" for j in range(40))) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    got = {r["doc_id"]: r["ratio"] for r in rules.judge(docs, trusted).select("row.doc_id", "ratio").collect()}
    assert min(got[i] for i, _ in good) > 0 > max(got[i] for i, _ in bad)
    none = rules.judge(docs, trusted.limit(0)).agg(F.max(F.abs("ratio"))).first()[0]
    assert none == 0.0


def test_no_python_in_the_plan(spark, odd_docs):
    plan = rules.judge(odd_docs, spark.createDataFrame([(8,)], "doc_id long"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in text and "MapInArrow" not in text


def _hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def brute(rows, trusted, n_cells=8192, shrink=3.0, prior_per_cell=32.0):
    """Ratio of every row, and the threshold, from the definition."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    held = {i for i in trusted if signed(_hash(i.to_bytes(8, "little", signed=True), _hash(b"held out"))) % 4 == 0}

    def cells(text):
        low = [w.lower().encode() for w in words_of(text)]
        return [signed(_hash(w)) % n_cells for w in low] + [signed(_hash(b, _hash(a))) % n_cells for a, b in zip(low, low[1:])]

    raw, good = Counter(), Counter()
    for i, text in rows:
        raw.update(cells(text))
        if i in trusted and i not in held:
            good.update(cells(text))
    n_raw, n_good, prior = sum(raw.values()) + n_cells, sum(good.values()), prior_per_cell * n_cells
    table = []
    for c in range(n_cells):
        share = (raw[c] + 1) / n_raw
        table.append(min(shrink, max(-shrink, math.log((good[c] + prior * share) / ((n_good + prior) * share)))))
    ratios = [(i, t, sum(table[c] for c in cells(t)) / max(1, 2 * len(words_of(t)) - 1)) for i, t in rows]
    return ratios, sorted(r for i, t, r in ratios if i in held and len(words_of(t)) >= 20)


def test_ratio_and_verdict_against_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = [tuple(r) for r in docs.collect()]
    trusted = {r[0] for r in labels.distinct().collect()}
    want, held = brute(rows, trusted)
    threshold = held[0]  # the 0.001 quantile of fewer than a thousand
    got = {r["doc_id"]: r for r in rules.judge(docs, labels).select("row.doc_id", "ratio", "base_failed", "kept").collect()}
    assert len(held) < 1000 and len(got) == len(want)
    for i, text, ratio in want:
        assert abs(got[i]["ratio"] - ratio) < 1e-9
        assert got[i]["base_failed"] == counts(text)[-1]
        if abs(ratio - threshold) > 1e-9:
            assert got[i]["kept"] == (not counts(text)[-1] and ratio >= threshold)
    assert np.isfinite(threshold)


def test_rule_keeps_clean_documents(spark):
    """On the larger table nearly every good document behind the base rules stays, few of the others do."""
    where = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judge(docs, labels.filter("quality = 1").select("doc_id")).select("row.doc_id", "base_failed", "kept")
    known = judged.filter("NOT base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["s"] for r in known.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.985 and share[0] < 0.15


def test_every_trusted_document_counts(spark):
    """More trusted documents than any fixed number: all of them make the ratios, by either join."""
    rows = [(i, f"w{i % 700} common w{(i * 7) % 900}") for i in range(21_000)] + [(30_000 + i, f"x{i % 50} common") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.range(21_000).toDF("doc_id")
    want = {i: ratio for i, _, ratio in brute(rows, set(range(21_000)))[0]}
    for most in (rules.BROADCAST_IDS, 10):
        judged = rules.judge(docs, trusted, threshold=0.0, broadcast_ids=most)
        got = {r["doc_id"]: r["ratio"] for r in judged.select("row.doc_id", "ratio").collect()}
        assert len(got) == len(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9
