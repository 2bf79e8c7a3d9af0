import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vakanz.llm import hnsw, queries


def brute(rows, asked, k=10):
    """Query row -> ids and scores of its nearest rows, over every pair."""
    fine = [(i, [float(c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)]
    out = []
    for at, (i, q) in enumerate(fine):
        if i is None or not asked(i):
            continue
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v))), j is None, j or 0)
                      for other, (j, v) in enumerate(fine) if other != at and len(v) == len(q))[:k]
        out.append((i, tuple((None if none else j, round(d, 9)) for d, none, j in near)))
    return Counter(out)


def answers(df):
    by = {}
    for r in df.collect():
        by.setdefault((r.query_no, r.query_id), []).append((r["rank"], r.vec_id, round(r.score, 9)))
    for found in by.values():
        assert [f[0] for f in sorted(found)] == list(range(1, len(found) + 1))
    return Counter((i, tuple(f[1:] for f in sorted(found))) for (_, i), found in by.items())


def search(spark, rows, asked, k=10):
    df = spark.createDataFrame([(i, v, "x", 1, [2]) for i, v in rows],
                               "vec_id long, embedding array<double>, v string, shard int, ids array<int>")
    return hnsw.nearest(df, asked, k=k)


def points(seed, n, width):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


def test_small_tables_are_exact(spark):
    rows = points(1, 60, 4)
    want = brute(rows, lambda i: i % 7 == 0)
    assert answers(search(spark, rows, F.col("vec_id") % 7 == 0)) == want
    few = points(2, 5, 3)
    assert answers(search(spark, few, F.col("vec_id") == 0)) == brute(few, lambda i: i == 0)


def test_copies_ties_and_odd_rows(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(100, 140)]
    rows = points(3, 30, 3) + same + [(100, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (None, [0.5, 0.5, 0.5]),
                                      (200, [1.0, 1.0]), (300, [1.5, 1.0]), (300, [1.5, 1.0]), (400, [2.0, 0.0, -0.0])]
    odd = [(500, None), (600, []), (700, [0.0, -0.0, 0.0]), (800, [float("nan"), 1.0, 1.0]), (900, [1.0, None, 1.0]),
           (1000, [float("inf"), 1.0, 1.0])]
    got = answers(search(spark, rows + odd, F.col("vec_id") % 100 == 0))
    want = brute(rows + odd, lambda i: i % 100 == 0)
    assert {i for i, _ in want} == {0, 100, 200, 300, 400} and got == want
    assert search(spark, odd, F.lit(True)).count() == 0
    assert search(spark, [], F.lit(True)).count() == 0


def test_recall_of_one_graph():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32)) * 0.3
    graph, hits = hnsw.Graph.build(x), 0
    for i in range(0, 3000, 30):
        far = np.linalg.norm(x - x[i], axis=1)
        hits += len(set(np.argsort(far)[:11].tolist()) & set(graph.nearest(x[i], 11)[0].tolist()))
    assert hits >= 0.97 * 1100


def test_shards_merge_to_high_recall(spark, monkeypatch):
    rows = points(6, 1500, 16)
    monkeypatch.setattr(hnsw, "MAX_NODES", 200)
    monkeypatch.setattr(hnsw, "QUERIES", 4)
    want = dict(brute(rows, lambda i: i % 100 == 0).keys())
    got = dict(answers(search(spark, rows, F.col("vec_id") % 100 == 0)).keys())
    assert set(got) == set(want)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.97 * 10 * len(want)


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = dict(brute(rows, lambda i: i % 100 == 0).keys())
    got = {}
    for r in queries.op12(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, round(r.score, 9)))
    assert set(got) == set(want) and all(len(f) == 10 for f in got.values())
    assert sum(len(got[i] & set(want[i])) for i in want) >= 0.9 * 10 * len(want)
