import random
import re
from itertools import combinations

import numpy as np
import pytest

from vakanz.llm import near_dup, queries


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def set_of(text, k):
    w = words_of(text)
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent=80):
    """Components over every pair."""
    sets = [set_of(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([(r[0], s) for r, s in zip(rows, sets) if r[0] is not None and s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    found = [None if i is None else find(i) if s else i for (i, _), s in zip(rows, sets)]
    return sorted(((i, len(s), c, i is None or c == i) for (i, _), s, c in zip(rows, sets, found)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def varied(seed, groups, size, changes):
    """Groups of texts with some words changed, similarities around the threshold."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, changes)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(5000)}"
            rows.append((len(rows) * 3 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize("words", [4, 5])
def test_components_against_all_pairs(spark, words):
    rows = varied(4, 25, 12, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dup.near_components(docs, words=words)) == brute(rows, words)


def test_one_large_group_around_the_threshold(spark):
    rows = [(i, t) for i, (_, t) in enumerate(varied(9, 1, 250, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dup.near_components(docs, words=4)) == brute(rows, 4)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = result(near_dup.near_components(odd_docs, words=4))
    assert got == brute([r[:2] for r in odd_rows], 4)
    assert near_dup.near_components(no_docs).count() == 0
    kept = near_dup.deduplicate(odd_docs, words=4)
    assert kept.columns == odd_docs.columns
    want = sorted({str(r[0]) for r in got if r[3] and r[0] is not None})
    assert sorted(str(r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == want


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = ("x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6", "z1 z2 z3 z4 z5 z6")
    rows = [(5, a), (3, a), (5, b), (7, b), (8, c), (9, c), (9, ""), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dup.near_components(docs, words=4)) == brute(rows, 4)


def test_deduplicate_compares_rows_not_ids(spark):
    """Unrelated texts under one id all stay; copies without an id go."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(9)) for x in "abcd")
    rows = [(7, a), (5, b), (5, a), (None, b), (None, c), (None, c), (9, ""), (9, d), (None, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "key long, body string")
        kept = near_dup.deduplicate(docs, id_col="key", text_col="body", words=4)
        got = sorted(((r["key"], r["body"]) for r in kept.collect()), key=str)
        assert got == sorted([(5, a), (5, b), (9, ""), (9, d), (None, c), (None, None)], key=str)


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op9(spark, sf_dir)) == brute(rows, 4)


def test_hashing():
    long = " ".join(f"w{i}" for i in range(400_000))  # cut into several pieces
    assert len(near_dup.shingles(long, 5)) == 400_000 - 4
    assert len(near_dup.word_hashes(("x" * 3_000_000 + " y").encode())) == 2
    assert (near_dup.word_hashes(b"b a") == near_dup.word_hashes(b"  b\x0ba\r")).all()
    assert len(set(near_dup.word_hashes(" ".join(f"{i:b}" for i in range(50_000)).encode()).tolist())) == 50_000
    assert len(near_dup.shingles("A b C", 5)) == 1 and (near_dup.shingles("A b", 5) == near_dup.shingles("a  B", 5)).all()
    same = near_dup.signature(near_dup.shingles(long, 5))
    assert same.dtype == np.uint32 and len(same) == near_dup.VALUES


def test_bounds_keep_pairs_at_the_threshold():
    needed = near_dup.least_matches(0.8, 1e-6)
    assert [k for k, _ in needed] == list(range(near_dup.BATCH, near_dup.VALUES + 1, near_dup.BATCH))
    agree = np.random.default_rng(1).random((20_000, near_dup.VALUES)) < 0.8
    for k, m in needed:
        assert (agree[:, :k].sum(axis=1) >= m).mean() > 0.9995
    apart = np.random.default_rng(2).random((20_000, near_dup.VALUES)) < 0.5
    assert (apart.sum(axis=1) >= needed[-1][1]).mean() < 0.01
