import random
from collections import defaultdict

import numpy as np
import pytest

from vakanz.llm import best_fit


def by_trying_all(items, capacity):
    """Tightest compatible bin by looking at every bin; of equal ones the oldest."""
    bins, chosen = [], []
    for size, source, cluster in items:
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and b["left"] > 0
                and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[n]["left"] -= size
        bins[n]["sources"].add(source)
        bins[n]["clusters"].add(cluster)
        chosen.append(n)
    return chosen


@pytest.mark.parametrize("seed", range(12))
def test_against_all_bins(seed):
    rng = random.Random(seed)
    items = [(rng.randrange(1, 101), rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice([None, *range(30)])) for _ in range(400)]
    if seed % 2:
        items.sort(key=lambda x: -x[0])
    if seed % 3 == 0:  # a third of all rows in one cluster
        items = [(s, None, 0 if i % 3 else c) for i, (s, _, c) in enumerate(items)]
    assert best_fit.best_fit(items, 100) == by_trying_all(items, 100)


def check_pieces(rows, sizes, capacity):
    bins, whole = defaultdict(list), defaultdict(int)
    for r in rows:
        if r["bin"] is not None:
            bins[r["bin"]].append(r)
            whole[r["doc_id"]] += r["n_words"]
        else:
            assert r["n_words"] == 0
    for held in bins.values():
        assert sum(r["n_words"] for r in held) == held[0]["bin_words"] <= capacity
        assert sorted(r["bin_place"] for r in held) == list(range(len(held)))
    assert {k: v for k, v in sizes.items() if v} == dict(whole)
    return bins


def test_odd_rows(odd_docs, odd_rows, no_docs):
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[0]] += len((r[1] or "").encode().split())
    rows = best_fit.pack(odd_docs, capacity=100).collect()
    bins = check_pieces(rows, sizes, 100)
    source = {r[0]: r[3] for r in odd_rows}
    for held in bins.values():
        named = [source[r["doc_id"]] for r in held if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
    assert best_fit.pack(no_docs).count() == 0 and best_fit.pack_texts(no_docs).count() == 0


def test_texts_lie_whole_in_their_bins(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    words = lambda t: (t or "").encode().split()
    want = sorted(w for r in docs.collect() for w in words(r["text"]))
    out = best_fit.pack_texts(docs, capacity=100).collect()
    assert all(len(words(r["text"])) == r["n_words"] <= 100 and len(r["doc_ids"]) == len(set(r["doc_ids"])) for r in out)
    assert sorted(w for r in out for w in words(r["text"])) == want


def test_table_is_packed_tightly(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in docs.collect()}
    bins = check_pieces(best_fit.pack(docs, spread_sources=False).collect(), sizes, 2048)
    assert len(bins) <= np.ceil(sum(sizes.values()) / 2048) * 1.1 + 1
