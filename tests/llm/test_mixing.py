import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vakanz.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair_targets(sizes, weights, passes=3.0):
    """Share round by round; what is above a cap goes to the others."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > passes * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = passes * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("weights", [(1, 2, 3), (5, 1), (1, 100)])
def test_targets_against_rounds(spark, weights):
    sizes = {"a": 10, "b": 4000, "c": 50, None: 900, "d": 0, "é": 77, "Z": 3}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, weights, 3).collect()}
    want = fair_targets(sizes, weights)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def check_mix(docs, rows, **options):
    parts, placed, goal = mixing.mix(docs, **options)
    taken = mixing.taken_words(parts, placed, goal).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in taken) == sorted((str(r[0]), size_of(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    want, got = fair_targets(sizes, (1, 2, 3)), Counter()
    for r in taken:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 1 for s in want), (got, want)
    return parts


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check_mix(odd_docs, odd_rows, block_words=16)
    assert mixing.taken_words(*mixing.mix(no_docs)).count() == 0
    assert mixing.mixed_documents(no_docs).columns == no_docs.columns
    assert mixing.mixed_documents(no_docs).count() == 0


def test_schedule_is_even_and_repeatable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    parts = check_mix(docs, rows, block_words=64).collect()
    again = mixing.mix(docs.repartition(5), block_words=64)[0].collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, parts)) == sorted(map(key, again))
    # every tenth of the schedule holds each source in about the same share
    total, last = Counter(), max(r["slot"] for r in parts) + 1
    tenth = defaultdict(Counter)
    for r in parts:
        total[r["source"]] += r["n_words"]
        tenth[r["slot"] * 10 // last][r["source"]] += r["n_words"]
    for part in tenth.values():
        assert all(abs(part[s] - n / 10) < 0.25 * n / 10 + 4 * 64 for s, n in total.items())
    # a slot holds one source and at most a block
    held = defaultdict(Counter)
    for r in parts:
        held[r["slot"]][r["source"]] += r["n_words"]
    assert all(len(s) == 1 and max(s.values()) <= 64 for s in held.values())


def check_documents(docs, rows, **options):
    """Whole rows only, each source as near to its target as whole rows allow."""
    parts, placed, goal = mixing.mix(docs, **options)
    sizes, got, target = Counter(), Counter(), {}
    for r in mixing.taken_words(parts, placed, goal).collect():
        target[r["source"]] = r["target"]
    given = Counter((str(r[0]), r[1], r[3]) for r in rows)
    out = mixing.mixed_documents(docs, **options)
    assert out.columns == docs.columns
    made = Counter()
    for r in out.select("doc_id", "text", "source").collect():
        made[str(r["doc_id"]), r["text"], r["source"]] += 1
        got[r["source"]] += size_of(r["text"])
        sizes[r["source"]] = max(sizes[r["source"]], size_of(r["text"]))
    assert all(n <= 3 * given[key] for key, n in made.items())
    longest = {s: max(size_of(r[1]) for r in rows if r[3] == s) for s in target}
    assert all(abs(got[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    return made


def test_mixed_documents_are_whole(spark, odd_docs, odd_rows):
    check_documents(odd_docs, odd_rows, block_words=16)
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i * 7 % 40)), "en", "ab"[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert check_documents(docs, rows, block_words=16) == check_documents(docs.repartition(3), rows, block_words=16)


def test_rows_without_an_id_are_spread_and_told_apart(spark):
    rows = [(None, f"a{i} b c", "en", "s") for i in range(60)] + [(7, f"x{i} y", "en", "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = mixing.sized(docs, "doc_id", "text", "source", 16)
    assert placed.select("source", "start").distinct().count() == 100
    made = check_documents(docs, rows, weights=(1, 1), block_words=4)
    assert made == check_documents(docs.repartition(4), rows, weights=(1, 1), block_words=4)
    assert len(made) > 60
