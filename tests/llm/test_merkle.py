import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vakanz.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, fan):
    """The last node, and per node its siblings (left, right) by level."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        for leaf, spot in enumerate(spots):
            run = runs[spot // fan]
            paths[leaf].append(("".join(run[:spot % fan]), "".join(run[spot % fan + 1:])))
            spots[leaf] = spot // fan
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows, fan):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, text)."""
    groups = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id, h(field(doc_id), field(source), field(text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, inside = [], {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        top, inside[source] = climb([leaf for _, leaf in groups[source]], fan)
        tops.append(top)
    if not tops:
        return Counter()
    root, above = climb(tops, fan)
    return Counter((doc_id, leaf, top, root, tuple(path + up)) for source, top, up in zip(order, tops, above)
                   for (doc_id, leaf), path in zip(groups[source], inside[source]))


def made(spark, rows, fan):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                               "doc_id long, source string, text string, leaf string, idx int, path string")
    cols = [F.col(c) for c in ("doc_id", "source", "text")]
    out = merkle.manifest(df, merkle.leaf_of(cols), F.col("source"), [F.col("doc_id")], F.struct("doc_id", "idx"), fan=fan)
    return Counter((r.row.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in out.collect())


@pytest.mark.parametrize("fan", [2, 16])
def test_against_a_plain_tree(spark, fan):
    rows = [(i, f"s{i % 3}", f"text {i}") for i in range(70)] + [(i, f"z{i}", "one of its kind") for i in range(40)]
    assert made(spark, rows, fan) == brute(rows, fan)


def test_runs_at_their_edges(spark):
    for n in (1, 15, 16, 17, 33):
        rows = [(i, "a", f"t{i}") for i in range(n)]
        assert made(spark, rows, 16) == brute(rows, 16)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, None, ""), (None, "ä", "x" * 100_000), (None, "z", "y"), (3, "z", "Ü🙂"), (3, "z", "Ü🙂"),
            (3, "z", "other"), (4, "", "empty source"), (-5, "z", None)]
    assert made(spark, rows, 16) == brute(rows, 16)
    assert made(spark, [], 16) == Counter()


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", "lang", "n_chars", "text").collect()]
    found = {r.doc_id: r for r in queries.op13(spark, sf_dir).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert len(found) == len(rows)
    for doc_id, source, lang, n_chars, text in rows:
        r = found[doc_id]
        assert r.leaf == h(*map(field, (doc_id, source, lang, n_chars, text)))
        changed = zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None and text.translate(low) != text
        assert r.verified is not changed and (r.folded_root == r.root) is r.verified
