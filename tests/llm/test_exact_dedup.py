import hashlib
import random
import re
from collections import defaultdict

from vakanz.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append(row)
    out = []
    for sha, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = False
        for r in sorted(members, key=str):
            this = not kept and r[0] == best[0] and len(r[1] or "") == len(best[1] or "")
            kept |= this
            out.append((r[0], best[0], len(members), this, sha))
    return sorted(out, key=str)


def test_verdicts(odd_docs, odd_rows, no_docs):
    got = sorted((tuple(r) for r in exact_dedup.verdicts(odd_docs).collect()), key=str)
    assert got == expected(odd_rows)
    assert exact_dedup.verdicts(no_docs).count() == 0


def test_deduplicate_keeps_columns(odd_docs, odd_rows, no_docs):
    out = exact_dedup.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    got = sorted(str(r["doc_id"]) for r in out.collect())
    assert got == sorted(str(r[0]) for r in expected(odd_rows) if r[3])
    assert exact_dedup.deduplicate(no_docs).count() == 0


def test_large_group_of_copies(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}", "en", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((tuple(r) for r in exact_dedup.verdicts(docs).collect()), key=str)
    assert got == expected(rows)


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(5), exact_dedup.CuckooIndex(8), {}
    for _ in range(20_000):
        digest = rng.randrange(400) << 48 | rng.randrange(64)  # crowded on purpose
        content = f"c{rng.randrange(3)}"
        if (digest, content) in live and rng.random() < 0.6:
            assert index.delete(digest, content)
            del live[digest, content]
        elif (digest, content) not in live:
            assert index.find(digest, content) is None
            index.insert(digest, content, (digest, content))
            live[digest, content] = True
        assert not index.delete(digest, "never")
    assert index.size == len(live) == sum(1 for _ in index.entries())
    assert all(index.find(*key)[2] == key for key in live)


def test_insert_and_delete(spark):
    schema = "doc_id long, text string"
    first = exact_dedup.contents(spark.createDataFrame([(5, "a b"), (6, "c")], schema))
    second = exact_dedup.contents(spark.createDataFrame([(1, "ab"), (2, "a  b"), (7, "d")], schema))
    index = exact_dedup.insert(exact_dedup.build_index(first, 4), second, 4)
    state = {r["content"]: (r["keep_id"], r["keep_chars"], r["n"]) for r in index.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert state == {sha("ab"): (2, 4, 3), sha("c"): (6, 1, 1), sha("d"): (7, 1, 1)}
    gone = spark.createDataFrame([(sha("c"),), (sha("zzz"),)], "content string")
    assert {r["content"] for r in exact_dedup.delete(index, gone, 4).collect()} == {sha("ab"), sha("d")}
