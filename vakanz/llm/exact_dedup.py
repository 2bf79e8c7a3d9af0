"""Exact deduplication behind a cuckoo-filter index.

Texts are equal when they are the same after deleting white space; the SHA-256 of what is left is
the content, a 64-bit hash of it the live digest. Digests are dealt to buckets by hash. A bucket
holds a cuckoo filter (16-bit fingerprints, two places of four slots each) and the contents by their
first place. A digest that the filter does not know is new; a hit is verified against the contents
of its place, so a false positive never merges two texts. A full filter is rebuilt at twice the size
from the stored digests. Deleting takes a content away and frees its fingerprint.

A group of copies may hold any share of the rows: rows are first counted per (content, number of
code points, id) and then per (content, salt), both with a partial sum before the shuffle, so a
content sends at most ``SALTS`` rows to its bucket. A bucket holds about ``PER_BUCKET`` contents.

Defined results: a null text counts as empty, and all empty texts are equal; of equal texts the one
with the most code points, then the smallest id stays (a null id after all others); of rows that
agree in both just one stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import SPACE, stage

SLOTS, MAX_KICKS, FILL = 4, 200, 0.9
SALTS = 32
PER_BUCKET = 4096
ENTRY = "bucket long, digest long, content string, keep_id long, keep_chars long, ties long, n long"


class CuckooIndex:
    """Contents of one bucket behind a cuckoo filter."""

    def __init__(self, capacity: int = 64):
        self.contents: dict[int, list[list]] = {}  # first place -> [digest, content, payload]
        self.size = 0
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        places = 8
        while places * SLOTS * FILL < capacity:
            places *= 2
        self.mask = places - 1
        self.slots = [0] * (places * SLOTS)

    def _fingerprint(self, digest: int) -> int:
        return (digest >> 48 & 0xFFFF) or 1

    def _places(self, digest: int) -> tuple[int, int, int]:
        mark = self._fingerprint(digest)
        first = digest & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995 >> 7)) & self.mask

    def maybe_has(self, digest: int) -> bool:
        mark, first, second = self._places(digest)
        return mark in self.slots[first * SLOTS:first * SLOTS + SLOTS] or (
            mark in self.slots[second * SLOTS:second * SLOTS + SLOTS])

    def find(self, digest: int, content: str) -> list | None:
        """The stored entry; the filter first, then the contents of the digest's place."""
        if not self.maybe_has(digest):
            return None
        for entry in self.contents.get(digest & self.mask, ()):
            if entry[0] == digest and entry[1] == content:
                return entry
        return None

    def insert(self, digest: int, content: str, payload) -> None:
        self.contents.setdefault(digest & self.mask, []).append([digest, content, payload])
        self.size += 1
        if not self._place(digest):
            self._grow()

    def _place(self, digest: int) -> bool:
        mark, place, second = self._places(digest)
        for spot in (place, second):
            for i in range(spot * SLOTS, spot * SLOTS + SLOTS):
                if not self.slots[i]:
                    self.slots[i] = mark
                    return True
        for kick in range(MAX_KICKS):
            i = place * SLOTS + (digest + kick) % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            place = self._other(place, mark)
            for i in range(place * SLOTS, place * SLOTS + SLOTS):
                if not self.slots[i]:
                    self.slots[i] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Twice the places, filled from the stored digests.

        Equal digests of different contents share both places; more than those can hold would never
        fit, and then one fingerprint stands for them all.
        """
        entries = [e for chain in self.contents.values() for e in chain]
        digests = list(dict.fromkeys(e[0] for e in entries)) if self._crowded(entries) else [e[0] for e in entries]
        capacity = len(self.slots) * 2
        while True:
            self._clear(int(capacity * FILL))
            if all(self._place(d) for d in digests):
                break
            capacity *= 2
        self.contents = {}
        for entry in entries:
            self.contents.setdefault(entry[0] & self.mask, []).append(entry)

    @staticmethod
    def _crowded(entries: list[list]) -> bool:
        digests = [e[0] for e in entries]
        return len(set(digests)) < len(digests)

    def delete(self, digest: int, content: str) -> bool:
        """Remove a live content; its fingerprint goes unless an equal digest still needs it."""
        entry = self.find(digest, content)
        if entry is None:
            return False
        place = digest & self.mask
        self.contents[place].remove(entry)
        self.size -= 1
        mark, first, second = self._places(digest)
        if any(e[0] == digest for e in self.contents[place]):
            return True
        for spot in (first, second):
            for i in range(spot * SLOTS, spot * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        return True

    def entries(self):
        return (e for chain in self.contents.values() for e in chain)


def content_of(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256)


def contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, chars and a row number, staged: the one scan of the texts."""
    return stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), content_of(F.col(text_col)).alias("content"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"))).withColumn(
        "row_no", F.monotonically_increasing_id())


def summed(rows: DataFrame) -> DataFrame:
    """At most SALTS rows per content: its best (chars, id), how many rows tie, how many there are.

    ``~id`` falls as the id rises and can't overflow; a null id is below every other.
    """
    same = rows.groupBy("content", "chars", "doc_id").agg(F.count("*").alias("same"))
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("back"), "same")).alias("best")
    return same.groupBy("content", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(
        best, F.sum("same").alias("n")).select(
        F.xxhash64("content").alias("digest"), "content", F.bitwise_not("best.back").alias("keep_id"),
        F.col("best.chars").alias("keep_chars"), F.col("best.same").alias("ties"), "n")


def _better(a: tuple, b: tuple) -> tuple:
    """(keep_id, keep_chars, ties, n) of two sums of one content."""
    n = a[3] + b[3]
    rank = lambda x: (x[1], x[0] is not None, -(x[0] or 0))
    if rank(a) == rank(b):
        return a[0], a[1], a[2] + b[2], n
    return (*max(a, b, key=rank)[:3], n)


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex(len(frame))
    bucket = int(frame["bucket"].iloc[0])
    ids = [None if x is None or x is pd.NA or x != x else int(x) for x in frame["keep_id"].tolist()]
    columns = (frame[c].tolist() for c in ("digest", "content"))
    rest = (frame[c].tolist() for c in ("keep_chars", "ties", "n"))
    for digest, content, keep, chars, ties, n in zip(*columns, ids, *rest):
        payload = (keep, chars, ties, n)
        digest &= (1 << 64) - 1
        entry = index.find(digest, content)
        if entry is None:
            index.insert(digest, content, payload)
        else:
            entry[2] = _better(entry[2], payload)
    rows = [(bucket, np.uint64(d).astype(np.int64), c, *p) for d, c, p in index.entries()]
    out = pd.DataFrame(rows, columns=["bucket", "digest", "content", "keep_id", "keep_chars", "ties", "n"])
    out["keep_id"] = out["keep_id"].astype("Int64")
    return out


def n_buckets(n_contents: int) -> int:
    return max(1, -(-n_contents // PER_BUCKET))


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """Index entries of :func:`contents`: one row per content, merged behind its bucket's filter."""
    bucket = F.pmod(F.shiftright("digest", 16), F.lit(buckets)).alias("bucket")
    return summed(rows).select(bucket, "*").groupBy("bucket").applyInPandas(_merge, ENTRY)


def insert(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """Index after a further batch of :func:`contents`; only ``index`` and the batch's sums move."""
    bucket = F.pmod(F.shiftright("digest", 16), F.lit(buckets)).alias("bucket")
    both = index.unionByName(summed(rows).select(bucket, "*"))
    return both.groupBy("bucket").applyInPandas(_merge, ENTRY)


def _remove(live: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex(len(live))
    for row in live.itertuples(index=False):
        index.insert(row.digest & (1 << 64) - 1, row.content, row)
    for row in gone.itertuples(index=False):
        index.delete(row.digest & (1 << 64) - 1, row.content)
    out = pd.DataFrame([e[2] for e in index.entries()], columns=list(live.columns))
    out["keep_id"] = out["keep_id"].astype("Int64")
    return out


def delete(index: DataFrame, gone: DataFrame, buckets: int) -> DataFrame:
    """Index without the contents named in ``gone`` (content)."""
    digest = F.xxhash64("content")
    gone = gone.select("content", digest.alias("digest")).distinct()
    gone = gone.withColumn("bucket", F.pmod(F.shiftright("digest", 16), F.lit(buckets)))
    return index.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInPandas(_remove, ENTRY)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = contents(docs, id_col, text_col)
    index = stage(build_index(rows, n_buckets(rows.count())))
    named = index.select(F.col("content").alias("c"), "keep_id", "keep_chars", "ties", F.col("n").alias("group_size"))
    # a content with a third of the rows is only large on the left, which adaptive joins may split
    out = rows.join(named, F.col("content") == F.col("c")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))
    cols = [F.col("doc_id"), "keep_id", "group_size", "kept", F.col("content").alias("text_sha256")]
    if index.filter("ties > 1").isEmpty():
        return out.select(*cols)
    tied = F.col("kept") & (F.col("ties") > 1)
    one = out.filter(tied).groupBy("content").agg(F.min("row_no").alias("row"))
    others = out.join(one.withColumnRenamed("content", "t"), F.col("content") == F.col("t"), "left").withColumn(
        "kept", F.when(tied, F.col("row_no") == F.col("row")).otherwise(F.col("kept")))
    return others.select(*cols)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``."""
    rows = contents(docs, id_col, text_col)
    index = stage(build_index(rows, n_buckets(rows.count())))
    named = index.select(F.col("content").alias("c"), "keep_id", "keep_chars", "ties")
    packed = docs.select(
        F.struct("*").alias("row"), content_of(F.col(text_col)).alias("content"),
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    kept = packed.join(named, F.col("content") == F.col("c")).filter(
        F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))
    if not index.filter("ties > 1").isEmpty():
        single = kept.filter("ties = 1").select("row")
        kept = single.unionByName(kept.filter("ties > 1").groupBy("content").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")
