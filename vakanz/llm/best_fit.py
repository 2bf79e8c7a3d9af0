"""Conflict-constrained best-fit packing.

Documents are packed into bins of ``capacity`` words. Bins stand in the order of what is left in
them. A document, largest first, goes to the successor of its size in that order: the fullest bin
that still takes it. A bin carries two bitmaps, of its sources and of its duplicate clusters; if it
already holds the document's source or cluster, the search goes on to the next bin until one is
compatible, and opens a new one at the end. So no bin repeats a source or holds two copies, and each
document lies in the tightest bin it may lie in. ``spread_sources=False`` leaves sources out.

A document above the capacity is cut into full pieces, each a bin of its own, and a rest that is
packed like any other document.

Documents are dealt by a hash of their row to shards of about ``PER_SHARD`` and a shard is packed by
one task, so neither a source nor a cluster gathers anywhere; the bins left open at the end of a
shard are few against its thousands of documents.

Defined results: null and empty texts (size 0) get no bin; a null source or cluster conflicts with
nothing; of equal sizes the lower id goes first (null last); repeated rows are packed one by one; an
empty table gives an empty result; columns not named are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import n_words, stage

PER_SHARD = 4096
PIECES = "doc_id long, piece int, from_word long, n_words long, bin long, bin_place int, bin_words long"
BINS = "bin long, doc_ids array<long>, n_words long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[int]:
    """Bin of every (size, source, cluster), in the given order; sources and clusters are bit numbers."""
    order: list[tuple[int, int]] = []  # (what is left, bin)
    sources, clusters, chosen = [], [], []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, bin_ = order.pop(at)
        else:
            left, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[bin_] |= s
        clusters[bin_] |= c
        if left > size:
            insort(order, (left - size, bin_))
        chosen.append(bin_)
    return chosen


def pieces_of(frame: pd.DataFrame, capacity: int) -> list[tuple]:
    """(row, piece, from_word, n_words, source bit, cluster bit), largest first."""
    bits: tuple[dict, dict] = ({}, {})
    out = []
    columns = (frame[c].tolist() for c in ("size", "source", "cluster"))
    for row, (size, source, cluster) in enumerate(zip(*columns)):
        own = [None if pd.isna(v) else known.setdefault(v, len(known)) for v, known in zip((source, cluster), bits)]
        for piece in range(-(-size // capacity)):
            start = piece * capacity
            out.append((row, piece, start, min(capacity, size - start), *own))
    ids = [(pd.isna(i), 0 if pd.isna(i) else int(i)) for i in frame["doc_id"].tolist()]
    out.sort(key=lambda p: (-p[3], ids[p[0]], p[1], p[0]))
    return out


def packed(frame: pd.DataFrame, capacity: int) -> tuple[list[tuple], list[int]]:
    pieces = pieces_of(frame, capacity)
    return pieces, best_fit([(p[3], p[4], p[5]) for p in pieces], capacity)


def _as_pieces(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        pieces, bins = packed(frame, capacity)
        shard, ids = int(frame["shard"].iloc[0]) << 32, frame["doc_id"].tolist()
        words, held, rows = {}, {}, []
        for p, b in zip(pieces, bins):
            words[b] = words.get(b, 0) + p[3]
        for p, b in zip(pieces, bins):
            held[b] = held.get(b, -1) + 1
            rows.append((ids[p[0]], p[1], p[2], p[3], shard + b, held[b], words[b]))
        rows += [(ids[i], 0, 0, 0, None, None, None) for i, size in enumerate(frame["size"].tolist()) if size == 0]
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "from_word", "n_words", "bin", "bin_place", "bin_words"])
        return out.astype({c: "Int64" for c in ("doc_id", "bin", "bin_place", "bin_words")})

    return pack


def _as_bins(capacity: int, separator: str):
    def cut(text: str, start: int, n: int, size: int) -> str:
        if n == size:
            return text
        spans = [m.span() for m in WORD.finditer(text)][start:start + n]
        return text[spans[0][0]:spans[-1][1]]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        pieces, bins = packed(frame, capacity)
        shard = int(frame["shard"].iloc[0]) << 32
        ids, texts, sizes = (frame[c].tolist() for c in ("doc_id", "text", "size"))
        content: dict[int, list] = {}
        for p, b in zip(pieces, bins):
            content.setdefault(b, []).append(p)
        rows = [(
            shard + b, [None if pd.isna(ids[p[0]]) else int(ids[p[0]]) for p in own], sum(p[3] for p in own),
            separator.join(cut(texts[p[0]], p[2], p[3], sizes[p[0]]) for p in own)) for b, own in content.items()]
        return pd.DataFrame(rows, columns=["bin", "doc_ids", "n_words", "text"])

    return pack


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with a shard; the row number is that of a written table and so stays the same."""
    shards = max(1, -(-rows.count() // PER_SHARD))
    number = F.monotonically_increasing_id()
    return rows.withColumn("shard", F.pmod(F.xxhash64(number), F.lit(shards)))


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", size: Column | None = None, source_col: str = "source",
    cluster: Column | None = None, capacity: int = 2048, spread_sources: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, from_word, n_words, bin, bin_place, bin_words.

    ``size`` defaults to the words of ``text``, ``cluster`` to the id.
    """
    size = n_words(F.col("text")) if size is None else size
    source = F.col(source_col).cast("string") if spread_sources else F.lit(None).cast("string")
    cluster = F.col(id_col) if cluster is None else cluster
    rows = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), source.alias("source"),
        F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster")))
    return _dealt(rows).groupBy("shard").applyInPandas(_as_pieces(capacity), PIECES)


def pack_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    capacity: int = 2048, spread_sources: bool = True, separator: str = "\n\n",
) -> DataFrame:
    """One row per bin: bin, doc_ids, n_words and the joined text. ``docs`` is a written table; the
    duplicate cluster of a row is its id."""
    source = F.col(source_col).cast("string") if spread_sources else F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("size"), source.alias("source"),
        F.col(id_col).alias("cluster"), F.coalesce(text_col, F.lit("")).alias("text"))
    return _dealt(rows).groupBy("shard").applyInPandas(_as_bins(capacity, separator), BINS)
