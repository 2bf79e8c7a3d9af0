"""Near-duplicates: MinHash bands, sequential Bayesian verification, exact check of the survivors.

A document's set holds its distinct ``WORDS``-word shingles as 64-bit hashes. Documents with equal
sets are one node. Nodes that agree in all ``ROWS`` values of a band are candidates; with 42 bands of
6 a pair at the threshold is missed with probability 3e-6, and a pair of low similarity hardly ever
meets. Candidates are compared in batches of signature values: with a uniform prior, the posterior
probability that the similarity reaches the threshold is known after each batch, and a pair goes as
soon as it falls below ``miss``. Pairs that stay are checked on their full sets.

Only components matter, so copies are never expanded into pairs:

1. every node of a band bucket is compared with the bucket's hub and its lowest node; of the
   surviving pairs each node first checks the one with the most agreeing values. The hub is the
   node whose buckets are the fullest: the copy with the fewest changes of its own;
2. then the other surviving pairs whose ends are still in different components;
3. then the nodes of buckets that still hold several components meet by their rarest shingles.
   In one order of all shingles, rarest first, two sets of the wanted similarity share one among
   the first of each, and its place in both bounds what else they can share. A copy too far from
   its hub has nearly that many shingles of its own, so these are the ones it meets others by.
   Nothing is left after that.

Bucket members, pairs and labels are joins and partial sums, so a large group is spread over tasks.

Defined results: null texts and texts without a word have an empty set and are linked with nothing;
a text shorter than a shingle has its whole word sequence as its one shingle; rows that repeat a
doc_id are one node of the graph (any of their texts links it); rows with a null doc_id are not part
of the graph: component_id null, kept true; an empty table gives an empty result. :func:`deduplicate`
carries all columns and takes each row, also one that repeats an id or has none, as a document.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanz.llm.common import stage

BANDS, ROWS = 42, 6
VALUES = BANDS * ROWS
BATCH = 36  # signature values compared at a time
SALTS = 64
CHUNK = 1 << 20  # bytes of a text hashed at a time
SCHEMA = "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20260101)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_HASH = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit polynomial hash of every word; long texts are cut at white space."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        codes = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        space = _SPACE[codes]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers(1 << max(14, int(end - at).bit_length()))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[codes] * up[: len(codes)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text: sorted distinct hashes."""
    h = word_hashes((text or "").encode().translate(_LOWER))
    if len(h) == 0:
        return h
    size = min(words, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total += h[i:n + i] * _PLACE[i]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """VALUES minima of a set, 32 bits each."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(low, np.multiply.outer(_HASH, found[at:at + 2048]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _profile(words: int):
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, d1, d2, bands, sigs = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, words)
                    n.append(len(found))
                    d1.append(int(mix(found ^ _LETTER[0]).sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(mix(found ^ _LETTER[1]).sum(dtype=np.uint64).astype(np.int64)))
                    if len(found) == 0:
                        bands.append(None)
                        sigs.append(None)
                        continue
                    sig = signature(found)
                    wide = (sig.reshape(BANDS, ROWS).astype(np.uint64) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64)
                    bands.append(mix(wide + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64))
                    sigs.append(sig.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "bands", "sig"])

    return rows


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, matches needed): fewer matches put the posterior below ``miss``.

    One byte of a value is kept, so values agree with probability r = s + (1 - s) / 256; the prior
    of r is uniform.
    """
    grid = (np.arange(8192) + 0.5) / 8192
    reach = grid >= threshold + (1 - threshold) / 256
    needed = []
    for k in range(BATCH, VALUES + 1, BATCH):
        for m in range(k + 1):
            log = m * np.log(grid) + (k - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[reach].sum() >= miss * weight.sum():
                needed.append((k, m))
                break
    return needed


def _compare(needed: list[tuple[int, int]]):
    def keep(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
                    for c in ("sig_a", "sig_b"))
            open_, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            before = 0
            for k, m in needed:
                matches[open_] += (a[open_, before:k] == b[open_, before:k]).sum(axis=1)
                open_, before = open_[matches[open_] >= m], k
            rows = pa.array(open_)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(rows), batch.column("b").take(rows), pa.array(matches[open_])], ["a", "b", "matches"])

    return keep


def survivors(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """a, b, matches of the pairs that sequential comparison does not rule out."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    # the smaller set holds the intersection, the larger one is in the union
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(
        _compare(least_matches(percent / 100, miss)), "a long, b long, matches long").distinct()


def _exact(words: int, percent: int):
    def keep(batches):
        last, last_set = None, None
        for batch in batches:
            rows = []
            for i, (x, y) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())):
                if y != last:
                    last, last_set = y, shingles(y, words)
                own = shingles(x, words)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(last_set) - both):
                    rows.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return keep


def links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold; ``texts`` has node and text."""
    one = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b")
    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(words, percent), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the lowest node reachable over the edges, for every node with an edge.

    Labels move to neighbours and then to the label of their label until none changes; the
    edges here are mostly stars, so few rounds are needed.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        target = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = stage(moved.join(target, "comp", "left").select(
            "node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = moved.select("node", "comp")
        if moved.filter("old <> comp").isEmpty():
            return labels


def _elements(words: int):
    def rows(batches):
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(text, words)
                mark = int(mix(found ^ _LETTER[0]).sum(dtype=np.uint64).astype(np.int64))
                for at in range(0, len(found), CHUNK):
                    part = found[at:at + CHUNK].view(np.int64)
                    same = lambda v, k=len(part): pa.array(np.full(k, v, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [same(node), same(mark), same(len(found)), pa.array(part)], ["node", "mark", "n", "e"])

    return rows


def rare_pairs(texts: DataFrame, comps: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b of different components that can reach the threshold, by their rarest shingles.

    ``texts`` has node and text, ``comps`` node and comp. Of two sets with n and m shingles that reach
    the threshold t = percent * (n + m) / (100 + percent) are common; the first common one in the order
    of all shingles is at place n - t + 1 or before in one and m - t + 1 or before in the other.
    """
    sets = stage(texts.select("node", "text").mapInArrow(_elements(words), "node long, mark long, n long, e long"))
    shared = sets.groupBy("e").agg(F.count("*").alias("f")).filter("f > 1")
    one = Window.partitionBy("node", "mark")
    placed = sets.join(shared, "e").withColumn(
        "place", F.col("n") - F.count("*").over(one) + F.row_number().over(one.orderBy("f", "e")))
    first = stage(placed.filter(F.col("place") * 100 <= F.col("n") * (100 - percent) + 100).join(comps, "node").select(
        "e", "node", "comp", "n", "place"))
    sizes = first.groupBy("e", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("e").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    open_ = first.join(main.filter("comps > 1"), "e")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "n", "place")]
    outside = open_.filter("comp <> main").select("e", *side("a"))
    common = (F.col("n_a") + F.col("n_b")) * percent
    fits = (F.col("comp_a") != F.col("comp_b")) & (
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (
        F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (100 + percent) + 100 + percent >= common)
    both = outside.alias("x").join(open_.select(F.col("e").alias("e_b"), *side("b")).alias("y"), (F.col("e") == F.col("e_b")) & fits)
    return both.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _with_labels(pairs: DataFrame, labels: DataFrame, *sides: str) -> DataFrame:
    for x in sides:
        named = labels.select(F.col("node").alias(x), F.col("comp").alias(f"found_{x}"))
        pairs = pairs.join(named, x, "left").withColumn(f"comp_{x}", F.coalesce(f"found_{x}", x)).drop(f"found_{x}")
    return pairs


def profiles(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(_profile(words), SCHEMA))


def near_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    miss: float = 1e-6,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    known = profiles(docs, id_col, text_col, words)
    in_graph = known.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = stage(in_graph.groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(members.join(full, "bucket"))  # of buckets with two nodes or more
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    ends = members.join(weights, "node").groupBy("bucket").agg(
        F.min("node").alias("low"), F.max(F.struct("weight", "node"))["node"].alias("hub"))
    members = stage(members.select("node", "bucket").join(ends, "bucket"))
    star = members.select(F.col("node").alias("a"), F.explode(F.array("low", "hub")).alias("b")).filter("a <> b").distinct()
    likely = stage(survivors(star, nodes, percent, miss))
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    texts = stage(rows.join(members.select("node").distinct(), "node"))
    first = likely.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    edges = links(first, texts, words, percent)
    # an id with several texts is one document: its nodes are linked
    several = in_graph.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).filter("x <> y")
    if not several.isEmpty():
        own = in_graph.join(several.select("doc_id"), "doc_id").join(nodes, ["n", "d1", "d2"]).select(
            F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
        edges = edges.union(own)
    labels = components(edges)
    more = stage(_with_labels(likely, labels, "a", "b").filter("comp_a <> comp_b").join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        edges = edges.union(links(more, texts, words, percent))
        labels = components(edges)
    spread = _with_labels(members.select(F.col("node").alias("a"), "bucket"), labels, "a")
    mixed = spread.groupBy("bucket").agg(F.min("comp_a").alias("x"), F.max("comp_a").alias("y")).filter("x < y")
    comps = stage(spread.join(mixed.select("bucket"), "bucket").select(F.col("a").alias("node"), F.col("comp_a").alias("comp")).distinct())
    if not comps.isEmpty():
        left = rare_pairs(texts.join(comps.select("node"), "node"), comps, words, percent)
        left = left.join(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
        left = stage(survivors(left, nodes, percent, miss))
        if not left.isEmpty():
            edges = edges.union(links(left, texts, words, percent))
            labels = components(edges)
    found = labels.select("node", "comp")
    # rows that repeat an id join what their texts are linked with
    named = nodes.select("n", "d1", "d2", "node").join(found, "node", "left").select(
        "n", "d1", "d2", F.coalesce("comp", "node").alias("component"))
    out = known.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with all columns of ``docs``.

    Rows are compared by their texts alone, whatever their ids: the graph runs on a row number that is
    written with the rows. Of a component the row with the lowest id stays (null ids last), then by hash of
    the text, then by row number; rows without a word all stay.
    """
    rows = stage(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_no")))
    row_id, text = F.col("row")[id_col], F.col("row")[text_col]
    judged = near_components(rows.select("row_no", text.alias("text")), id_col="row_no", **options)
    judged = stage(judged.select(F.col("doc_id").alias("row_no"), "component_id"))
    rank = rows.select("row_no", F.struct(
        row_id.isNull().alias("no_id"), row_id.alias("id"), F.xxhash64(text).alias("digest"), "row_no").alias("rank"))
    best = rank.join(judged, "row_no").groupBy("component_id").agg(
        F.count("*").alias("size"), F.min("rank")["row_no"].alias("best_no")).filter("size > 1")
    # by salt, so the rows of a large component go to many tasks
    best = best.select("component_id", "best_no", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = judged.withColumn("salt", F.pmod(F.hash("row_no"), F.lit(SALTS)))
    gone = salted.join(best, ["component_id", "salt"]).filter("row_no <> best_no").select("row_no")
    return rows.join(gone, "row_no", "left_anti").select("row.*")
