"""URL rules looked up in a cascade of Bloom filters.

A rule is a host followed by a path prefix (``example.org/es/``). It fits a URL whose host is the
rule's host or one of its subdomains and whose path starts with the rule's path; of several
fitting rules the longest wins (at equal length the one with the longer host).

The corpus asks only for the keys that its own URLs can form. Over this complete key universe the
cascade is exact: level 0 encodes the listed keys, level 1 the unlisted keys that level 0 lets
through, level 2 the listed keys that level 1 lets through, and so on until a level lets nothing
through. Looking a URL up needs the filters only, never a join with the list.

Rates are chosen so that level 0 lets through about as many keys as are listed; the cascade then
has O(listed * log(universe / listed)) bits. That size is computed before anything is built; lists
beyond ``max_filter_bytes`` are cut by key hash into several cascades, looked up in turn.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and
gets the default verdict; repeated rows are judged one by one; an empty rule list gives every URL
the default verdict; other columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and the path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys a rule of this URL could have, longest first: host suffixes times path prefixes."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - F.lit(labels - 1))
    hosts = F.transform(
        F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.lit(labels)), ".")
    )
    paths = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
        lambda p: p.isNotNull(),
    )
    pairs = F.flatten(
        F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(
            (F.length(h) + F.length(p)).alias("size"), F.length(h).alias("host_size"),
            F.concat(h, p).alias("key"))))
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sort_array(pairs, asc=False), lambda c: c["key"])
    )


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


@dataclass
class Level:
    """One Bloom filter: ``bits`` as 64-bit words."""

    n_bits: int
    n_hashes: int
    salt: int
    bits: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), dtype=bool)
        for spot in positions(h1, h2, self.n_bits, self.n_hashes, self.salt):
            found &= (self.bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def positions(h1: np.ndarray, h2: np.ndarray, n_bits: int, n_hashes: int, salt: int):
    """Double hashing; the salt gives every level its own functions."""
    a = h1.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(29)
    b = h2.view(np.uint64) | np.uint64(1)
    for i in range(n_hashes):
        yield ((a + np.uint64(i) * b) % np.uint64(n_bits)).astype(np.int64)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact membership for every key of the universe the cascade was built over."""
        listed = np.zeros(len(h1), dtype=bool)
        open_ = np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_])
            listed[open_[~passed]] = depth % 2 == 1
            open_ = open_[passed]
        # what passes the last level belongs to the set that level encodes
        listed[open_] = len(self.levels) % 2 == 1
        return listed

    @property
    def size_bytes(self) -> int:
        return sum(level.bits.nbytes for level in self.levels)


def _words(n_bits: int, n_hashes: int, salt: int):
    def build(batches):
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(i)) for i in (0, 1))
            if len(h1) == 0:
                continue
            spots = np.unique(np.concatenate(list(positions(h1, h2, n_bits, n_hashes, salt))))
            word, first = np.unique(spots >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (spots & 63).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    return build


def _bloom(keys: DataFrame, n_keys: int, rate: float, salt: int) -> Level:
    """Filter of the keys in ``h1, h2``: words are combined by task and by word before they are
    fetched, so the driver gets the filter (its size is known) and never the keys."""
    n_bits = max(64, 64 * math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2 / 64))
    n_hashes = max(1, round(-math.log2(rate)))
    words = (
        keys.select("h1", "h2").mapInArrow(_words(n_bits, n_hashes, salt), "word long, bits long")
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    bits = np.zeros(n_bits // 64, dtype=np.uint64)
    bits[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return Level(n_bits, n_hashes, salt, bits)


def first_rate(n_listed: int, n_other: int) -> float:
    return min(0.5, max(1e-9, n_listed / max(1, n_other)))


def build_cascade(universe: DataFrame) -> Cascade:
    """Cascade over ``h1, h2, listed``: one row per key of the universe."""
    sizes = universe.groupBy("listed").count().collect()
    count = {r["listed"]: r["count"] for r in sizes}
    cascade = Cascade()
    if not count.get(True):
        return cascade
    inside = universe.filter("listed").select("h1", "h2")
    outside = universe.filter("NOT listed").select("h1", "h2")
    n_inside, rate = count[True], first_rate(count[True], count.get(False, 0))
    while True:
        level = _bloom(inside, n_inside, rate, len(cascade.levels) + 1)
        cascade.levels.append(level)
        passed = stage(outside.mapInArrow(_passing(level), "h1 long, h2 long"))
        n_passed = passed.count()
        if n_passed == 0:
            return cascade
        inside, outside, n_inside, rate = passed, inside, n_passed, 0.5


def _passing(level: Level):
    def keep(batches):
        for batch in batches:
            h1, h2 = (np.asarray(batch.column(i)) for i in (0, 1))
            yield batch.filter(pa.array(level.has(h1, h2)))

    return keep


def _lookup(spark, cascade: Cascade, shards: int, shard: int):
    """Column function: position of the first key that the shard lists, else 0."""
    sent = spark.sparkContext.broadcast(cascade)

    @F.arrow_udf("int")
    def first_listed(h1: pa.Array, h2: pa.Array) -> pa.Array:
        lengths = np.diff(np.asarray(h1.offsets))
        second = np.asarray(h2.flatten())
        hit = sent.value.has(np.asarray(h1.flatten()), second) & (second % shards == shard)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        best = np.zeros(len(lengths), dtype=np.int32)
        rows, firsts = np.unique(row[hit], return_index=True)
        best[rows] = place[hit][firsts]
        return pa.array(best)

    return first_listed


def judge_urls(
    urls: DataFrame, rules: DataFrame, *, url: str = "url", keep: list[str], default: str = "allow",
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """``keep`` columns plus host, path, rule and verdict of every row of ``urls``.

    ``rules`` has rule (host and path) and action (``allow`` or ``block``), one row per rule.
    Without a fitting rule the verdict is ``default``: the cascade has shown that no key of the
    URL is listed.
    """
    spark = urls.sparkSession
    listed = rules.filter(F.col("rule").isNotNull()).select(
        "rule", F.regexp_extract("rule", "^[^/]*", 0).alias("host"), (F.col("action") == "block").alias("blocked"))
    listed = listed.withColumn("path_size", F.length("rule") - F.length("host"))
    shape = listed.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set("path_size").alias("lengths"),  # distinct lengths, not rules
        F.count_distinct("rule").alias("n"),
    ).first()
    host, path = host_and_path(F.col(url))
    parts = urls.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    back = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    if not shape["n"]:
        return parts.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), shape["labels"], sorted(shape["lengths"]))
    asked = parts.select(F.explode(keys).alias("rule")).distinct()
    flags = listed.groupBy("rule").agg(F.min("blocked").alias("blocked"))
    h1, h2 = key_hashes(F.col("rule"))
    # listed keys outside the corpus are encoded too: the filter can then be kept for later corpora
    universe = stage(
        asked.join(flags, "rule", "full_outer").select(
            h1.alias("h1"), h2.alias("h2"), F.col("blocked").isNotNull().alias("listed"), "blocked"))
    n_all = universe.count()
    bits = shape["n"] * (1.44 * -math.log2(first_rate(shape["n"], n_all)) + 4.2)
    shards = max(1, math.ceil(bits / 8 / max_filter_bytes))
    out = parts.withColumn("keys", keys)
    out = out.withColumn("h1", F.transform("keys", lambda k: key_hashes(k)[0])).withColumn(
        "h2", F.transform("keys", lambda k: key_hashes(k)[1])).withColumn("best", F.lit(0))
    for shard in range(shards):
        own = universe.filter(F.pmod("h2", F.lit(shards)) == shard)
        found = _lookup(spark, build_cascade(own.select("h1", "h2", "listed")), shards, shard)
        out = out.withColumn("spot", found("h1", "h2")).withColumn(
            "best", F.when((F.col("best") == 0) | ((F.col("spot") > 0) & (F.col("spot") < F.col("best"))), F.col("spot"))
            .otherwise(F.col("best")))
    rule = F.when(F.col("best") > 0, F.get("keys", F.col("best") - 1))
    out = out.withColumn("rule", rule).withColumn("verdict", F.lit(None).cast("string"))
    for shard in range(shards):
        own = universe.filter((F.pmod("h2", F.lit(shards)) == shard) & F.col("listed"))
        found = _lookup(spark, build_cascade(own.select("h1", "h2", F.col("blocked").alias("listed"))), shards, shard)
        a, b = key_hashes(F.col("rule"))
        blocked = found(F.array(a), F.array(b)) > 0
        mine = F.pmod(b, F.lit(shards)) == shard
        out = out.withColumn("blocked", blocked).withColumn(
            "verdict", F.when(mine, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
            .otherwise(F.col("verdict")))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).otherwise(F.col("verdict"))
    return out.select(*back, "host", "path", "rule", verdict.alias("verdict"))

