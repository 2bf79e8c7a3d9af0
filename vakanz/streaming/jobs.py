"""The polling loops as Structured Streaming jobs.

Aggregates are written in ``complete`` or ``update`` mode or through ``foreachBatch``: append
mode would hold back everything the watermark has not passed. Every job names a checkpoint
folder, so a stopped query goes on where it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vakanz.operators.common import lag_by_bucket, time_bucket
from vakanz.sources.landing import Spec, left_out, normalize_payload, to_posting
from vakanz.sources.tables import ConcurrentCommit, VersionedTable, apply_upsert, path_exists


def read_landing(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files that arrive in a landing folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
             mode: str = "append") -> StreamingQuery:
    """Process what has arrived and stop; the same query without ``availableNow`` goes on."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def continuous_ingest(
    stream: DataFrame, spec: Spec, postings: VersionedTable, snapshots_path: str, checkpoint: str,
    now: Column, payload: str = "payload", compact_after: int = 50, rejected_path: str | None = None,
) -> StreamingQuery:
    """Landing stream to versioned postings: normalize, then one upsert per micro-batch.

    What gives no posting (:func:`landing.left_out`) is written with the provider and the batch's note,
    before the postings become visible, to ``rejected_path``, else to a folder named like the postings
    with ``-rejected`` behind it. A batch has its own folder there, so a repeated one replaces its rows.

    Several streams may write one table: a batch is known by its stream (its checkpoint folder),
    its provider and its number. After ``compact_after`` deltas the table is rewritten, unless
    another stream commits meanwhile; then a later batch does it.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        note = f"{checkpoint} {spec.provider} {batch_id}"
        valid, _ = normalize_payload(batch, spec, payload)
        lost = left_out(batch, spec, payload).select(
            F.lit(spec.provider).alias("source"), F.lit(note).alias("note"), "*")
        folder = f"batch=b{hashlib.sha256(note.encode()).hexdigest()[:32]}"
        lost.write.mode("overwrite").parquet(f"{rejected_path or postings.root + '-rejected'}/{folder}")
        apply_upsert(
            postings, snapshots_path, to_posting(valid), keys=["source", "external_id"],
            hash_cols=HASHED, now=now, text_col="description_text", note=note,
        )
        if len(postings.visible()) > compact_after:
            with suppress(ConcurrentCommit):
                postings.compact()

    return run_once(stream, sink, checkpoint)


HASHED = (
    "title", "employer", "description_text", "location_text", "remote_type", "employment_type",
    "contract_type", "published_at", "structured_data",
)


def with_lateness(stream: DataFrame, at: str, delay: str = "24 hours") -> DataFrame:
    """The overlap of an incremental read as a watermark delay."""
    return stream.withWatermark(at, delay)


SALTS = 16  # parts of a key before its parts meet


def _part_of_key(at: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(at), F.lit(salts))


def dedupe_stream(stream: DataFrame, keys: list[str], at: str, delay: str = "24 hours", salts: int = SALTS) -> DataFrame:
    """One row per key within the lateness bound; state is dropped behind it.

    Rows of a key are first reduced in ``salts`` parts, so the state of a key that holds a third of all
    rows is spread over tasks; the second step meets at most one row per part.
    """
    parts = with_lateness(stream, at, delay).withColumn("_part", _part_of_key(at, salts))
    first = parts.dropDuplicatesWithinWatermark([*keys, "_part"])
    return first.dropDuplicatesWithinWatermark(keys).drop("_part")


def windowed_counts(stream: DataFrame, at: str, by: str, length: str = "1 day", slide: str | None = None,
                    delay: str = "24 hours") -> DataFrame:
    """Added-in-window counters, tumbling or sliding."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return (
        with_lateness(stream, at, delay)
        .groupBy(window.alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), by, "n")
    )


def latest_by_key(stream: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Latest value per key in update mode."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def partial_sessions(
    stream: DataFrame, at: str, key: str, gap: str = "6 hours", delay: str = "24 hours", salts: int = SALTS
) -> DataFrame:
    """Bursts of activity of a part of one source's rows, closed by a gap: key, session_start, session_end, n.

    A source's rows are dealt to ``salts`` parts by time, so the sessions of a hot source are state of
    many tasks. :func:`merge_sessions` joins the parts.
    """
    return (
        with_lateness(stream, at, delay)
        .groupBy(F.session_window(at, gap).alias("w"), key, _part_of_key(at, salts).alias("part"))
        .agg(F.count("*").alias("n"))
        .select(
            key,
            F.col("w.start").alias("session_start"),
            F.col("w.end").alias("session_end"),
            "n",
        )
    )


def merge_sessions(parts: DataFrame, key: str) -> DataFrame:
    """Sessions of a source from those of its parts: overlapping stretches are one session.

    A part covers every moment from its first row to one gap behind its last, so parts overlap just
    where their rows are within a gap of each other.
    """
    length = (F.unix_micros("session_end") - F.unix_micros("session_start")) / F.lit(1_000_000)
    stretch = F.session_window("session_start", F.make_interval(secs=length.cast("decimal(18,6)")))
    merged = parts.groupBy(stretch.alias("w"), key).agg(F.sum("n").alias("n"))
    return merged.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class KeyedRows:
    """Rows by key in Parquet, one folder per hash bucket of the key.

    A micro-batch reads and rewrites the buckets its keys fall into, by Spark's dynamic partition
    overwrite. Rows are known by (key, at, tie), so a batch that is repeated after a failure, also one
    that had replaced some buckets, gives the same rows again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.schema = schema
        self.bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Bucket numbers of a batch, at most ``buckets``."""
        return [r.b for r in batch.select(self.bucket.alias("b")).distinct().collect()]

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        if not path_exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.root)
        return (rows if numbers is None else rows.filter(F.col("bucket").isin(numbers))).drop("bucket")

    def replace(self, rows: DataFrame) -> None:
        """Write whole buckets; the others stay.

        Rows are rebalanced by bucket, or every task would write a file into every bucket; a bucket that holds
        much more than the others, because of a hot key, is split into several tasks and files.
        """
        dealt = rows.withColumn("bucket", self.bucket).hint("rebalance", F.col("bucket"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)


def keep_rows(
    stream: DataFrame, store: KeyedRows, checkpoint: str, keep: Callable[[DataFrame], DataFrame] | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None, derived: KeyedRows | None = None,
) -> StreamingQuery:
    """Keep the rows a keyed result depends on, over micro-batches, however late rows come.

    ``keep`` drops rows that no later row can need; ``derive`` computes the result of the touched
    buckets anew from the rows in them, which replaces their part of ``derived``.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        numbers = store.touched(batch)
        if not numbers:
            return
        rows = store.read(numbers).unionByName(batch).dropDuplicates(["key", "at", "tie"])
        store.replace(keep(rows) if keep else rows)
        if derive and derived:
            derived.replace(derive(store.read(numbers)))

    return run_once(stream, sink, checkpoint)


def open_failures(rows: DataFrame) -> DataFrame:
    """Rows that failure counters need: failures after the last success, that success, the newest row.

    ``rows``: key, at, tie, failed, success. A late success drops the failures before it, a late failure
    counts if it is after the last success.
    """
    spot = F.struct("at", "tie")
    ends = rows.groupBy("key").agg(
        F.max(F.when(F.col("success"), F.col("at"))).alias("_last"), F.max(spot).alias("_newest"))
    joined = rows.join(ends, "key")
    after = F.col("_last").isNull() | (F.col("at") > F.col("_last"))
    needed = (F.col("failed") & after) | (F.col("success") & (F.col("at") == F.col("_last"))) | (spot == F.col("_newest"))
    return joined.filter(needed).select(*rows.columns)


def failure_counts(rows: DataFrame) -> DataFrame:
    """Failures since the last success per key."""
    last = rows.groupBy("key").agg(F.max(F.when(F.col("success"), F.col("at"))).alias("_last"))
    after = F.col("_last").isNull() | (F.col("at") > F.col("_last"))
    return rows.join(last, "key").groupBy("key").agg(F.count_if(F.col("failed") & after).alias("failures"))


def changes_in(rows: DataFrame) -> DataFrame:
    """Rows whose value differs from the one before of their key: key, at, tie, value.

    The value before comes from hourly windows, so no key is sorted in one task. A first row counts
    unless its value is null.
    """
    lagged = lag_by_bucket(rows, ["key"], ["at", "tie"], time_bucket("at"), {"value": "previous"})
    return lagged.filter(~F.col("previous").eqNullSafe(F.col("value"))).select("key", "at", "tie", "value")


def run_states(stream: DataFrame, run: str, at: str, finished: Column) -> DataFrame:
    """run_id, start, last, finished: what is known of every run, as a plain streaming aggregate.

    Rows are summed before the shuffle, so a run with a third of all rows is one partial row a task.
    """
    return stream.groupBy(F.col(run).alias("run_id")).agg(
        F.min(at).alias("start"), F.max(at).alias("last"), F.bool_or(finished).alias("finished"))


def stuck_runs(states: DataFrame, limit: str = "3 hours", delay: str = "10 minutes") -> DataFrame:
    """run_id and state (finished, running, error) of a table of :func:`run_states`.

    A run without an end is an error once event time, less ``delay`` for late rows, has passed its start
    by ``limit``; an end that comes later still makes it finished.
    """
    newest = states.agg(F.max("last").alias("newest"))
    passed = F.col("newest") - F.expr(f"INTERVAL {delay}") >= F.col("start") + F.expr(f"INTERVAL {limit}")
    state = F.when(F.col("finished"), "finished").when(passed, "error").otherwise("running")
    return states.withColumn("newest", newest.scalar()).select("run_id", state.alias("state"))
