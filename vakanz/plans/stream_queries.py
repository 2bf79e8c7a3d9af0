"""Streams over the event files, each with the batch result it must end in.

A stream reads the given file with ``availableNow`` and writes its result as parquet from
``foreachBatch`` into the cluster's shared scratch folder; nothing passes through the driver.
Times leave as Unix microseconds, so they do not depend on the session's zone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanz.plans.registry import query
from vakanz.plans.source_queries import payloads
from vakanz.plans.views import table
from vakanz.session import ensure_checkpoint_dir
from vakanz.sources import landing
from vakanz.sources.tables import VersionedTable
from vakanz.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Event stream with its time as an instant in UTC, whatever the session's zone."""
    rows = jobs.read_landing(spark, d, EVENTS, glob="events.parquet")
    return rows.withColumn("at", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))


def events_in_batches(spark: SparkSession, d: str, batches: int = 5) -> DataFrame:
    """The same stream from several files of mixed times: every micro-batch brings late rows."""
    folder = f"{scratch(spark)}/events"
    table(spark, d, "events").repartition(batches).write.parquet(folder)
    rows = jobs.read_landing(spark, folder, EVENTS, files_per_batch=1)
    return rows.withColumn("at", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))


def final_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end and read the result: the last table of ``complete``, all rows else; those of
    ``update`` with their ``batch_id``."""
    spark = stream.sparkSession
    root = scratch(spark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{root}/out/part={batch_id}"
        )

    started = jobs.run_once(stream, sink, f"{root}/checkpoint", mode)
    started.awaitTermination()
    result = spark.read.parquet(f"{root}/out").drop("part")
    if mode == "complete":
        last = result.agg(F.max("batch_id")).scalar()
        result = result.filter(F.col("batch_id") == last)
    return result if mode == "update" else result.drop("batch_id")


@query(
    "stream_daily_counts",
    "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_daily_counts(spark, d):
    counts = jobs.windowed_counts(events(spark, d), "at", "event_type")
    counts = counts.select(F.unix_micros("window_start").alias("day_us"), "event_type", "n")
    return final_table(counts, "complete")


@query(
    "stream_sliding_counts",
    """WITH s AS (SELECT epoch_us(date_trunc('hour', ts)) - h * 3600000000 AS start_us, event_type FROM events, range(24) r(h))
       SELECT start_us, event_type, count(*) AS n FROM s GROUP BY 1, 2""",
)
def stream_sliding_counts(spark, d):
    counts = jobs.windowed_counts(events(spark, d), "at", "event_type", "1 day", "1 hour")
    counts = counts.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")
    return final_table(counts, "complete")


@query(
    "stream_latest_decision",
    """SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
       FROM events WHERE event_type IN ('signup', 'error')) WHERE rn = 1""",
)
def stream_latest_decision(spark, d):
    """Each micro-batch writes the keys it changes; a key's value is that of the last batch that wrote it."""
    kept = events_in_batches(spark, d).filter(F.col("event_type").isin("signup", "error"))
    found = final_table(jobs.latest_by_key(kept, "user_id", "at", "event_id", "event_type"), "update")
    return found.groupBy("user_id").agg(F.max_by("event_type", "batch_id").alias("event_type"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    """Several micro-batches of mixed times, none of them later than the bound."""
    kept = jobs.dedupe_stream(events_in_batches(spark, d), ["user_id", "event_type"], "at", "400 days")
    return final_table(kept.select("user_id", "event_type"), "append")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
       SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def stream_sessions(spark, d):
    parts = final_table(jobs.partial_sessions(events(spark, d), "at", "user_id"), "complete")
    return jobs.merge_sessions(parts, "user_id").select(
        "user_id", F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("session_end").alias("end_us"), "n",
    )


@query(
    "stream_failure_counter",
    """WITH r AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY user_id)
       SELECT e.user_id AS key, count(*) FILTER (WHERE event_type = 'error' AND (r.last IS NULL OR ts > r.last)) AS failures
       FROM events e JOIN r ON r.user_id = e.user_id GROUP BY e.user_id""",
)
def stream_failure_counter(spark, d):
    rows = events_in_batches(spark, d).select(
        F.col("user_id").alias("key"), "at", F.col("event_id").alias("tie"),
        (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("success"),
    )
    root = scratch(spark)
    store = jobs.KeyedRows(spark, f"{root}/state", "key long, at timestamp, tie long, failed boolean, success boolean")
    jobs.keep_rows(rows, store, f"{root}/checkpoint", jobs.open_failures).awaitTermination()
    return jobs.failure_counts(store.read())


@query(
    "stream_changes",
    """SELECT user_id AS key, event_type AS value, epoch_us(ts) AS at_us FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
       WHERE old IS DISTINCT FROM event_type""",
)
def stream_changes(spark, d):
    """A late row changes its own pair and the next one; both are computed anew with its bucket."""
    rows = events_in_batches(spark, d).select(
        F.col("user_id").alias("key"), "at", F.col("event_id").alias("tie"), F.col("event_type").alias("value"))
    root, schema = scratch(spark), "key long, at timestamp, tie long, value string"
    store, out = jobs.KeyedRows(spark, f"{root}/state", schema), jobs.KeyedRows(spark, f"{root}/out", schema)
    jobs.keep_rows(rows, store, f"{root}/checkpoint", derive=jobs.changes_in, derived=out).awaitTermination()
    return out.read().select("key", "value", F.unix_micros("at").alias("at_us"))


@query(
    "stream_stuck_runs",
    "SELECT user_id AS run_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' ELSE 'error' END AS state FROM events GROUP BY user_id",
)
def stream_stuck_runs(spark, d):
    """Final state of every run: an end was seen, or event time has passed its limit."""
    found = jobs.run_states(events_in_batches(spark, d), "user_id", "at", F.col("event_type") == "purchase")
    history = final_table(found, "update")
    newest = F.max_by(F.struct("start", "last", "finished"), "batch_id").alias("s")
    return jobs.stuck_runs(history.groupBy("run_id").agg(newest).select("run_id", "s.*"))


def page_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every page as one landed page of two items; of some the second can't be worked from here."""
    page = F.col("page_id")

    def item(ident, title, place, text):
        return F.struct(ident.cast("string").alias("id"), title.alias("title"),
                        place.alias("candidate_required_location"), text.alias("description"), F.col("url").alias("url"))

    items = F.array(
        item(page, F.concat(F.lit("Page "), page.cast("string")), F.lit("Germany"), F.col("html")),
        item(-page - 1, F.when(page % 4 != 0, "second"), F.when(page % 6 == 1, "USA only").otherwise("Worldwide"),
             F.lit(None).cast("string")))
    whole = F.to_json(F.struct(items.alias("jobs")))
    cut = F.when(page % 7 == 0, F.expr("substring(whole, 1, length(whole) - 2)")).otherwise(F.col("whole"))
    return table(spark, d, "pages").withColumn("whole", whole).select("page_id", cut.alias("payload"))


@query(
    "stream_ingest",
    """WITH d AS (SELECT doc_id AS id, doc_id % 5 AS form, doc_id % 4 = 0 AS bare FROM documents)
       SELECT 'lever' AS source, CAST(id AS VARCHAR) AS landed_id, CASE form WHEN 2 THEN 'no list' ELSE 'unreadable' END AS outcome FROM d WHERE form IN (1, 2, 3)
       UNION ALL SELECT 'lever', CAST(id AS VARCHAR), 'posting' FROM d WHERE form NOT IN (1, 2, 3)
       UNION ALL SELECT 'lever', CASE WHEN bare THEN CAST(id AS VARCHAR) ELSE CAST(-id - 1 AS VARCHAR) END, CASE WHEN bare THEN 'invalid' ELSE 'posting' END FROM d WHERE form NOT IN (1, 2, 3)
       UNION ALL SELECT 'remotive', CAST(page_id AS VARCHAR), CASE WHEN page_id % 7 = 0 THEN 'unreadable' ELSE 'posting' END FROM pages
       UNION ALL SELECT 'remotive', CASE WHEN page_id % 6 = 1 OR page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) ELSE CAST(-page_id - 1 AS VARCHAR) END,
         CASE WHEN page_id % 6 = 1 THEN 'filtered' WHEN page_id % 4 = 0 THEN 'invalid' ELSE 'posting' END FROM pages WHERE page_id % 7 <> 0""",
)
def stream_ingest(spark, d):
    """Two providers into one table: files land twice, each time the streams start again and take two batches."""
    root = scratch(spark)
    form = F.col("doc_id") % 5
    documents = payloads(spark, d).withColumn(
        "payload", F.when(form == 1, F.expr("substring(payload, 1, length(payload) - 3)"))
        .when(form == 2, F.concat(F.lit('{"error":'), F.to_json(F.struct("doc_id")), F.lit("}")))
        .when(form != 3, F.col("payload")))
    store = VersionedTable(spark, f"{root}/postings")
    now = F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'")
    for half in (0, 1):
        for rows, key, provider in ((documents, "doc_id", "lever"), (page_payloads(spark, d), "page_id", "remotive")):
            folder = f"{root}/in-{provider}"
            rows.filter(F.pmod(F.xxhash64(key), F.lit(2)) == half).write.mode("append").parquet(folder)
            files = len(spark.read.parquet(folder).inputFiles()) // (half + 1)
            stream = jobs.read_landing(spark, folder, f"{key} long, payload string", files_per_batch=-(-files // 2))
            jobs.continuous_ingest(
                stream, landing.SPECS[provider], store, f"{root}/snapshots", f"{root}/checkpoint-{provider}", now,
            ).awaitTermination()
    kept = store.read().select("source", F.col("external_id").alias("landed_id"), F.lit("posting").alias("outcome"))
    ids = F.from_json("landed", "doc_id string, page_id string")
    lost = spark.read.parquet(f"{root}/postings-rejected").select(
        "source", F.coalesce(ids["doc_id"], ids["page_id"]).alias("landed_id"), F.col("reason").alias("outcome"))
    return kept.unionByName(lost)
