"""Run ledger, target reports, source health and source status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.text import blank_to_null, collapse
from vakanz.functions.urls import host_of
from vakanz.operators.common import dedupe_first, latest_per_key, open_array, top_per_key


def run_ledger(outcomes: DataFrame, keys: Sequence[str], diagnostics: DataFrame | None = None) -> DataFrame:
    """One row per run: counters, run status, source status.

    ``outcomes`` has one row per discovered record with ``outcome`` created, updated, skipped,
    duplicate or error. ``diagnostics`` (one row per run) adds connector errors
    (``diagnostic_errors``) and ``prepared_only``.
    """

    def n(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    runs = outcomes.groupBy(*keys).agg(
        F.count("outcome").alias("discovered"),
        n("created", "updated", "skipped").alias("fetched"),
        n("created").alias("created"),
        n("updated").alias("updated"),
        n("skipped", "duplicate").alias("skipped"),
        n("error").alias("errors"),
    )
    if diagnostics is not None:
        runs = runs.join(diagnostics, list(keys), "left")
        runs = runs.withColumn("errors", F.col("errors") + F.coalesce("diagnostic_errors", F.lit(0)))
        prepared = F.coalesce("prepared_only", F.lit(False))
    else:
        prepared = F.lit(False)
    fine, partial = F.col("errors") == 0, (F.col("errors") > 0) & (F.col("fetched") > 0)
    runs = runs.withColumn(
        "status", F.when(fine, "succeeded").when(partial, "partial").otherwise("failed")
    )
    return runs.withColumn(
        "source_status",
        F.when(fine & prepared, "prepared")
        .when(partial, "limited")
        .when(fine, "healthy")
        .otherwise("error"),
    ).withColumn("counts_as_success", (fine | partial) & ~prepared)


def batch_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("runs"),
        *[F.sum(c).alias(c) for c in ("discovered", "fetched", "created", "updated", "skipped", "errors")],
    )


def run_errors(messages: DataFrame, keys: Sequence[str], at: str, text: str, keep: int = 5,
               maximum: int = 4000) -> DataFrame:
    """First ``keep`` error texts of a run joined into one message of at most ``maximum`` characters."""
    first = top_per_key(messages, keys, [F.col(at)], keep)
    listed = F.array_sort(F.collect_list(F.struct("position", collapse(F.col(text)).alias("m"))))
    joined = F.array_join(F.transform(listed, lambda x: x["m"]), " | ")
    return first.groupBy(*keys).agg(F.substring(joined, 1, maximum).alias("error_message"))


def count_with_recent(df: DataFrame, keys: Sequence[Column | str], created: str, since: Column) -> DataFrame:
    """Rows per group and how many of them are recent, in one aggregate."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("job_count"),
        F.count_if(F.col(created) >= since).alias("added_last_day"),
    )


def parse_targets(sources: DataFrame, source_key: str = "source_id", metadata: str = "metadata_json") -> DataFrame:
    """Configured targets of every source: strings or objects, label and kind filled in."""
    listed = F.from_json(F.get_json_object(metadata, "$.firecrawl.targets"), "array<string>")
    items = open_array(sources, [source_key], listed, "_item", "target_pos")
    plain = ~F.trim("_item").startswith("{")

    def part(*names: str) -> Column:
        return F.coalesce(
            *[blank_to_null(F.get_json_object("_item", f"$.{n}")) for n in names]
        )

    url = F.when(plain, blank_to_null(F.col("_item"))).otherwise(part("url"))
    kind = F.when(~plain, part("target_kind", "category"))
    return items.select(
        source_key,
        "target_pos",
        url.alias("target_url"),
        F.coalesce(F.when(~plain, part("label")), host_of(url), url).alias("target_label"),
        F.when(kind.isin("job_portal", "company_site"), kind).otherwise("company_site").alias("target_kind"),
    ).filter(F.col("target_url").isNotNull())


RESULTS = (
    "array<struct<target:string,status:string,error:string,records_emitted:bigint,"
    "documents_seen:bigint,pages_rejected:bigint,duplicates_skipped:bigint,query_filtered:bigint,"
    "page_error_count:bigint>>"
)
ERRORS = "array<struct<target:string,label:string,error:string>>"


def run_target_results(
    runs: DataFrame, targets: DataFrame, *, source_key: str = "source_id"
) -> DataFrame:
    """Target results of finished runs, read from their JSON details, for ``target_report``.

    A run that lists no targets but started all of them stands for every target of its source:
    failed where its errors name the target, completed elsewhere. Of these runs only the newest
    per source can decide anything, since it covers all targets. ``runs``: source, run_id,
    run_at, details.
    """

    def part(path: str) -> Column:
        return F.get_json_object("details", f"$.connector.{path}")

    read = runs.select(
        source_key,
        "run_id",
        "run_at",
        F.from_json(part("target_results"), RESULTS).alias("_results"),
        F.from_json(part("target_errors"), ERRORS).alias("_errors"),
        part("targets_started").try_cast("int").alias("_started"),
    )
    opened = open_array(read, [source_key, "run_id", "run_at"], F.col("_results"), "_r")
    own = opened.select(
        source_key, "run_id", "run_at", F.lit(False).alias("fallback"),
        F.trim("_r.target").alias("target_url"),
        *[F.col(f"_r.{c}").alias(c) for c in RESULT_COLUMNS],
    ).filter(F.coalesce(F.col("target_url"), F.lit("")) != "")

    counts = targets.groupBy(source_key).agg(F.count("*").alias("_targets"))
    whole = read.filter(F.coalesce(F.size("_results"), F.lit(0)) <= 0).join(counts, source_key)
    whole = whole.filter(F.col("_started") >= F.col("_targets"))
    newest = latest_per_key(whole, [source_key], ["run_id"])
    errors = F.coalesce("_errors", F.array().cast(ERRORS))
    hit = F.try_element_at(
        F.filter(
            errors,
            lambda e: e["target"].eqNullSafe(F.col("target_url"))
            | e["label"].eqNullSafe(F.col("target_label")),
        ),
        F.lit(1),
    )
    every = newest.join(targets, source_key).withColumn("_hit", hit)
    fallback = every.select(
        source_key, "run_id", "run_at", F.lit(True).alias("fallback"), "target_url",
        F.when(F.col("_hit").isNull(), "completed").otherwise("failed").alias("status"),
        F.col("_hit.error").alias("error"),
        *[F.lit(None).cast("bigint").alias(c) for c in RESULT_COLUMNS[2:]],
    )
    return own.unionByName(fallback)


RESULT_COLUMNS = (
    "status", "error", "records_emitted", "documents_seen", "pages_rejected",
    "duplicates_skipped", "query_filtered", "page_error_count",
)


def target_report(
    targets: DataFrame,
    postings: DataFrame,
    results: DataFrame,
    since: Column,
    *,
    source_key: str = "source_id",
    match_on: str = "label",
) -> DataFrame:
    """Latest result and stored postings of every configured target.

    ``targets``: source, target_url, target_label, target_kind. ``postings``: source,
    target_url, target_label, created_at. ``results``: source, run_id, run_at, target_url,
    status, error, counters of ``target_run_results``, and ``fallback`` (true for a run-wide
    result of a run that lists no targets; a target's own result always wins within a run).
    Counts by label win over counts by address; ``match_on='url'`` uses addresses only.
    """
    stored = count_with_recent(
        postings, [source_key, "target_label", "target_url"], "created_at", since
    )

    def totals(column: str, suffix: str) -> DataFrame:
        return (
            stored.filter(F.col(column).isNotNull())
            .groupBy(source_key, column)
            .agg(
                F.sum("job_count").alias(f"_jobs_{suffix}"),
                F.sum("added_last_day").alias(f"_added_{suffix}"),
            )
        )

    newest = dedupe_first(
        results,
        [source_key, "target_url"],
        [F.col("run_id").desc(), F.col("fallback").asc()],
    )
    report = targets.join(newest, [source_key, "target_url"], "left").join(
        totals("target_url", "url"), [source_key, "target_url"], "left"
    )
    jobs, added = [F.col("_jobs_url")], [F.col("_added_url")]
    if match_on == "label":
        report = report.join(totals("target_label", "label"), [source_key, "target_label"], "left")
        jobs.insert(0, F.col("_jobs_label"))
        added.insert(0, F.col("_added_label"))
    stored_count = F.coalesce(*jobs, F.lit(0))
    failed = F.col("error").isNotNull() | (F.coalesce("page_error_count", F.lit(0)) > 0)
    status = (
        F.when(failed & (F.col("status") == "completed"), "partial")
        .when(failed & F.col("status").isin("empty", "insufficient"), "failed")
        .otherwise(F.col("status"))
    )

    def count(name: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(name, F.lit(0))).alias(name)

    return report.select(
        source_key,
        "target_label",
        "target_url",
        "target_kind",
        F.col("run_at").alias("last_crawled_at"),
        F.coalesce("records_emitted", stored_count).alias("found_count"),
        stored_count.alias("stored_job_count"),
        F.coalesce(*added, F.lit(0)).alias("added_last_day"),
        status.alias("status"),
        count("documents_seen"),
        count("pages_rejected"),
        count("duplicates_skipped"),
        count("query_filtered"),
        count("page_error_count"),
    )


def crawler_state(
    sources: DataFrame, runs: DataFrame, now: Column, *, key: str = "source_id",
    stale: str = "3 HOURS", access: Column | None = None,
) -> DataFrame:
    """Operational state of every crawler source from its newest run.

    ``sources``: key, enabled, configured. ``runs``: key, run_id, status, started_at,
    finished_at, created_at.
    """
    newest = latest_per_key(runs, [key], ["run_id"]).select(
        key, "run_id", "status", "started_at", "finished_at", "created_at"
    )
    enabled = F.col("enabled") if access is None else F.col("enabled") & access
    old = F.col("started_at").isNull() | (F.col("started_at") < now - F.expr(f"INTERVAL {stale}"))
    state = (
        F.when(~enabled, "paused")
        .when(~F.col("configured"), "pending")
        .when(F.col("run_id").isNull(), "pending")
        .when(F.col("status") == "running", F.when(old, "error").otherwise("running"))
        .when(F.col("status") == "succeeded", "ready")
        .when(F.col("status") == "partial", "limited")
        .when(F.col("status") == "failed", "error")
        .otherwise("pending")
    )
    last = F.coalesce("finished_at", "started_at", "created_at")
    known = enabled & F.col("configured")
    return sources.join(newest, key, "left").select(
        key, "enabled", "configured", state.alias("state"),
        F.when(known, last).alias("last_run_at"),
    )


def source_counts(sources: DataFrame, postings: DataFrame, since: Column, key: str = "source_id") -> DataFrame:
    """Sources with their posting counts; a source without postings shows zero.

    Postings are aggregated before the join, so a source that holds a third of them still
    sends one row per map task.
    """
    counts = count_with_recent(postings, [key], "created_at", since)
    return sources.join(counts, key, "left").fillna(0, ["job_count", "added_last_day"])


def class_health(per_source: DataFrame, cls: str = "source_class") -> DataFrame:
    """One row per source class: active, running, worst state, counts, last fetch.

    ``per_source``: class, active, running, state, job_count, added_last_day, last_fetched_at.
    """
    rank = F.lit(-1)
    for state, place in fixed.STATE_RANK.items():
        rank = F.when(F.col("state") == state, place).otherwise(rank)
    return per_source.groupBy(cls).agg(
        F.bool_or("active").alias("active"),
        F.bool_or("running").alias("running"),
        F.max_by("state", rank).alias("state"),
        F.sum("job_count").alias("job_count"),
        F.sum("added_last_day").alias("added_last_day"),
        F.max("last_fetched_at").alias("last_fetched_at"),
    )


def source_status(df: DataFrame) -> DataFrame:
    """Display class of every source: prepared, paused, ready, limited, error, running, unchecked.

    Columns: enabled, permitted, config_missing, status, and ``state`` for crawlers (null for
    other sources).
    """
    on = F.col("enabled") & F.col("permitted") & ~F.col("config_missing")
    crawler = F.col("state").isNotNull()
    shown = (
        F.when(F.col("config_missing"), "prepared")
        .when(~on, "paused")
        .when(crawler & F.col("state").isin("running", "ready", "limited", "error"), F.col("state"))
        .when(crawler, "unchecked")
        .when(F.lower("status").isin("error", "failed", "unhealthy"), "error")
        .otherwise("active")
    )
    active = F.when(crawler, F.col("state").isin("ready", "running")).otherwise(on)
    return df.withColumn("shown_status", shown).withColumn("active", active)


def status_totals(shown: DataFrame, by: str) -> DataFrame:
    """Sources and active sources of every class, from the output of ``source_status``."""
    return shown.groupBy(by).agg(F.count("*").alias("sources"), F.count_if("active").alias("active"))


def recent_rows(df: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """Newest rows first, rows without a time last; a top-k."""
    return df.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc()).limit(limit)


def overwide_queries(results: DataFrame, query: str, window: int = 10_000) -> DataFrame:
    """Queries whose result set is larger than the provider's window."""
    return results.groupBy(query).agg(F.count("*").alias("results")).filter(F.col("results") > window)
