"""Availability, stale checks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.text import collapse, contains_any, fold, let, unescape
from vakanz.operators.common import dedupe_first


def apply_availability(
    postings: DataFrame,
    checks: DataFrame,
    now: Column,
    *,
    key: str = "job_id",
    max_age: str = "6 HOURS",
    force: bool = False,
) -> DataFrame:
    """New availability state of every posting, given what the checks found.

    A passed expiry date makes a posting inactive without a check. A result younger than
    ``max_age`` is reused unless ``force``. ACTIVE and INACTIVE reset the failure counter and
    set ``is_active``; CHECK_FAILED only counts. A posting without a check keeps its state.
    ``checks``: key, check_status, check_method, check_reason.
    """
    fresh_from = now - F.expr(f"INTERVAL {max_age}")
    expired = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    fresh = F.coalesce(F.col("availability_checked_at") >= fresh_from, F.lit(False))
    reuse = ~expired & fresh & F.lit(not force)
    checked = F.col("check_status").isNotNull()
    acts = expired | (~reuse & checked)
    status = F.when(expired, "inactive").otherwise(F.col("check_status"))
    result = (
        F.when(~acts, F.when(reuse, "cached").otherwise("unchecked"))
        .when(expired, "expired")
        .otherwise("checked")
    )
    joined = postings.join(checks, key, "left").withColumn("transition", result)
    decided = acts & status.isin("active", "inactive")

    def settle(name: str, new: Column) -> Column:
        return F.when(acts, new).otherwise(F.col(name)).alias(name)

    changed = {
        "availability_status": settle("availability_status", status),
        "availability_checked_at": settle("availability_checked_at", now),
        "availability_check_method": settle(
            "availability_check_method",
            F.when(expired, "published_expiry").otherwise(F.col("check_method")),
        ),
        "availability_reason": settle(
            "availability_reason",
            F.when(expired, "published_expiry_passed").otherwise(F.col("check_reason")),
        ),
        "is_active": F.when(decided, status == "active").otherwise(F.col("is_active")).alias("is_active"),
        "availability_failures": F.when(decided, 0)
        .when(acts, F.col("availability_failures") + 1)
        .otherwise(F.col("availability_failures"))
        .alias("availability_failures"),
    }
    kept = [changed.get(c, F.col(c)) for c in postings.columns]
    return joined.select(*kept, "transition", F.col("is_active").alias("was_active"))


def page_verdict(title: Column, html: Column) -> tuple[Column, Column]:
    """Status and reason of a landed page: closed phrase, posting markup, title, or unknown."""

    def seen(page: Column) -> Column:
        """Class of a page from its text, its markup and the title looked for."""
        visible, name = page["visible"], page["name"]
        named = (F.length(name) >= 8) & F.contains(visible, name)
        return (
            F.when(contains_any(visible, fixed.CLOSED_MARKERS), "closed_page_marker")
            .when(page["marked"], "jobposting_structured_data")
            .when(named, "job_title_present")
            .otherwise("job_content_not_recognized")
        )

    def read(compact: Column) -> Column:
        return F.struct(
            collapse(unescape(F.regexp_replace(compact, "<[^>]+>", " "))).alias("visible"),
            fold(collapse(unescape(title))).alias("name"),
            compact.rlike(r"""["']@type["']\s*:\s*["']jobposting["']""").alias("marked"),
        )

    why = let(let(fold(collapse(html)), read), seen)
    status = let(
        why,
        lambda w: F.when(w == "closed_page_marker", "inactive")
        .when(w == "job_content_not_recognized", "check_failed")
        .otherwise("active"),
    )
    return status, why


def availability_split(status: Column, access: Column, allow_unverified: bool = False) -> Column:
    """``eligible``, ``inactive`` or ``unverified``; without access nothing can be verified."""
    failed = "unverified_allowed" if allow_unverified else "unverified"
    return (
        F.when(~access, failed)
        .when(status == "inactive", "inactive")
        .when(status == "check_failed", failed)
        .otherwise("eligible")
    )


def check_candidates(
    postings: DataFrame, now: Column, *, stale_days: int = 30, limit: int = 50,
    key: str = "job_id",
) -> DataFrame:
    """Next postings to check: planned, saved, new, others; then the longest unseen.

    Planned as a top-k over all postings that are due.
    """
    cutoff = now - F.expr(f"INTERVAL {max(1, stale_days)} DAYS")
    stale = postings.filter(F.col("last_seen_at") <= cutoff)
    status = F.coalesce(F.col("status"), F.lit(fixed.NEW))
    rank = F.lit(3)
    for name, place in fixed.CHECK_PRIORITY.items():
        rank = F.when(status == name, place).otherwise(rank)
    ranked = stale.withColumn("check_priority", rank)
    return ranked.orderBy("check_priority", "last_seen_at", key).limit(limit)


def maintenance_counts(updated: DataFrame) -> DataFrame:
    """Checked, inactivated, reactivated and failed, from the output of ``apply_availability``."""
    acted = F.col("transition").isin("checked", "expired")
    status = F.col("availability_status")
    return updated.agg(
        F.count_if(acted).alias("jobs_checked"),
        F.count_if(acted & F.col("was_active") & (status == "inactive")).alias("jobs_inactivated"),
        F.count_if(acted & ~F.col("was_active") & (status == "active")).alias("jobs_reactivated"),
        F.count_if(acted & (status == "check_failed")).alias("checks_failed"),
    )


def retention(
    snapshots: DataFrame, now: Column, *, days: int = 90, raw: str = "raw", at: str = "fetched_at",
    batch: int | None = None, key: str = "snapshot_id",
) -> DataFrame:
    """Drop the raw text of snapshots older than ``days``; 0 keeps everything.

    Without ``batch`` this is one projection; store snapshots by day so that only old
    partitions are rewritten. ``batch`` clears the oldest ``batch`` rows only.
    """
    if days <= 0:
        return snapshots
    cutoff = now - F.expr(f"INTERVAL {days} DAYS")
    due = (F.col(at) < cutoff) & F.col(raw).isNotNull()
    if batch is None:
        return snapshots.withColumn(raw, F.when(~due, F.col(raw)))
    oldest = snapshots.filter(due).orderBy(at, key).limit(batch).select(
        key, F.lit(True).alias("_clear")
    )
    marked = snapshots.join(oldest, key, "left")
    return marked.withColumn(raw, F.when(F.col("_clear").isNull(), F.col(raw))).drop("_clear")


def failures_since_reset(events: DataFrame, key: str, at: str, failed: Column, reset: Column) -> DataFrame:
    """Failures after the last success per posting, as two aggregates instead of a long scan."""
    marked = events.select(key, at, failed.alias("_failed"), reset.alias("_reset"))
    last = marked.groupBy(key).agg(F.max(F.when(F.col("_reset"), F.col(at))).alias("_last"))
    joined = marked.join(last, key)
    after = F.col("_last").isNull() | (F.col(at) > F.col("_last"))
    return joined.groupBy(key).agg(F.count_if(F.col("_failed") & after).alias("failures"))


def original_text(postings: DataFrame, snapshots: DataFrame, key: str = "job_id") -> DataFrame:
    """Text of the newest kept envelope, else the cleaned text of the posting."""
    from vakanz.functions.text import visible_text

    newest = dedupe_first(
        snapshots.select(key, "fetched_at", "snapshot_id", "raw"),
        [key],
        [F.col("fetched_at").desc(), F.col("snapshot_id").desc()],
    ).select(key, "raw")
    told = F.get_json_object("raw", "$.description")
    kind = F.get_json_object("raw", "$.description_format")
    shown = F.when(F.trim(told) != "", visible_text(told, kind))
    return postings.join(newest, key, "left").withColumn(
        "original_text", F.coalesce(shown, F.col("description_text"))
    )
