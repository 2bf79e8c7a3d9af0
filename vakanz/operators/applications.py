"""Application status history, board, drafts and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.operators.common import lag_by_bucket, latest_per_key, open_array, time_bucket
from vakanz.operators.profiles import Limits, first_of, head_of


def valid_status(status: Column) -> Column:
    return status.isin(*fixed.STATUSES)


def application_state(log: DataFrame, key: str = "job_id", newest: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Current status per posting from a log of status changes."""
    kept = log.filter(valid_status(F.col("status")))
    return latest_per_key(kept, [key], newest).select(key, "status", F.col(newest[0]).alias("updated_at"))


def status_first_times(log: DataFrame, key: str = "job_id", at: str = "ts") -> DataFrame:
    """First time each dated status was reached, one column per status."""
    columns = [
        F.min(F.when(F.col("status") == status, F.col(at))).alias(name)
        for status, name in fixed.STATUS_TIME_COLUMNS.items()
    ]
    return log.groupBy(key).agg(*columns)


def feedback_from_status(log: DataFrame, key: str = "job_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Feedback rows: a change to saved or not suitable; a repeated status gives none.

    A posting starts as new, so its first saved or rejected entry counts.
    """
    rows = lag_by_bucket(
        log.filter(valid_status(F.col("status"))), [key], order,
        time_bucket(order[0]), {"status": "old_status"},
    )
    changed = ~F.coalesce("old_status", F.lit(fixed.NEW)).eqNullSafe(F.col("status"))
    kept = rows.filter(changed & F.col("status").isin(fixed.SAVED, fixed.NOT_SUITABLE))
    return kept.select(
        key,
        *order,
        F.lit("application_status").alias("event_type"),
        F.col("status").alias("value"),
        F.when(F.col("status") == fixed.SAVED, 1).otherwise(-1).alias("direction"),
    )


def rescore_needed(events: DataFrame, last_rescore: Column, at: str = "ts") -> DataFrame:
    """Whether a decision arrived after the last rescore, and how many."""
    supported = (F.col("event_type") == "application_status") & F.col("value").isin(
        fixed.SAVED, fixed.NOT_SUITABLE
    )
    new = F.count_if(supported & (F.col(at) > last_rescore))
    return events.agg(new.alias("new_decisions"), (new > 0).alias("rescore_needed"))


def pipeline_board(records: DataFrame, spark_statuses: DataFrame | None = None) -> DataFrame:
    """Records with the place of their column; a status without records appears once, empty.

    One row per record instead of one list per status: a status may hold any number of
    records. Only the distinct statuses (at most eight) are shuffled.
    """
    place = F.lit(None).cast("int")
    for i, status in enumerate(fixed.STATUSES):
        place = F.when(F.col("status") == status, i).otherwise(place)
    shown = records.withColumn("board_pos", place).filter(F.col("board_pos").isNotNull())
    spark = records.sparkSession
    every = spark.createDataFrame(list(enumerate(fixed.STATUSES)), "board_pos int, status string")
    used = shown.select("status").distinct()
    empty = every.join(used, "status", "left_anti")
    return shown.unionByName(empty, allowMissingColumns=True)


def revision_numbers(existing: DataFrame, drafts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Next revision numbers of new drafts: highest stored number plus the place in the batch.

    Numbers inside a posting are counted per hour first and shifted by the hours before, so one
    posting's drafts are not sorted in one task.
    """
    highest = existing.groupBy(key).agg(F.max("revision").alias("_highest"))
    slot = time_bucket(order[0])
    numbered = drafts.withColumn("_slot", slot).withColumn(
        "_in_slot", F.row_number().over(Window.partitionBy(key, "_slot").orderBy(*order))
    )
    slots = drafts.withColumn("_slot", slot).groupBy(key, "_slot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(key, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(slots, [key, "_slot"]).join(highest, key, "left")
    number = F.coalesce("_highest", F.lit(0)) + F.col("_before") + F.col("_in_slot")
    return joined.withColumn("revision", number.cast("bigint")).drop(
        "_slot", "_in_slot", "_before", "_highest"
    )


def promote_planned(records: DataFrame, drafted: DataFrame, now: Column, key: str = "job_id") -> DataFrame:
    """A drafted posting that is new or saved becomes planned; its time is set once.

    A drafted posting without a record gets one.
    """
    marks = drafted.select(key).distinct().withColumn("_drafted", F.lit(True))
    joined = records.join(marks, key, "full_outer")
    missing = F.col("status").isNull()
    moves = F.col("_drafted").isNotNull() & (missing | F.col("status").isin(fixed.NEW, fixed.SAVED))
    return joined.select(
        *[c for c in records.columns if c not in ("status", "planned_at")],
        F.when(moves, fixed.PLANNED).otherwise(F.col("status")).alias("status"),
        F.when(moves, F.coalesce("planned_at", now)).otherwise(F.col("planned_at")).alias("planned_at"),
    )


# --- checks of externally produced rows ----------------------------------------------------


def batch_completeness(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, unknown or repeated in a returned batch."""
    counts = returned.groupBy(key).agg(F.count("*").alias("returned"))
    asked = requested.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = asked.join(counts, key, "full_outer")
    problem = (
        F.when(F.col("_asked").isNull(), "unknown")
        .when(F.col("returned").isNull(), "missing")
        .when(F.col("returned") > 1, "repeated")
    )
    return joined.select(key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def evidence_subset(claimed: Column, allowed: Column) -> Column:
    """All claimed evidence ids are allowed, and there is at least one."""
    return (F.size(claimed) > 0) & (F.size(F.array_except(claimed, allowed)) == 0)


def violations(
    df: DataFrame,
    key: str,
    *,
    required: Sequence[str] = (),
    allowed: Mapping[str, Sequence[str]] | None = None,
    bounds: Mapping[str, tuple[float, float]] | None = None,
    sizes: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """One row per broken rule: blank text, unknown category, number or list size out of range."""
    checks = [(F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), f"{c}:blank") for c in required]
    for c, values in (allowed or {}).items():
        checks.append((~F.coalesce(F.col(c).isin(*values), F.lit(False)), f"{c}:category"))
    for c, (low, high) in (bounds or {}).items():
        checks.append((~F.coalesce(F.col(c).between(low, high), F.lit(False)), f"{c}:range"))
    for c, (low, high) in (sizes or {}).items():
        checks.append((~F.coalesce(F.size(c).between(low, high), F.lit(False)), f"{c}:size"))
    found = F.filter(
        F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), lambda v: v.isNotNull()
    )
    return open_array(df, [key], found, "violation")


def bounded(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("double"), F.lit(low))))


def review_status(decision: Column, scores: Column, must_fix: Column, unsupported: Column) -> Column:
    """A draft is reviewed when approved, every score is 4 or more, and nothing is open."""
    passed = F.lit(True)
    for name in ("relevance", "evidence", "clarity", "motivation"):
        passed = passed & (F.coalesce(scores[name], F.lit(0)) >= 4)
    good = (decision == "approve") & passed & (F.size(must_fix) == 0) & (F.size(unsupported) == 0)
    return F.when(good, "reviewed").otherwise("needs_revision")


FACT_SCHEMA = (
    "struct<current_title:string,experience_years:string,skills:array<string>,"
    "education:array<string>,certifications:array<string>,languages:array<string>,"
    "work_experience:array<struct<period:string,role:string,employer:string,"
    "responsibilities:array<string>>>>"
)


def profile_facts(profiles: DataFrame, key: str, data: str, limits: Limits = Limits()) -> DataFrame:
    """Flatten a nested profile into (evidence_id, category, value) rows, within ``limits``."""
    p = profiles.select(key, F.from_json(data, FACT_SCHEMA).alias("d"))

    def scalar(name: str) -> Column:
        return F.array(
            F.struct(
                F.lit(f"profile.{name}").alias("evidence_id"),
                F.lit(name).alias("category"),
                F.col(f"d.{name}").alias("value"),
            )
        )

    def listed(name: str, label: str, category: str, cap: int | None) -> Column:
        return F.transform(
            first_of(F.col(f"d.{name}"), cap),
            lambda v, i: F.struct(
                F.concat(F.lit(f"profile.{label}."), i.cast("string")).alias("evidence_id"),
                F.lit(category).alias("category"),
                v.alias("value"),
            ),
        )

    jobs = first_of(F.col("d.work_experience"), limits.entries)
    experience = F.transform(
        jobs,
        lambda w, i: F.struct(
            F.concat(F.lit("profile.experience."), i.cast("string")).alias("evidence_id"),
            F.lit("work_experience").alias("category"),
            F.concat_ws(
                " · ",
                F.nullif(F.trim(w["period"]), F.lit("")),
                F.nullif(F.trim(w["role"]), F.lit("")),
                F.nullif(F.trim(w["employer"]), F.lit("")),
            ).alias("value"),
        ),
    )
    tasks = F.flatten(
        F.transform(
            jobs,
            lambda w, i: F.transform(
                first_of(F.coalesce(w["responsibilities"], F.array().cast("array<string>")), limits.tasks),
                lambda r, j: F.struct(
                    F.concat(
                        F.lit("profile.experience."), i.cast("string"),
                        F.lit(".responsibility."), j.cast("string"),
                    ).alias("evidence_id"),
                    F.lit("responsibility").alias("category"),
                    r.alias("value"),
                ),
            ),
        )
    )
    empty = F.array().cast("array<struct<evidence_id:string,category:string,value:string>>")
    parts = [
        scalar("current_title"),
        scalar("experience_years"),
        listed("skills", "skill", "skill", limits.skills),
        listed("education", "education", "education", limits.education),
        listed("certifications", "certifications", "certification", limits.certifications),
        listed("languages", "language", "language", limits.languages),
        experience,
        tasks,
    ]
    facts = F.concat(*[F.coalesce(part, empty) for part in parts])
    rows = open_array(p, [key], facts, "f")
    value = head_of(F.trim("f.value"), limits.item)
    return rows.select(key, "f.evidence_id", "f.category", value.alias("value")).filter(
        F.coalesce(F.col("value"), F.lit("")) != ""
    )
