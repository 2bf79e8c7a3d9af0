"""Versioned upsert, due scores, derived rows, duplicate groups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.text import content_hash
from vakanz.operators.common import dedupe_first, lag_by_bucket


class Upsert(NamedTuple):
    """``current`` is the whole merged table, ``delta`` only the rows the batch touched."""

    current: DataFrame
    new_snapshots: DataFrame
    outcomes: DataFrame
    delta: DataFrame


def upsert_versioned(
    current: DataFrame,
    snapshots: DataFrame,
    incoming: DataFrame,
    *,
    keys: Sequence[str],
    hash_cols: Sequence[str] = (),
    now: Column,
    arrival: Sequence[str] = (),
    text_col: str | None = None,
) -> Upsert:
    """Merge a batch into the current table and find the versions not kept yet.

    New key: ``created``. Known key, other hash: every incoming column replaces the old one,
    ``updated``. Same hash: the columns are refreshed and only ``last_seen_at`` moves,
    ``skipped``. A repeated key within the batch counts as ``skipped`` and its first row wins.
    ``canonical_key`` is set once and kept. A snapshot is new only when its (key, hash) is
    unseen, so a return to an old version is an update without a new snapshot.

    ``current`` carries the keys, the incoming columns, ``content_hash`` and ``last_seen_at``;
    ``snapshots`` carries the keys and ``content_hash``. Outcomes, snapshots and the delta join
    the batch with the keys and hashes of the table only, so no stored text is shuffled; just
    ``current``, a full rewrite, moves whole rows.
    """
    order = [F.col(c) for c in (arrival or keys)]
    if "content_hash" not in incoming.columns:
        incoming = incoming.withColumn("content_hash", content_hash([F.col(c) for c in hash_cols]))
    batch = dedupe_first(incoming, keys, order)
    payload = [c for c in incoming.columns if c not in keys and c not in arrival]
    columns = list(dict.fromkeys([*(c for c in current.columns if c not in keys), *payload]))
    once = [c for c in ("canonical_key",) if c in payload and c in current.columns]
    carried = [c for c in current.columns if c not in (*keys, *payload)]

    # narrow side of the table: keys, hash, and the columns a batch does not bring
    old = current.select(
        *keys,
        F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_old_{c}") for c in ("content_hash", *once, *carried)],
    )
    decided = batch.join(old, list(keys), "left").withColumn(
        "outcome",
        F.when(F.col("_known").isNull(), "created")
        .when(F.col("_old_content_hash").eqNullSafe(F.col("content_hash")), "skipped")
        .otherwise("updated"),
    )

    def settled(name: str) -> Column:
        if name == "last_seen_at":
            value = now
        elif name in once:
            value = F.coalesce(f"_old_{name}", name)
        elif name in carried:
            value = F.col(f"_old_{name}")
        else:
            value = F.col(name)
        return value.alias(name)

    delta = decided.select(*keys, *[settled(c) for c in columns])

    text = [F.col(text_col).alias("cleaned_text")] if text_col else []
    versions = decided.filter(F.col("outcome") != "skipped").select(
        *keys,
        "content_hash",
        F.when(F.col("outcome") == "created", "created").otherwise("changed").alias("change_kind"),
        now.alias("fetched_at"),
        *text,
    )
    fresh = versions.join(
        snapshots.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti"
    )
    untouched = current.join(batch.select(*keys), list(keys), "left_anti")
    table = untouched.unionByName(delta, allowMissingColumns=True)
    return Upsert(table, fresh, decided.select(*keys, "outcome"), delta)


def change_points(
    versions: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column
) -> DataFrame:
    """Rows whose value differs from the version before, and the first row of every key."""
    rows = lag_by_bucket(versions, keys, order, bucket, {value: "previous_value"})
    changed = F.col("is_first") | ~F.col("previous_value").eqNullSafe(F.col(value))
    return rows.filter(changed).drop("is_first")


def previous_version(
    versions: DataFrame, keys: Sequence[str], order: Sequence[str], value: str
) -> DataFrame:
    """Latest and second latest version per key, for a one-step undo.

    The two newest rows are found by a ranked limit that is applied before the shuffle.
    """
    from vakanz.operators.common import top_per_key

    newest = top_per_key(versions, keys, [F.col(c).desc() for c in order], 2)
    return newest.groupBy(*keys).agg(
        F.max(F.when(F.col("position") == 1, F.col(value))).alias("current_value"),
        F.max(F.when(F.col("position") == 2, F.col(value))).alias("undo_value"),
    )


def duplicate_groups(df: DataFrame, key: str, source: str, member: str) -> DataFrame:
    """Keys that occur more than once, with how often, in how many sources, and who is first.

    Distinct sources are counted after a first aggregate by (key, source), so copies of one
    text collapse on the map side.
    """
    per_source = df.groupBy(key, source).agg(
        F.count("*").alias("n"), F.min(member).alias("first_member")
    )
    return (
        per_source.groupBy(key)
        .agg(
            F.sum("n").alias("members"),
            F.count("*").alias("sources"),
            F.min("first_member").alias("first_member"),
        )
        .filter(F.col("members") > 1)
    )


def duplicate_members(df: DataFrame, key: str, source: str, member: str) -> DataFrame:
    """Every posting of a duplicate group with the size of its group; one row per posting.

    The keys are dealt by member once and both sides read that exchange, so a key made of a long text is computed
    once, and a key that many postings share lies in many tasks.
    """
    keyed = df.select(key, source, member).repartition(F.col(member))
    sizes = duplicate_groups(keyed, key, source, member).select(key, "members", "first_member")
    return keyed.join(sizes, key)


def scores_due(
    postings: DataFrame,
    latest: DataFrame,
    *,
    key: str,
    profile_version: Column,
    preference_version: Column,
    changed: Column,
) -> DataFrame:
    """Postings whose score must be computed again, with the reason.

    ``latest`` holds one row per posting: key, profile_version, preference_version.
    """
    scored = latest.select(
        key,
        F.lit(True).alias("_scored"),
        F.col("profile_version").alias("_profile"),
        F.col("preference_version").alias("_preference"),
    )
    reason = (
        F.when(F.col("_scored").isNull(), "never_scored")
        .when(changed, "content_changed")
        .when(~F.col("_profile").eqNullSafe(profile_version), "profile_changed")
        .when(~F.col("_preference").eqNullSafe(preference_version), "preferences_changed")
    )
    joined = postings.join(scored, key, "left").withColumn("due_reason", reason)
    return joined.filter(F.col("due_reason").isNotNull()).drop("_scored", "_profile", "_preference")


def derivations_due(
    postings: DataFrame, derived: DataFrame, key: str, versions: dict[str, Column]
) -> DataFrame:
    """Postings without a derived row that matches on every version value (null-safe)."""
    kept = derived.select(
        key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_d_{c}") for c in versions]
    )
    same = F.col("_has").isNotNull()
    for column, wanted in versions.items():
        same = same & F.col(f"_d_{column}").eqNullSafe(wanted)
    return (
        postings.join(kept, key, "left")
        .filter(~same)
        .drop("_has", *[f"_d_{c}" for c in versions])
    )


def upsert_derived(current: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One derived row per key: a new result replaces the stored one."""
    columns = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*columns).alias("_old"))
    new = results.select(key, F.struct(*columns).alias("_new"))
    best = F.coalesce("_new", "_old").alias("_row")
    return old.join(new, key, "full_outer").select(key, best).select(key, "_row.*")
