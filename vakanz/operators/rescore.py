"""One rescore run: all postings, all or nothing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanz.operators.learning import adjusted_score, feedback_signal, signal_reason
from vakanz.operators.scoring import DEFAULT_RUBRIC, Profile, Rubric, evaluate
from vakanz.sources.tables import VersionedTable


class Rescore(NamedTuple):
    status: str
    reason: str | None = None
    version: int | None = None


def score_all(
    postings: DataFrame,
    examples: DataFrame,
    profile: Profile,
    *,
    columns,
    features,
    structured: str | None = None,
    key: str = "job_id",
    title: str = "title",
    body: str = "description_text",
    rubric: Rubric = DEFAULT_RUBRIC,
    reasons: bool = True,
) -> DataFrame:
    """Relevance, fit and feedback adjustment of every posting, active or not."""
    targets = postings.select(key, *[c.alias(n) for n, c in features.items()])
    known = targets.join(examples, key)
    signal = feedback_signal(targets, known, key=key)
    scored = evaluate(postings, title, body, columns, profile, structured, rubric, reasons)
    keep = [key, "relevance", "fit"] + (["relevance_reasons", "fit_reasons"] if reasons else [])
    result = adjusted_score(scored.select(*keep), signal, key=key)
    if reasons:
        result = result.withColumn("fit_reasons", F.array_append("fit_reasons", signal_reason()))
    return result.withColumn("profile_version", F.lit(profile.version)).withColumn(
        "preference_version", F.lit(profile.preference_version)
    )


def process_rescore(
    store: VersionedTable,
    request: dict | None,
    profile: Profile | None,
    build,
) -> Rescore:
    """Consume a pending request. The scores appear with the manifest row or not at all."""
    if request is None or request.get("status") != "pending":
        return Rescore("idle", "no pending request")
    if profile is None:
        return Rescore("blocked", "no confirmed profile")
    if not profile.has_preferences:
        return Rescore("blocked", "no preferences")
    version = store.replace(build(profile), note=str(request.get("reason", "")))
    return Rescore("completed", version=version)
