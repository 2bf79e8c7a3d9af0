"""Search, filters, latest scores, pages and sections of the posting table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.text import contains_any, fold, let, normalize_text, py_fold, py_normalize
from vakanz.operators.common import global_row_number, latest_per_key, top_per_key


def search_text(columns: Sequence[Column], query: str, wildcards: bool = False) -> Column:
    """Case-insensitive containment in any column; ``wildcards`` lets % and _ match freely."""
    needle = query.strip()
    result = F.lit(False)
    for c in columns:
        hit = c.ilike(f"%{needle}%") if wildcards else F.contains(F.lower(c), F.lit(needle.lower()))
        result = result | F.coalesce(hit, F.lit(False))
    return result


def status_is(status: Column, wanted: str) -> Column:
    """A posting without an application record counts as new."""
    return F.coalesce(status, F.lit(fixed.NEW)) == wanted


def filter_postings(
    df: DataFrame,
    *,
    query: str | None = None,
    active_only: bool = True,
    source_id: int | None = None,
    employment_type: str | None = None,
    remote_type: str | None = None,
    state: str | None = None,
    status: str | None = None,
    min_relevance: float | None = None,
) -> DataFrame:
    """Optional filters, each applied only when given, so each can reach the scan."""
    if active_only:
        df = df.filter("is_active")
    if source_id is not None:
        df = df.filter(F.col("source_id") == source_id)
    if remote_type:
        df = df.filter(F.col("remote_type") == remote_type)
    if state:
        df = df.filter(F.col("state") == state)
    if employment_type:
        df = df.filter(search_text([F.col("employment_type")], employment_type))
    if query and query.strip():
        names = ("title", "employer", "description_text", "location_text")
        df = df.filter(search_text([F.col(n) for n in names if n in df.columns], query))
    if status:
        df = df.filter(status_is(F.col("status"), status))
    if min_relevance is not None:
        df = df.filter(F.col("relevance_score") >= min_relevance)
    return df


def priority_condition(
    state: Column, remote_type: Column, states: Sequence[str], include_remote: bool
) -> Column:
    """Preferred region or remote; with no condition at all nothing qualifies."""
    result = F.lit(False)
    for name in (s.strip() for s in states):
        if name:
            hit = (
                F.lower(state).startswith("baden")
                if name.lower().startswith("baden")
                else F.lower(state) == name.lower()
            )
            result = result | F.coalesce(hit, F.lit(False))
    if include_remote:
        result = result | F.coalesce(remote_type == "remote", F.lit(False))
    return result


def title_matches(title: Column, terms: Sequence[str]) -> Column:
    return let(normalize_text(title), lambda t: contains_any(t, [py_normalize(x) for x in terms]))


def title_token_subset(
    title: Column, terms: Sequence[str], stop: Sequence[str] = fixed.TITLE_STOP_WORDS
) -> Column:
    """All significant words of some term occur in the title, in any order."""
    import re

    words = F.regexp_extract_all(fold(title), F.lit("([a-z0-9äöüß]+)"), 1)
    result = F.lit(False)
    for term in terms:
        wanted = sorted(set(re.findall("[a-z0-9äöüß]+", py_fold(term))) - {py_fold(s) for s in stop} - set(stop))
        if wanted:
            need = F.array(*[F.lit(w) for w in wanted])
            result = result | (F.size(F.array_except(need, words)) == 0)
    return F.coalesce(result, F.lit(False))


def local_query_match(
    text: Sequence[Column], locations: Column, query: str | None, location: str | None
) -> Column:
    """Text needle in the joined fields and place needle in any location."""
    result = F.lit(True)
    if query:
        haystack = fold(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in text]))
        result = result & F.contains(haystack, F.lit(py_fold(query)))
    if location:
        needle = py_fold(location)
        result = result & F.coalesce(
            F.exists(locations, lambda x: F.contains(fold(x), F.lit(needle))), F.lit(False)
        )
    return result


def workplace_bucket(
    c: Column, synonyms: Mapping[str, Sequence[str]] = fixed.WORKPLACE_SYNONYMS
) -> Column:
    text = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    items = iter(synonyms.items())
    name, values = next(items)
    result = F.when(text.isin(*values), name)
    for name, values in items:
        result = result.when(text.isin(*values), name)
    return result.otherwise("unknown")


def role_scope(
    title: Column,
    body: Column,
    structured: Column,
    title_terms: Sequence[str] = fixed.STRATEGIC_TITLE_TERMS,
    management_terms: Sequence[str] = fixed.MANAGEMENT_TERMS,
) -> Column:
    """``strategic`` by flag, by class, or by title and management terms; else ``core``."""
    flag = F.coalesce(F.get_json_object(structured, "$.strategic_adjacent"), F.lit("false"))
    kind = F.coalesce(F.get_json_object(structured, "$.classification"), F.lit(""))
    by_text = let(fold(title), lambda t: contains_any(t, [py_fold(x) for x in title_terms])) & let(
        fold(F.concat_ws(" ", title, body)),
        lambda t: contains_any(t, [py_fold(x) for x in management_terms]),
    )
    strategic = ~flag.isin("false", "0", "", "null") | (kind == "strategisch_erweitert") | by_text
    return F.when(strategic, "strategic").otherwise("core")


def with_latest(
    postings: DataFrame, scores: DataFrame, applications: DataFrame, key: str = "job_id"
) -> DataFrame:
    """Posting with its newest score and its application record (both optional)."""
    newest = latest_per_key(scores, [key], ["created_at", "score_id"]).select(
        key, "score_id", "relevance_score", "candidate_fit_score"
    )
    return postings.join(newest, key, "left").join(
        applications.select(key, "status"), key, "left"
    )


PAGE_ORDER = (
    ("relevance_score", True),
    ("candidate_fit_score", True),
    ("published_at", True),
    ("job_id", True),
)


def list_page(
    df: DataFrame, limit: int, offset: int = 0, order: Sequence[tuple[str, bool]] = PAGE_ORDER, total: str | None = None
) -> DataFrame:
    """One page in a total order, nulls last; planned as a top-k, not as a sort.

    ``total`` names a column for the number of rows of all pages, which is one count beside the page.
    """
    keys = [
        F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order
    ]
    page = df.orderBy(*keys).offset(offset).limit(limit)
    return page if total is None else page.withColumn(total, df.agg(F.count("*").alias(total)).scalar())


GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold


def deep_pages(
    df: DataFrame, bucket: str, order: Sequence[Column], offset: int, size: int = 100
) -> DataFrame:
    """``section_pages`` at any depth: rows are numbered by one range sort over (section, order).

    A section's rows are neighbours in that order, so its first number gives the numbers of the page. Rows meet the
    page by their own number, never by their section: every task sorts one range and none reads a section.
    """
    numbered = global_row_number(df.filter(F.col(bucket).isNotNull()), [F.col(bucket).asc(), *order], "_no")
    totals = numbered.groupBy(bucket).agg(F.min("_no").alias("_first"), F.count("*").alias("total"))
    totals = totals.filter((F.col("total") > offset) & F.lit(size > 0))
    last = F.col("_first") + F.least(F.lit(offset + size).cast("long"), F.col("total")) - 1
    numbers = F.explode(F.sequence(F.col("_first") + offset, last)).alias("_no")
    page = numbered.join(totals.select("_first", "total", numbers), "_no")
    page = page.withColumn("position", (F.col("_no") - F.col("_first") + 1).cast("int")).drop("_no", "_first")
    return page.withColumn("has_more", F.lit(offset + size) < F.col("total"))


def section_pages(
    df: DataFrame, bucket: str, order: Sequence[Column], offset: int = 0, size: int = 100
) -> DataFrame:
    """Per section its rows ``offset`` to ``offset + size``, section total and ``has_more``.

    Totals are a partial aggregate and rows a ranked limit pushed before the shuffle, so a
    section that holds most rows is never sorted as a whole. Spark plans that limit up to ``GROUP_LIMIT``
    rows; a page behind it comes from :func:`deep_pages`, with the same rows.
    A section is one of a few names.
    """
    if offset + size > GROUP_LIMIT:
        return deep_pages(df, bucket, order, offset, size)
    totals = df.groupBy(bucket).agg(F.count("*").alias("total"))
    rows = top_per_key(df, [bucket], order, offset + size).filter(F.col("position") > offset)
    return rows.join(totals, bucket).withColumn(
        "has_more", F.lit(offset + size) < F.col("total")
    )


def dashboard_stats(
    postings: DataFrame, applications: DataFrame, new_since: Column, strong: float = 80.0
) -> DataFrame:
    """Dashboard numbers: new and strong postings, saved and active applications."""
    jobs = postings.agg(
        F.count_if(F.col("published_at") > new_since).alias("new_jobs"),
        F.count_if(F.col("relevance_score") >= strong).alias("strong_matches"),
    )
    records = applications.agg(
        F.count_if(F.col("status") == fixed.SAVED).alias("saved_jobs"),
        F.count_if(F.col("status").isin(*fixed.ACTIVE_STATUSES)).alias("active_applications"),
    )
    columns = [
        records.select("saved_jobs").scalar().alias("saved_jobs"),
        records.select("active_applications").scalar().alias("active_applications"),
    ]
    return jobs.select("*", *columns)


def eligible_topk(
    df: DataFrame, min_relevance: float, min_fit: float, limit: int = 5
) -> DataFrame:
    """Best active postings that may still be applied to and pass both thresholds."""
    open_status = ~F.coalesce(F.col("status"), F.lit(fixed.NEW)).isin(*fixed.BLOCKED_STATUSES)
    kept = df.filter(
        F.col("is_active")
        & open_status
        & (F.col("relevance_score") >= min_relevance)
        & (F.col("candidate_fit_score") >= min_fit)
    )
    return kept.orderBy(
        F.coalesce("relevance_score", F.lit(-1.0)).desc(),
        F.coalesce("candidate_fit_score", F.lit(-1.0)).desc(),
        F.col("job_id").desc(),
    ).limit(limit)


def summary_candidates(df: DataFrame, min_relevance: float) -> DataFrame:
    """Active postings with a latest score at or above the threshold (inner join semantics)."""
    return df.filter(F.col("is_active") & (F.col("relevance_score") >= min_relevance))


def posting_detail(
    postings: DataFrame, children: Mapping[str, tuple[DataFrame, str, str]], key: str = "job_id"
) -> DataFrame:
    """Posting with all its child rows, one output row per child.

    ``children`` maps a kind to (table, id column, time column). A posting may have any number
    of children, so they are not collected into one row; a posting without children appears
    once with a null kind. Children meet their posting by an inner join, where the planner can split the
    children of one posting over tasks; postings without any come from an anti join.
    """
    rows = None
    for kind, (table, child_id, at) in children.items():
        part = table.select(
            key,
            F.lit(kind).alias("child_kind"),
            F.col(child_id).cast("string").alias("child_id"),
            F.col(at).alias("child_at"),
        )
        rows = part if rows is None else rows.unionByName(part)
    alone = postings.join(rows.select(key).distinct(), key, "left_anti")
    for name in ("child_kind", "child_id", "child_at"):
        alone = alone.withColumn(name, F.lit(None).cast(rows.schema[name].dataType))
    return rows.join(postings, key).select(*alone.columns).unionByName(alone)
