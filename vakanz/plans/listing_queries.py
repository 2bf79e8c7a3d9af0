"""Listing, latest rows, pages, sections, upsert and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz.functions import text
from vakanz.operators import lifecycle, listing, upsert
from vakanz.operators.common import dedupe_first, dedupe_last, latest_per_key, time_bucket
from vakanz.plans.registry import query
from vakanz.plans.text_queries import visible_sql
from vakanz.plans.text_queries import _HASH_SQL, _KEY_SQL, HASH_COLS
from vakanz.plans.views import (
    APPLICATIONS,
    LATEST,
    LISTING,
    POSTINGS,
    SCORES,
    STATUS_LOG,
    applications,
    ctes,
    listed,
    postings,
    scores,
    status_log,
    table,
)


def ntz(value: str):
    return F.expr(f"TIMESTAMP_NTZ'{value}'")


# --- listing --------------------------------------------------------------------------------


@query(
    "filter_postings",
    ctes(*LISTING)
    + """ SELECT job_id, relevance_score FROM listed WHERE is_active AND source_id = 3
      AND contains(lower(employment_type), 'zeit') AND contains(lower(concat(title, ' ', employer, ' ', description_text, ' ', location_text)), 'tion')
      AND (relevance_score >= 10)
      UNION ALL SELECT job_id, relevance_score FROM listed WHERE is_active AND remote_type = 'hybrid' AND state = 'Bayern'""",
)
def filter_postings(spark, d):
    rows = listed(spark, d)
    one = listing.filter_postings(
        rows, source_id=3, employment_type="zeit", query="tion", min_relevance=10
    )
    two = listing.filter_postings(rows, remote_type="hybrid", state="Bayern")
    return one.select("job_id", "relevance_score").unionByName(two.select("job_id", "relevance_score"))


@query(
    "status_filter",
    ctes(*LISTING) + " SELECT job_id, status FROM listed WHERE status IS NULL OR status = 'Neu'",
)
def status_filter(spark, d):
    rows = listed(spark, d)
    return rows.filter(listing.status_is(F.col("status"), "Neu")).select("job_id", "status")


@query(
    "postings_with_latest",
    ctes(*LISTING) + " SELECT job_id, score_id, relevance_score, candidate_fit_score, status FROM listed",
)
def postings_with_latest(spark, d):
    return listed(spark, d).select(
        "job_id", "score_id", "relevance_score", "candidate_fit_score", "status"
    )


@query(
    "summary_candidates",
    ctes(*LISTING) + " SELECT job_id, relevance_score FROM listed WHERE is_active AND relevance_score >= 40",
)
def summary_candidates(spark, d):
    return listing.summary_candidates(listed(spark, d), 40).select("job_id", "relevance_score")


@query(
    "posting_detail",
    ctes(POSTINGS, SCORES, STATUS_LOG)
    + """, kids AS (SELECT job_id, 'score' AS child_kind, CAST(score_id AS VARCHAR) AS child_id, created_at AS child_at FROM scores
      UNION ALL SELECT job_id, 'status', CAST(event_id AS VARCHAR), ts FROM status_log)
      SELECT p.job_id, p.title, k.child_kind, k.child_id, k.child_at FROM postings p LEFT JOIN kids k ON k.job_id = p.job_id""",
)
def posting_detail(spark, d):
    rows = listing.posting_detail(
        postings(spark, d).select("job_id", "title"),
        {
            "score": (scores(spark, d), "score_id", "created_at"),
            "status": (status_log(spark, d), "event_id", "ts"),
        },
    )
    return rows.select("job_id", "title", "child_kind", "child_id", "child_at")


@query(
    "page_of_postings",
    ctes(*LISTING)
    + """ SELECT job_id, relevance_score, candidate_fit_score, published_at, (SELECT count(*) FROM listed WHERE is_active) AS total FROM listed WHERE is_active
      ORDER BY relevance_score DESC NULLS LAST, candidate_fit_score DESC NULLS LAST, published_at DESC NULLS LAST, job_id DESC LIMIT 50 OFFSET 100""",
)
def page_of_postings(spark, d):
    page = listing.list_page(listed(spark, d).filter("is_active"), 50, 100, total="total")
    return page.select("job_id", "relevance_score", "candidate_fit_score", "published_at", "total")


@query(
    "section_pages",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC) AS rn,
        count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders)
       SELECT o_orderpriority AS bucket, o_orderkey, CAST(rn AS INT) AS position, total, 120 < total AS has_more
       FROM o WHERE rn > 20 AND rn <= 120""",
)
def section_pages(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "bucket")
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").desc()]
    rows = listing.section_pages(o.select("bucket", "o_orderkey", "o_totalprice"), "bucket", order, 20, 100)
    return rows.select("bucket", "o_orderkey", "position", "total", "has_more")


@query(
    "section_pages_deep",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn,
        count(*) OVER (PARTITION BY l_linestatus) AS total FROM lineitem)
       SELECT l_linestatus AS bucket, l_orderkey, l_linenumber, CAST(rn AS INT) AS position, total, 2600 < total AS has_more
       FROM o WHERE rn > 2000 AND rn <= 2600""",
)
def section_pages_deep(spark, d):
    """Behind the rank limit: places come from range partitions."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("bucket"), "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    page = listing.section_pages(rows, "bucket", order, 2000, 600)
    return page.select("bucket", "l_orderkey", "l_linenumber", "position", "total", "has_more")


@query(
    "dashboard_stats",
    ctes(*LISTING)
    + """ SELECT (SELECT count(*) FROM listed WHERE published_at > TIMESTAMP '2024-01-18 10:00:00') AS new_jobs,
      (SELECT count(*) FROM listed WHERE relevance_score >= 80) AS strong_matches,
      (SELECT count(*) FROM applications WHERE status = 'Merkliste') AS saved_jobs,
      (SELECT count(*) FROM applications WHERE status IN ('Bewerbung geplant', 'Beworben', 'Gespräch', 'Angebot')) AS active_applications""",
)
def dashboard_stats(spark, d):
    return listing.dashboard_stats(
        listed(spark, d), applications(spark, d), ntz("2024-01-18 10:00:00")
    )


@query(
    "dashboard_top",
    ctes(*LISTING)
    + """ SELECT job_id, relevance_score, candidate_fit_score FROM listed WHERE is_active AND (state = 'Berlin' OR remote_type = 'remote')
      ORDER BY coalesce(relevance_score, 0) DESC, coalesce(candidate_fit_score, 0) DESC, job_id DESC LIMIT 4""",
)
def dashboard_top(spark, d):
    rows = listed(spark, d).filter("is_active")
    rows = rows.filter(
        listing.priority_condition(F.col("state"), F.col("remote_type"), ("Berlin",), True)
    )
    return (
        rows.orderBy(
            F.coalesce("relevance_score", F.lit(0.0)).desc(),
            F.coalesce("candidate_fit_score", F.lit(0.0)).desc(),
            F.col("job_id").desc(),
        )
        .limit(4)
        .select("job_id", "relevance_score", "candidate_fit_score")
    )


@query(
    "eligible_topk",
    ctes(*LISTING)
    + """ SELECT job_id, relevance_score, candidate_fit_score FROM listed WHERE is_active
      AND coalesce(status, 'Neu') NOT IN ('Nicht passend', 'Beworben', 'Gespräch', 'Angebot', 'Abgeschlossen')
      AND relevance_score >= 20 AND candidate_fit_score >= 20
      ORDER BY relevance_score DESC, candidate_fit_score DESC, job_id DESC LIMIT 5""",
)
def eligible_topk(spark, d):
    return listing.eligible_topk(listed(spark, d), 20, 20).select(
        "job_id", "relevance_score", "candidate_fit_score"
    )


# --- windows --------------------------------------------------------------------------------


@query("latest_score", ctes(SCORES, LATEST) + " SELECT job_id, score_id, relevance_score FROM latest")
def latest_score(spark, d):
    return latest_per_key(scores(spark, d), ["job_id"], ["created_at", "score_id"]).select(
        "job_id", "score_id", "relevance_score"
    )


@query(
    "latest_decision",
    ctes(STATUS_LOG)
    + """ SELECT job_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM status_log WHERE value IN ('Merkliste', 'Nicht passend')) WHERE rn = 1""",
)
def latest_decision(spark, d):
    kept = status_log(spark, d).filter(F.col("value").isin("Merkliste", "Nicht passend"))
    return latest_per_key(kept, ["job_id"], ["ts", "event_id"]).select("job_id", "event_id", "value")


@query(
    "dedupe_first",
    """SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang, n_chars % 10 ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedupe_first_query(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    rows = dedupe_first(docs, ["source", "lang", F.col("n_chars") % 10], [F.col("doc_id")])
    return rows.select("source", "lang", "doc_id")


@query(
    "dedupe_last",
    """SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1""",
)
def dedupe_last_query(spark, d):
    rows = table(spark, d, "pages").select("url", "page_id")
    return dedupe_last(rows, [F.substring_index("url", "?", 1)], ["page_id"]).select("url", "page_id")


@query(
    "change_points",
    """SELECT user_id, event_id, previous_value FROM (SELECT user_id, event_id, event_type, ts,
        lag(event_type) OVER w AS previous_value, row_number() OVER w AS rn FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       WHERE rn = 1 OR previous_value IS DISTINCT FROM event_type""",
)
def change_points(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    rows = upsert.change_points(
        e, ["user_id"], ["ts", "event_id"], "event_type", time_bucket("ts")
    )
    return rows.select("user_id", "event_id", "previous_value")


@query(
    "previous_version",
    """SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS current_value, max(CASE WHEN rn = 2 THEN event_type END) AS undo_value
       FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn <= 2 GROUP BY user_id""",
)
def previous_version(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return upsert.previous_version(e, ["user_id"], ["ts", "event_id"], "event_type")


@query("latest_scored_at", ctes(SCORES) + " SELECT max(created_at) AS latest_scored_at FROM scores")
def latest_scored_at(spark, d):
    return scores(spark, d).agg(F.max("created_at").alias("latest_scored_at"))


@query(
    "recent_runs",
    """SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS o_orderdate FROM orders)
       ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50""",
)
def recent_runs(spark, d):
    from vakanz.operators.reports import recent_rows

    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("o_orderdate")
    )
    return recent_rows(o, "o_orderdate", "o_orderkey", 50)


@query(
    "batch_assign",
    ctes(*LISTING)
    + """ SELECT job_id, CAST(rn - 1 AS BIGINT) AS row_no, CAST(floor((rn - 1) / 20) AS INT) AS batch_no FROM (
      SELECT job_id, row_number() OVER (ORDER BY relevance_score DESC, job_id) AS rn FROM listed WHERE is_active AND relevance_score >= 40) WHERE rn <= 50""",
)
def batch_assign(spark, d):
    from vakanz.sources.catalogue import batch_assign as assign

    pending = listing.summary_candidates(listed(spark, d), 40).select("job_id", "relevance_score")
    rows = assign(pending, [F.col("relevance_score").desc(), F.col("job_id")], 20, 50)
    return rows.select("job_id", F.col("row_no").cast("bigint").alias("row_no"), "batch_no")


@query(
    "batch_assign_all",
    """SELECT o_orderkey, rn - 1 AS row_no, CAST(floor((rn - 1) / 20) AS INT) AS batch_no FROM (
       SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)""",
)
def batch_assign_all(spark, d):
    """Every row numbered in parallel, without a cycle limit."""
    from vakanz.sources.catalogue import batch_assign as assign

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    rows = assign(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, None)
    return rows.select("o_orderkey", "row_no", "batch_no")


# --- upsert ---------------------------------------------------------------------------------

_IN = """
current_t AS (SELECT source_id, external_id, title, employer, description_text, location_text, remote_type, employment_type, contract_type, structured_data FROM postings WHERE job_id % 10 <> 0),
incoming AS (SELECT source_id, external_id, title, employer,
  CASE WHEN job_id % 7 = 0 THEN concat(description_text, '!') ELSE description_text END AS description_text,
  location_text, remote_type, employment_type, contract_type, structured_data FROM postings WHERE job_id % 3 <> 0)
"""


def _tables(spark, d):
    p = postings(spark, d)
    cols = ["source_id", "external_id", *HASH_COLS]
    key = text.canonical_key(F.col("title"), F.col("employer"), F.col("location_text"))
    current = (
        p.filter("job_id % 10 <> 0")
        .select(*cols)
        .withColumn("content_hash", text.content_hash([F.col(c) for c in HASH_COLS]))
        .withColumn("canonical_key", key)
        .withColumn("last_seen_at", ntz("2024-01-01 00:00:00"))
    )
    changed = F.when(
        F.col("job_id") % 7 == 0, F.concat("description_text", F.lit("!"))
    ).otherwise(F.col("description_text"))
    incoming = (
        p.filter("job_id % 3 <> 0")
        .withColumn("description_text", changed)
        .select(*cols)
        .withColumn("canonical_key", key)
    )
    snapshots = current.select("source_id", "external_id", "content_hash")
    return current, snapshots, incoming


def _upsert(spark, d):
    current, snapshots, incoming = _tables(spark, d)
    return upsert.upsert_versioned(
        current, snapshots, incoming, keys=["source_id", "external_id"], hash_cols=HASH_COLS,
        now=ntz("2024-02-01 00:00:00"), text_col="description_text",
    )


_UP = ctes(POSTINGS, _IN, f"""
outs AS (SELECT i.source_id, i.external_id, i.description_text, {_HASH_SQL.replace('WHEN ', 'WHEN i.').replace("concat('1', ", "concat('1', i.")} AS new_hash,
  CASE WHEN c.external_id IS NULL THEN 'created' WHEN c.description_text = i.description_text THEN 'skipped' ELSE 'updated' END AS outcome
  FROM incoming i LEFT JOIN current_t c ON c.source_id = i.source_id AND c.external_id = i.external_id)""")


@query("upsert_outcomes", _UP + " SELECT source_id, external_id, outcome FROM outs")
def upsert_outcomes(spark, d):
    return _upsert(spark, d).outcomes


@query(
    "upsert_snapshots",
    _UP + """ SELECT source_id, external_id, new_hash AS content_hash, CASE outcome WHEN 'created' THEN 'created' ELSE 'changed' END AS change_kind
      FROM outs WHERE outcome <> 'skipped'""",
)
def upsert_snapshots(spark, d):
    return _upsert(spark, d).new_snapshots.select(
        "source_id", "external_id", "content_hash", "change_kind"
    )


@query(
    "upsert_table",
    ctes(POSTINGS, _IN)
    + """ SELECT coalesce(i.source_id, c.source_id) AS source_id, coalesce(i.external_id, c.external_id) AS external_id,
      sha256(coalesce(i.description_text, c.description_text)) AS text_hash,
      CASE WHEN i.external_id IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS last_seen_at
      FROM incoming i FULL OUTER JOIN current_t c ON c.source_id = i.source_id AND c.external_id = i.external_id""",
)
def upsert_table(spark, d):
    current = _upsert(spark, d).current
    return current.select(
        "source_id", "external_id", F.sha2("description_text", 256).alias("text_hash"), "last_seen_at"
    )


@query(
    "duplicate_groups",
    """WITH k AS (SELECT doc_id, source, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9äöüß]+', ' ', 'g'))) AS k FROM documents)
       SELECT k AS text_key, CAST(count(*) AS BIGINT) AS members, count(DISTINCT source) AS sources, min(doc_id) AS first_member
       FROM k GROUP BY k HAVING count(*) > 1""",
)
def duplicate_groups(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "source", F.sha2(text.key_part(F.col("text")), 256).alias("text_key")
    )
    return upsert.duplicate_groups(docs, "text_key", "source", "doc_id")


@query(
    "duplicate_members",
    """WITH k AS (SELECT doc_id, source, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9äöüß]+', ' ', 'g'))) AS k FROM documents),
       g AS (SELECT k, CAST(count(*) AS BIGINT) AS members, min(doc_id) AS first_member FROM k GROUP BY k HAVING count(*) > 1)
       SELECT k.k AS text_key, source, doc_id, members, first_member FROM k JOIN g ON g.k = k.k""",
)
def duplicate_members(spark, d):
    # a key that can't be null is not computed once more to be filtered
    key = F.coalesce(F.sha2(text.key_part(F.col("text")), 256), F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", "source", key.alias("text_key"))
    return upsert.duplicate_members(docs, "text_key", "source", "doc_id")


@query(
    "derivations_due",
    ctes(POSTINGS)
    + f""", dv AS (SELECT job_id, CASE WHEN job_id % 4 = 1 THEN 'old' ELSE {_KEY_SQL} END AS content_hash,
       CASE WHEN job_id % 5 = 1 THEN NULL ELSE 2 END AS profile_version, CASE WHEN job_id % 6 = 1 THEN 'en' ELSE 'de' END AS locale
       FROM postings WHERE job_id % 3 <> 2)
      SELECT p.job_id FROM (SELECT job_id, {_KEY_SQL} AS h FROM postings) p LEFT JOIN dv ON dv.job_id = p.job_id
      WHERE dv.job_id IS NULL OR dv.content_hash <> p.h OR dv.profile_version IS DISTINCT FROM 2 OR dv.locale <> 'de'""",
)
def derivations_due(spark, d):
    p = postings(spark, d)
    key = text.canonical_key(F.col("title"), F.col("employer"), F.col("location_text"))
    hashed = p.select("job_id", key.alias("h"))
    m = F.col("job_id")
    derived = hashed.filter(m % 3 != 2).select(
        "job_id",
        F.when(m % 4 == 1, "old").otherwise(F.col("h")).alias("content_hash"),
        F.when(m % 5 != 1, 2).alias("profile_version"),
        F.when(m % 6 == 1, "en").otherwise("de").alias("locale"),
    )
    due = upsert.derivations_due(
        hashed, derived, "job_id",
        {"content_hash": F.col("h"), "profile_version": F.lit(2), "locale": F.lit("de")},
    )
    return due.select("job_id")


@query(
    "derived_upsert",
    """SELECT o_custkey AS job_id, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS overview FROM (SELECT DISTINCT o_custkey FROM orders)
       WHERE o_custkey % 2 = 0 OR o_custkey % 3 = 0""",
)
def derived_upsert(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id")).distinct()
    old = keys.filter("job_id % 3 = 0").withColumn("overview", F.lit("old"))
    new = keys.filter("job_id % 2 = 0").withColumn("overview", F.lit("new"))
    return upsert.upsert_derived(old, new, "job_id")


# --- lifecycle ------------------------------------------------------------------------------

_NOW = "2024-02-01 12:00:00"
_LIFE_COLS = (
    "job_id", "title", "is_active", "availability_status", "availability_failures",
    "availability_checked_at", "expires_at", "last_seen_at",
)
LIFE_SQL = (
    """life AS (SELECT job_id, title, is_active, CASE WHEN is_active THEN 'active' ELSE 'inactive' END AS availability_status,
     CAST(job_id % 4 AS INT) AS availability_failures,
     CASE WHEN job_id % 5 = 0 THEN TIMESTAMP '2024-02-01 10:00:00' ELSE created_at END AS availability_checked_at,
     CASE WHEN job_id % 13 = 0 THEN created_at END AS expires_at, created_at AS last_seen_at FROM postings)""",
    """checks AS (SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'check_failed' END AS check_status
     FROM postings WHERE job_id % 2 = 0)""",
    """moved AS (SELECT l.*, c.check_status, expires_at <= TIMESTAMP '2024-02-01 12:00:00' IS TRUE AS expired,
     availability_checked_at >= TIMESTAMP '2024-02-01 06:00:00' AS fresh FROM life l LEFT JOIN checks c ON c.job_id = l.job_id)""",
    """acted AS (SELECT *, expired OR (NOT fresh AND check_status IS NOT NULL) AS acts,
     CASE WHEN expired THEN 'inactive' ELSE check_status END AS st FROM moved)""",
    """after_t AS (SELECT job_id, is_active AS was_active, CASE WHEN acts THEN st ELSE availability_status END AS availability_status,
     CASE WHEN acts AND st <> 'check_failed' THEN st = 'active' ELSE is_active END AS is_active,
     CASE WHEN acts AND st <> 'check_failed' THEN 0 WHEN acts THEN availability_failures + 1 ELSE availability_failures END AS availability_failures,
     CASE WHEN NOT acts THEN CASE WHEN fresh AND NOT expired THEN 'cached' ELSE 'unchecked' END WHEN expired THEN 'expired' ELSE 'checked' END AS transition FROM acted)""",
)


def _life(spark, d):
    m = F.col("job_id")
    return postings(spark, d).select(
        "job_id", "title", "is_active",
        F.when(F.col("is_active"), "active").otherwise("inactive").alias("availability_status"),
        (m % 4).cast("int").alias("availability_failures"),
        F.when(m % 5 == 0, ntz("2024-02-01 10:00:00")).otherwise(F.col("created_at")).alias("availability_checked_at"),
        F.lit("source_sync").alias("availability_check_method"),
        F.lit("present_in_source").alias("availability_reason"),
        F.when(m % 13 == 0, F.col("created_at")).alias("expires_at"),
        F.col("created_at").alias("last_seen_at"),
    )


def _checks(spark, d):
    m = F.col("job_id") % 3
    return postings(spark, d).filter("job_id % 2 = 0").select(
        "job_id",
        F.when(m == 0, "active").when(m == 1, "inactive").otherwise("check_failed").alias("check_status"),
        F.lit("canonical_url_http").alias("check_method"),
        F.lit("seen").alias("check_reason"),
    )


@query(
    "availability_update",
    ctes(POSTINGS, *LIFE_SQL)
    + " SELECT job_id, availability_status, is_active, availability_failures, transition FROM after_t",
)
def availability_update(spark, d):
    rows = lifecycle.apply_availability(_life(spark, d), _checks(spark, d), ntz(_NOW))
    return rows.select("job_id", "availability_status", "is_active", "availability_failures", "transition")


@query(
    "maintenance_counts",
    ctes(POSTINGS, *LIFE_SQL)
    + """ SELECT count(*) FILTER (WHERE transition IN ('checked', 'expired')) AS jobs_checked,
      count(*) FILTER (WHERE transition IN ('checked', 'expired') AND was_active AND availability_status = 'inactive') AS jobs_inactivated,
      count(*) FILTER (WHERE transition IN ('checked', 'expired') AND NOT was_active AND availability_status = 'active') AS jobs_reactivated,
      count(*) FILTER (WHERE transition IN ('checked', 'expired') AND availability_status = 'check_failed') AS checks_failed FROM after_t""",
)
def maintenance_counts(spark, d):
    rows = lifecycle.apply_availability(_life(spark, d), _checks(spark, d), ntz(_NOW))
    return lifecycle.maintenance_counts(rows)


@query(
    "check_candidates",
    ctes(POSTINGS, STATUS_LOG, APPLICATIONS)
    + """ SELECT job_id, check_priority FROM (SELECT p.job_id, p.created_at, CASE coalesce(a.status, 'Neu') WHEN 'Bewerbung geplant' THEN 0
      WHEN 'Merkliste' THEN 1 WHEN 'Neu' THEN 2 ELSE 3 END AS check_priority FROM postings p LEFT JOIN applications a ON a.job_id = p.job_id
      WHERE p.created_at <= TIMESTAMP '2024-03-01 12:00:00' - INTERVAL 30 DAY) ORDER BY check_priority, created_at, job_id LIMIT 50""",
)
def check_candidates(spark, d):
    rows = postings(spark, d).select("job_id", F.col("created_at").alias("last_seen_at"))
    rows = rows.join(applications(spark, d).select("job_id", "status"), "job_id", "left")
    return lifecycle.check_candidates(rows, ntz("2024-03-01 12:00:00")).select(
        "job_id", "check_priority"
    )


@query(
    "retention",
    """SELECT doc_id, CASE WHEN doc_id % 200 > 90 THEN NULL ELSE sha256(text) END AS raw_hash FROM documents""",
)
def retention(spark, d):
    docs = table(spark, d, "documents")
    at = F.expr("timestampadd(DAY, -CAST(doc_id % 200 AS INT), TIMESTAMP_NTZ'2024-06-01 00:00:00')")
    snapshots = docs.select("doc_id", at.alias("fetched_at"), F.col("text").alias("raw"))
    kept = lifecycle.retention(snapshots, ntz("2024-06-01 00:00:00"), days=90)
    return kept.select("doc_id", F.sha2("raw", 256).alias("raw_hash"))


@query(
    "retention_batch",
    """SELECT doc_id, CASE WHEN place <= 25 THEN NULL ELSE sha256(text) END AS raw_hash FROM (SELECT *, row_number() OVER (
         ORDER BY CASE WHEN doc_id % 200 > 90 AND text IS NOT NULL THEN 0 ELSE 1 END, doc_id % 200 DESC, doc_id)
         + CASE WHEN doc_id % 200 > 90 AND text IS NOT NULL THEN 0 ELSE 1000000000 END AS place FROM documents)""",
)
def retention_batch(spark, d):
    """The oldest 25 raw texts that are due go; the next call takes the next ones."""
    at = F.expr("timestampadd(DAY, -CAST(doc_id % 200 AS INT), TIMESTAMP_NTZ'2024-06-01 00:00:00')")
    snapshots = table(spark, d, "documents").select("doc_id", at.alias("fetched_at"), F.col("text").alias("raw"))
    kept = lifecycle.retention(snapshots, ntz("2024-06-01 00:00:00"), days=90, batch=25, key="doc_id")
    return kept.select("doc_id", F.sha2("raw", 256).alias("raw_hash"))


@query(
    "page_verdict",
    """WITH c AS (SELECT page_id, replace(lower(regexp_replace(html, '\\s+', ' ', 'g')), 'ß', 'ss') AS h,
        trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t FROM pages),
      v AS (SELECT page_id, h, """ + "replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')" + """ AS vis,
        replace(lower(replace(replace(t, '&quot;', '"'), '&amp;', '&')), 'ß', 'ss') AS tt FROM c),
      m AS (SELECT page_id, h, trim(regexp_replace(vis, '\\s+', ' ', 'g')) AS vis, CASE page_id % 3 WHEN 0 THEN tt WHEN 1 THEN 'no such title here' ELSE 'tion' END AS tt FROM v)
      SELECT page_id, CASE WHEN length(tt) >= 8 AND contains(vis, trim(regexp_replace(tt, '\\s+', ' ', 'g'))) THEN 'active' ELSE 'check_failed' END AS verdict,
        CASE WHEN length(tt) >= 8 AND contains(vis, trim(regexp_replace(tt, '\\s+', ' ', 'g'))) THEN 'job_title_present' ELSE 'job_content_not_recognized' END AS why FROM m""",
)
def page_verdict(spark, d):
    from vakanz.operators.pages import html_title

    m = F.col("page_id") % 3
    title = F.when(m == 0, html_title(F.col("html"))).when(m == 1, "No such title here").otherwise("tion")
    status, why = lifecycle.page_verdict(title, F.col("html"))
    return table(spark, d, "pages").select("page_id", status.alias("verdict"), why.alias("why"))


@query(
    "availability_split",
    ctes(POSTINGS, *LIFE_SQL)
    + """ SELECT job_id, CASE WHEN job_id % 17 = 0 THEN 'unverified' WHEN availability_status = 'inactive' THEN 'inactive'
      WHEN availability_status = 'check_failed' THEN 'unverified' ELSE 'eligible' END AS label FROM after_t""",
)
def availability_split(spark, d):
    rows = lifecycle.apply_availability(_life(spark, d), _checks(spark, d), ntz(_NOW))
    label = lifecycle.availability_split(F.col("availability_status"), F.col("job_id") % 17 != 0)
    return rows.select("job_id", label.alias("label"))


@query(
    "original_text",
    ctes(POSTINGS)
    + f""" SELECT job_id, md5(CASE WHEN job_id % 3 = 0 THEN {visible_sql("description_text")}
      ELSE description_text END) AS text_md5 FROM postings""",
)
def original_text(spark, d):
    p = postings(spark, d)
    raw = text.envelope(
        F.col("description_text"), F.lit("text"), F.lit(None).cast("string"), F.lit(None).cast("string")
    )
    snapshots = p.filter("job_id % 3 = 0").select(
        "job_id", F.col("created_at").alias("fetched_at"), F.col("job_id").alias("snapshot_id"), raw.alias("raw")
    )
    rows = lifecycle.original_text(p, snapshots)
    return rows.select("job_id", F.md5("original_text").alias("text_md5"))


@query(
    "failures_since_reset",
    """WITH r AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY user_id)
       SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error' AND (r.last IS NULL OR ts > r.last)) AS failures
       FROM events e JOIN r ON r.user_id = e.user_id GROUP BY e.user_id""",
)
def failures_since_reset(spark, d):
    return lifecycle.failures_since_reset(
        table(spark, d, "events"), "user_id", "ts",
        F.col("event_type") == "error", F.col("event_type") == "purchase",
    )

