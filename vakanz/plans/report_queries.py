"""Run ledger, target and source reports, applications and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.operators import applications as apps
from vakanz.operators import reports
from vakanz.plans.listing_queries import ntz
from vakanz.plans.registry import query
from vakanz.plans.views import (
    APPLICATIONS,
    POSTINGS,
    STATUS_LOG,
    applications,
    ctes,
    postings,
    quote,
    status_log,
    table,
)

# --- runs -----------------------------------------------------------------------------------

_OUT = {"view": "created", "signup": "updated", "click": "skipped", "purchase": "duplicate", "error": "error"}
_OUT_SQL = "CASE WHEN event_type = 'error' AND user_id % 7 = 3 THEN 'skipped' ELSE CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OUT.items()) + " END END"
LEDGER_SQL = f"""
outs AS (SELECT user_id % 40 AS run_id, {_OUT_SQL} AS outcome, event_id FROM events),
counted AS (SELECT run_id, count(*) AS discovered, count(*) FILTER (WHERE outcome IN ('created', 'updated', 'skipped')) AS fetched,
  count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'updated') AS updated,
  count(*) FILTER (WHERE outcome IN ('skipped', 'duplicate')) AS skipped,
  count(*) FILTER (WHERE outcome = 'error') + CASE WHEN run_id % 5 = 0 THEN 2 ELSE 0 END AS errors FROM outs GROUP BY run_id),
ledger AS (SELECT *, CASE WHEN errors = 0 THEN 'succeeded' WHEN fetched > 0 THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN errors = 0 THEN 'healthy' WHEN fetched > 0 THEN 'limited' ELSE 'error' END AS source_status FROM counted)
"""


def ledger(spark, d):
    e = table(spark, d, "events")
    outcomes = e.select((F.col("user_id") % 40).alias("run_id"), F.expr(_OUT_SQL).alias("outcome"))
    diagnostics = (
        outcomes.select("run_id").distinct().filter("run_id % 5 = 0")
        .withColumn("diagnostic_errors", F.lit(2))
        .withColumn("prepared_only", F.lit(False))
    )
    return reports.run_ledger(outcomes, ["run_id"], diagnostics)


_LEDGER_COLS = ("run_id", "discovered", "fetched", "created", "updated", "skipped", "errors", "status", "source_status")


@query("run_ledger", f"WITH {LEDGER_SQL} SELECT {', '.join(_LEDGER_COLS)} FROM ledger")
def run_ledger(spark, d):
    return ledger(spark, d).select(*_LEDGER_COLS)


@query(
    "batch_totals",
    f"""WITH {LEDGER_SQL} SELECT count(*) AS runs, CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(fetched) AS BIGINT) AS fetched,
     CAST(sum(created) AS BIGINT) AS created, CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(errors) AS BIGINT) AS errors FROM ledger""",
)
def batch_totals(spark, d):
    return reports.batch_totals(ledger(spark, d))


@query(
    "run_errors",
    """WITH e AS (SELECT user_id AS run_id, concat('error  ', CAST(event_id AS VARCHAR)) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
       FROM events WHERE event_type = 'error') SELECT run_id, string_agg(replace(m, '  ', ' '), ' | ' ORDER BY rn) AS error_message FROM e WHERE rn <= 5 GROUP BY run_id""",
)
def run_errors(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("run_id"), "event_id",
        F.concat(F.lit("error  "), F.col("event_id").cast("string")).alias("m"),
    )
    return reports.run_errors(e, ["run_id"], "event_id", "m")


@query(
    "overwide_queries",
    "SELECT l_shipmode AS query, n AS results FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 10000",
)
def overwide_queries(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("query"))
    return reports.overwide_queries(rows, "query")


# --- counts ---------------------------------------------------------------------------------

_SINCE = "2024-02-15 00:00:00"


@query(
    "added_last_day",
    ctes(POSTINGS)
    + f" SELECT source_id, count(*) AS job_count, count(*) FILTER (WHERE created_at >= TIMESTAMP '{_SINCE}') AS added_last_day FROM postings GROUP BY source_id",
)
def added_last_day(spark, d):
    return reports.count_with_recent(postings(spark, d), ["source_id"], "created_at", ntz(_SINCE))


@query("count_per_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_per_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "json_path_group",
    """SELECT CAST(props::JSON->>'$.k' AS VARCHAR) AS label, count(*) AS job_count,
       count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00') AS added_last_day FROM events GROUP BY 1""",
)
def json_path_group(spark, d):
    label = F.get_json_object("props", "$.k").alias("label")
    return reports.count_with_recent(
        table(spark, d, "events"), [label], "ts", ntz("2024-01-20 00:00:00")
    )


# --- targets --------------------------------------------------------------------------------

TREPORT_SQL = """
targets AS (SELECT s.s AS source_id, t.t AS n, concat('https://t', t.t, '.example.com/') AS target_url,
  CASE WHEN t.t % 10 = 9 THEN 'shared' ELSE concat('t', t.t) END AS target_label, CASE WHEN t.t % 2 = 0 THEN 'job_portal' ELSE 'company_site' END AS target_kind
  FROM (SELECT DISTINCT user_id % 3 AS s FROM events) s, (SELECT DISTINCT user_id % 30 AS t FROM events) t),
stored AS (SELECT user_id % 3 AS source_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN user_id % 10 = 9 THEN 'shared' ELSE concat('t', user_id % 25) END AS target_label,
  concat('https://t', user_id % 28, '.example.com/') AS target_url, ts AS created_at FROM events WHERE event_type = 'view'),
results AS (SELECT user_id % 3 AS source_id, concat('https://t', user_id % 20, '.example.com/') AS target_url, event_id AS run_id, ts AS run_at,
  event_id % 6 = 0 AS fallback, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'empty' WHEN 2 THEN 'insufficient' ELSE 'failed' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'boom' END AS error, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 50 AS BIGINT) END AS records_emitted,
  CAST(event_id % 7 AS BIGINT) AS documents_seen, CAST(event_id % 2 AS BIGINT) AS page_error_count FROM events WHERE event_type = 'click'),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_url ORDER BY run_id DESC, fallback) AS rn FROM results) WHERE rn = 1),
by_url AS (SELECT source_id, target_url, count(*) AS jobs, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-29 00:00:00') AS added FROM stored GROUP BY 1, 2),
by_label AS (SELECT source_id, target_label, count(*) AS jobs, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-29 00:00:00') AS added FROM stored WHERE target_label IS NOT NULL GROUP BY 1, 2)
"""


def report_targets(spark, d):
    """Every (source, number) pair that users reach: distinct pairs, widened inside the row."""
    numbers = table(spark, d, "events").select((F.col("user_id") % 30).alias("n")).distinct()
    rows = numbers.withColumn("source_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))
    n = F.col("n").cast("string")
    return rows.select(
        "source_id",
        F.concat(F.lit("https://t"), n, F.lit(".example.com/")).alias("target_url"),
        F.when(F.col("n") % 10 == 9, "shared").otherwise(F.concat(F.lit("t"), n)).alias("target_label"),
        F.when(F.col("n") % 2 == 0, "job_portal").otherwise("company_site").alias("target_kind"),
    )


def treport(spark, d):
    e = table(spark, d, "events")

    def url(n):
        return F.concat(F.lit("https://t"), (F.col("user_id") % n).cast("string"), F.lit(".example.com/"))

    stored = e.filter("event_type = 'view'").select(
        (F.col("user_id") % 3).alias("source_id"),
        F.when(F.col("event_id") % 4 == 0, None)
        .when(F.col("user_id") % 10 == 9, "shared")
        .otherwise(F.concat(F.lit("t"), (F.col("user_id") % 25).cast("string")))
        .alias("target_label"),
        url(28).alias("target_url"),
        F.col("ts").alias("created_at"),
    )
    m = F.col("event_id")
    results = e.filter("event_type = 'click'").select(
        (F.col("user_id") % 3).alias("source_id"),
        url(20).alias("target_url"),
        m.alias("run_id"),
        F.col("ts").alias("run_at"),
        (m % 6 == 0).alias("fallback"),
        F.when(m % 4 == 0, "completed").when(m % 4 == 1, "empty").when(m % 4 == 2, "insufficient")
        .otherwise("failed").alias("status"),
        F.when(m % 5 == 0, "boom").alias("error"),
        F.when(m % 3 != 0, m % 50).alias("records_emitted"),
        (m % 7).alias("documents_seen"),
        F.lit(0).alias("pages_rejected"),
        F.lit(0).alias("duplicates_skipped"),
        F.lit(0).alias("query_filtered"),
        (m % 2).alias("page_error_count"),
    )
    return reports.target_report(
        report_targets(spark, d), stored, results, ntz("2024-01-29 00:00:00")
    )


_TR = (
    "source_id", "target_label", "target_url", "target_kind", "last_crawled_at", "found_count",
    "stored_job_count", "added_last_day", "status", "documents_seen", "page_error_count",
)


@query(
    "target_report",
    f"""WITH {TREPORT_SQL}, joined AS (SELECT t.source_id, t.target_label, t.target_url, t.target_kind, n.run_at AS last_crawled_at, n.records_emitted,
      coalesce(l.jobs, u.jobs, 0) AS stored_job_count, coalesce(l.added, u.added, 0) AS added_last_day, n.status AS st, n.error IS NOT NULL OR coalesce(n.page_error_count, 0) > 0 AS bad,
      coalesce(n.documents_seen, 0) AS documents_seen, coalesce(n.page_error_count, 0) AS page_error_count
      FROM targets t LEFT JOIN newest n ON n.source_id = t.source_id AND n.target_url = t.target_url
      LEFT JOIN by_url u ON u.source_id = t.source_id AND u.target_url = t.target_url
      LEFT JOIN by_label l ON l.source_id = t.source_id AND l.target_label = t.target_label)
     SELECT source_id, target_label, target_url, target_kind, last_crawled_at, coalesce(records_emitted, stored_job_count) AS found_count, stored_job_count, added_last_day,
       CASE WHEN bad AND st = 'completed' THEN 'partial' WHEN bad AND st IN ('empty', 'insufficient') THEN 'failed' ELSE st END AS status, documents_seen, page_error_count FROM joined""",
)
def target_report(spark, d):
    return treport(spark, d).select(*_TR)


@query(
    "run_target_results",
    """WITH t AS (SELECT DISTINCT user_id % 4 AS source_id, concat('u', CAST(user_id % 12 AS VARCHAR)) AS target_url FROM events),
       r AS (SELECT event_id AS run_id, user_id % 4 AS source_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click', 'error')),
       own AS (SELECT source_id, run_id, false AS fallback, concat('u', CAST(user_id % 12 AS VARCHAR)) AS target_url, 'completed' AS status, NULL AS error FROM r WHERE event_type = 'view'),
       f AS (SELECT source_id, max(run_id) AS run_id, arg_max(user_id, run_id) AS user_id FROM r WHERE event_type = 'click' GROUP BY source_id)
       SELECT * FROM own UNION ALL SELECT f.source_id, run_id, true, t.target_url, CASE WHEN t.target_url = concat('u', CAST(f.user_id % 12 AS VARCHAR)) THEN 'failed' ELSE 'completed' END,
         CASE WHEN t.target_url = concat('u', CAST(f.user_id % 12 AS VARCHAR)) THEN 'boom' END FROM f JOIN t ON t.source_id = f.source_id""",
)
def run_target_results(spark, d):
    """A run lists its target, or starts all targets with one error, or starts too few."""
    e = table(spark, d, "events")
    url = F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string"))
    targets = e.select((F.col("user_id") % 4).alias("source_id"), url.alias("target_url")).distinct()
    targets = targets.withColumn("target_label", F.concat(F.lit("label "), "target_url"))
    listed = F.concat(
        F.lit('{"connector":{"target_results":[{"target":"'), url, F.lit('","status":"completed"}]}}')
    )
    started = F.concat(
        F.lit('{"connector":{"targets_started":12,"target_errors":[{"target":"'), url,
        F.lit('","error":"boom"}]}}'),
    )
    few = F.lit('{"connector":{"targets_started":1}}')
    kind = F.col("event_type")
    runs = e.filter(kind.isin("view", "click", "error")).select(
        (F.col("user_id") % 4).alias("source_id"), F.col("event_id").alias("run_id"),
        F.col("ts").alias("run_at"),
        F.when(kind == "view", listed).when(kind == "click", started).otherwise(few).alias("details"),
    )
    rows = reports.run_target_results(runs, targets)
    return rows.select("source_id", "run_id", "fallback", "target_url", "status", "error")


# --- sources --------------------------------------------------------------------------------

SOURCES_SQL = """
src AS (SELECT n_nationkey AS source_id, n_name AS name, n_regionkey AS cls, n_nationkey % 4 <> 0 AS enabled, n_nationkey % 5 <> 0 AS configured FROM nation),
jobs AS (SELECT s_nationkey % 20 AS source_id, s_suppkey, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 30 AS INT)) AS created_at FROM supplier),
counts AS (SELECT s.source_id, s.cls, s.enabled, count(j.s_suppkey) AS job_count, count(*) FILTER (WHERE j.created_at >= TIMESTAMP '2024-01-15') AS added_last_day
  FROM src s LEFT JOIN jobs j ON j.source_id = s.source_id GROUP BY ALL),
runs AS (SELECT o_custkey % 30 AS source_id, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'succeeded' END ELSE 'partial' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at FROM orders),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) AS rn FROM runs) WHERE rn = 1),
states AS (SELECT s.source_id, CASE WHEN NOT s.enabled THEN 'paused' WHEN NOT s.configured THEN 'pending' WHEN r.run_id IS NULL THEN 'pending'
  WHEN r.status = 'running' THEN CASE WHEN r.started_at IS NULL OR r.started_at < TIMESTAMP '1996-01-01' - INTERVAL 3 HOUR THEN 'error' ELSE 'running' END
  WHEN r.status = 'succeeded' THEN 'ready' WHEN r.status = 'partial' THEN 'limited' ELSE 'error' END AS state,
  CASE WHEN s.enabled AND s.configured THEN coalesce(r.finished_at, r.started_at) END AS last_run_at FROM src s LEFT JOIN newest r ON r.source_id = s.source_id)
"""


def sources(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("source_id"), F.col("n_regionkey").alias("cls"),
        (k % 4 != 0).alias("enabled"), (k % 5 != 0).alias("configured"),
    )


def source_counts(spark, d):
    jobs = table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 20).alias("source_id"),
        F.expr("timestampadd(DAY, CAST(s_suppkey % 30 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
    )
    return reports.source_counts(sources(spark, d), jobs, ntz("2024-01-15 00:00:00"))


def states(spark, d):
    o = table(spark, d, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 3 == 0, "running").otherwise("succeeded"))
        .otherwise("partial")
    )
    runs = o.select(
        (F.col("o_custkey") % 30).cast("int").alias("source_id"),
        F.col("o_orderkey").alias("run_id"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished_at"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    return reports.crawler_state(sources(spark, d), runs, ntz("1996-01-01 00:00:00"))


@query("source_counts", f"WITH {SOURCES_SQL} SELECT source_id, job_count, added_last_day FROM counts")
def source_counts_query(spark, d):
    return source_counts(spark, d).select("source_id", "job_count", "added_last_day")


@query("crawler_state", f"WITH {SOURCES_SQL} SELECT source_id, state, last_run_at FROM states")
def crawler_state(spark, d):
    return states(spark, d).select("source_id", "state", "last_run_at")


_RANK_SQL = "CASE state " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in fixed.STATE_RANK.items()) + " END"


@query(
    "source_health",
    f"""WITH {SOURCES_SQL} SELECT c.cls AS source_class, bool_or(c.enabled) AS active, bool_or(s.state = 'running') AS running,
     arg_max(s.state, {_RANK_SQL}) AS state, CAST(sum(c.job_count) AS BIGINT) AS job_count, CAST(sum(c.added_last_day) AS BIGINT) AS added_last_day, max(s.last_run_at) AS last_fetched_at
     FROM counts c JOIN states s ON s.source_id = c.source_id GROUP BY c.cls""",
)
def source_health(spark, d):
    per_source = source_counts(spark, d).join(
        states(spark, d).select("source_id", "state", "last_run_at"), "source_id"
    )
    return reports.class_health(
        per_source.select(
            F.col("cls").alias("source_class"), F.col("enabled").alias("active"),
            (F.col("state") == "running").alias("running"), "state", "job_count", "added_last_day",
            F.col("last_run_at").alias("last_fetched_at"),
        )
    )


@query(
    "source_status",
    f"""WITH {SOURCES_SQL} SELECT s.source_id, CASE WHEN NOT s.configured THEN 'prepared' WHEN NOT s.enabled THEN 'paused'
     WHEN s.source_id % 2 = 0 THEN CASE WHEN t.state IN ('running', 'ready', 'limited', 'error') THEN t.state ELSE 'unchecked' END
     WHEN t.state = 'error' THEN 'error' ELSE 'active' END AS shown_status,
     CASE WHEN s.source_id % 2 = 0 THEN t.state IN ('ready', 'running') ELSE s.enabled AND s.configured END AS active
     FROM src s JOIN states t ON t.source_id = s.source_id""",
)
def source_status(spark, d):
    rows = sources(spark, d).join(states(spark, d).select("source_id", "state"), "source_id")
    rows = rows.select(
        "source_id", "enabled", F.lit(True).alias("permitted"), (~F.col("configured")).alias("config_missing"),
        F.col("state").alias("status"),
        F.when(F.col("source_id") % 2 == 0, F.col("state")).alias("state"),
    )
    return reports.source_status(rows).select("source_id", "shown_status", "active")


# --- applications ---------------------------------------------------------------------------


@query("application_state", ctes(STATUS_LOG, APPLICATIONS) + " SELECT job_id, status, updated_at FROM applications")
def application_state(spark, d):
    return applications(spark, d)


@query(
    "status_first_times",
    ctes(STATUS_LOG)
    + " SELECT job_id, "
    + ", ".join(
        f"min(ts) FILTER (WHERE status = {quote(s)}) AS {c}" for s, c in fixed.STATUS_TIME_COLUMNS.items()
    )
    + " FROM status_log GROUP BY job_id",
)
def status_first_times(spark, d):
    return apps.status_first_times(status_log(spark, d))


@query(
    "feedback_from_status",
    ctes(STATUS_LOG)
    + """ SELECT job_id, ts, event_id, 'application_status' AS event_type, status AS value, CASE WHEN status = 'Merkliste' THEN 1 ELSE -1 END AS direction
      FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id), 'Neu') AS old FROM status_log)
      WHERE status IN ('Merkliste', 'Nicht passend') AND old <> status""",
)
def feedback_from_status(spark, d):
    log = status_log(spark, d).select("job_id", "event_id", "ts", "status")
    return apps.feedback_from_status(log)


@query(
    "rescore_needed",
    ctes(STATUS_LOG)
    + """ SELECT count(*) AS new_decisions, count(*) > 0 AS rescore_needed FROM status_log
      WHERE value IN ('Merkliste', 'Nicht passend') AND ts > TIMESTAMP '2024-01-25 00:00:00'""",
)
def rescore_needed(spark, d):
    return apps.rescore_needed(status_log(spark, d), ntz("2024-01-25 00:00:00"))


_STATUS_ROWS = ", ".join(f"({i}, {quote(s)})" for i, s in enumerate(fixed.STATUSES))


@query(
    "pipeline_board",
    ctes(STATUS_LOG, APPLICATIONS)
    + f""" SELECT CAST(s.pos AS INT) AS board_pos, s.status, a.job_id, a.updated_at FROM (VALUES {_STATUS_ROWS}) s(pos, status)
      LEFT JOIN applications a ON a.status = s.status""",
)
def pipeline_board(spark, d):
    return apps.pipeline_board(applications(spark, d)).select("board_pos", "status", "job_id", "updated_at")


@query(
    "revision_numbers",
    """WITH h AS (SELECT user_id, max(event_id % 5) AS hi FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY user_id)
       SELECT e.user_id, e.event_id, coalesce(h.hi, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS revision
       FROM events e LEFT JOIN h ON h.user_id = e.user_id WHERE event_type = 'click'""",
)
def revision_numbers(spark, d):
    e = table(spark, d, "events")
    existing = e.filter("event_type = 'view' AND user_id % 2 = 0").select(
        "user_id", (F.col("event_id") % 5).alias("revision")
    )
    drafts = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    rows = apps.revision_numbers(existing, drafts, "user_id", ["ts", "event_id"])
    return rows.select("user_id", "event_id", "revision")


@query(
    "promote_planned",
    ctes(STATUS_LOG, APPLICATIONS)
    + """, r AS (SELECT job_id, status, CASE WHEN job_id % 2 = 0 THEN updated_at END AS planned_at FROM applications WHERE job_id % 3 <> 0),
      dr AS (SELECT DISTINCT user_id AS job_id FROM events WHERE event_type = 'click' AND user_id % 5 <> 0)
      SELECT coalesce(r.job_id, dr.job_id) AS job_id, CASE WHEN dr.job_id IS NOT NULL AND (r.status IS NULL OR r.status IN ('Neu', 'Merkliste')) THEN 'Bewerbung geplant' ELSE r.status END AS status,
      CASE WHEN dr.job_id IS NOT NULL AND (r.status IS NULL OR r.status IN ('Neu', 'Merkliste')) THEN coalesce(planned_at, TIMESTAMP '2024-03-01') ELSE planned_at END AS planned_at
      FROM r FULL OUTER JOIN dr ON dr.job_id = r.job_id""",
)
def promote_planned(spark, d):
    a = applications(spark, d)
    records = a.filter("job_id % 3 <> 0").select(
        "job_id", "status", F.when(F.col("job_id") % 2 == 0, F.col("updated_at")).alias("planned_at")
    )
    drafted = table(spark, d, "events").filter("event_type = 'click' AND user_id % 5 <> 0").select(
        F.col("user_id").alias("job_id")
    )
    return apps.promote_planned(records, drafted, ntz("2024-03-01 00:00:00"))


# --- checks ---------------------------------------------------------------------------------


@query(
    "batch_completeness",
    """WITH asked AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0),
       got AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 35 = 0),
       c AS (SELECT id, count(*) AS n FROM got GROUP BY id)
       SELECT * FROM (SELECT coalesce(a.id, c.id) AS id, CASE WHEN a.id IS NULL THEN 'unknown' WHEN c.id IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS problem
       FROM asked a FULL OUTER JOIN c ON c.id = a.id) WHERE problem IS NOT NULL""",
)
def batch_completeness(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    got = o.filter("id % 4 <> 0").unionByName(o.filter("id % 35 = 0"))
    return apps.batch_completeness(o.filter("id % 3 <> 0"), got, "id")


@query(
    "evidence_subset",
    "SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AND c_custkey % 3 = 1 AS supported FROM customer",
)
def evidence_subset(spark, d):
    k = F.col("c_custkey")
    claimed = (
        F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b")))
        .when(k % 3 == 1, F.array(F.lit("b"), F.when(k % 4 == 0, "a").otherwise("z")))
        .otherwise(F.array().cast("array<string>"))
    )
    allowed = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, d, "customer").select(
        "c_custkey", apps.evidence_subset(claimed, allowed).alias("supported")
    )


@query(
    "result_violations",
    """SELECT p_partkey, 'p_brand:category' AS violation FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')
       UNION ALL SELECT p_partkey, 'p_size:range' FROM part WHERE p_size NOT BETWEEN 3 AND 40
       UNION ALL SELECT p_partkey, 'points:size' FROM part WHERE len(string_split(p_name, ' ')) NOT BETWEEN 3 AND 5
       UNION ALL SELECT p_partkey, 'note:blank' FROM part WHERE p_partkey % 9 = 0""",
)
def result_violations(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_size", F.split("p_name", " ").alias("points"),
        F.when(F.col("p_partkey") % 9 == 0, " ").otherwise("ok").alias("note"),
    )
    return apps.violations(
        rows, "p_partkey", required=["note"],
        allowed={"p_brand": ["Brand#11", "Brand#12", "Brand#13"]},
        bounds={"p_size": (3, 40)}, sizes={"points": (3, 5)},
    )


@query(
    "draft_review",
    """SELECT p_partkey, CAST(least(5, greatest(0, p_size / 8.0)) AS DOUBLE) AS relevance, CASE WHEN p_partkey % 3 = 0 AND p_size >= 32 AND p_partkey % 7 > 0 THEN 'reviewed' ELSE 'needs_revision' END AS status FROM part""",
)
def draft_review(spark, d):
    """Scores are bounded, and a draft is reviewed when all of them are high and nothing is open."""
    k, size = F.col("p_partkey"), (F.col("p_size") / 8).cast("string")
    score = apps.bounded(size, 0, 5)
    scores = F.struct(*[score.alias(n) for n in ("relevance", "evidence", "clarity", "motivation")])
    none = F.array().cast("array<string>")
    open_ = F.when(k % 7 == 0, F.array(F.col("p_brand"))).otherwise(none)
    decision = F.when(k % 3 == 0, "approve").otherwise("revise")
    return table(spark, d, "part").select(
        "p_partkey", score.alias("relevance"), apps.review_status(decision, scores, open_, none).alias("status"))


@query(
    "enriched_rows",
    """WITH n AS (SELECT doc_id, len(string_split(text, ' ')) AS pieces FROM documents WHERE text IS NOT NULL)
       SELECT doc_id, CASE WHEN pieces % 4 = 0 THEN 'other' ELSE 'short' END AS label, CASE WHEN pieces % 4 = 0 THEN 'label:category' END AS violation FROM n""",
)
def enriched_rows(spark, d):
    """Rows sent to an external function in batches; what it returns is checked before it is used."""
    from vakanz.sources import catalogue

    def label(frame):
        pieces = frame["text"].str.count(" ") + 1
        return frame[["doc_id"]].assign(label=["other" if n % 4 == 0 else "short" for n in pieces])

    docs = table(spark, d, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    made = catalogue.enrich(docs, label, "doc_id long, label string")
    wrong = apps.violations(made, "doc_id", required=["label"], allowed={"label": ["short", "long"]})
    return made.join(wrong, "doc_id", "left").select("doc_id", "label", "violation")


@query(
    "source_status_totals",
    f"""WITH {SOURCES_SQL}, shown AS (SELECT s.source_id % 2 = 0 AS crawler, CASE WHEN s.source_id % 2 = 0 THEN t.state IN ('ready', 'running') ELSE s.enabled AND s.configured END AS active
     FROM src s JOIN states t ON t.source_id = s.source_id)
     SELECT crawler, count(*) AS sources, count(*) FILTER (WHERE active) AS active FROM shown GROUP BY crawler""",
)
def source_status_totals(spark, d):
    rows = sources(spark, d).join(states(spark, d).select("source_id", "state"), "source_id")
    crawler = F.col("source_id") % 2 == 0
    rows = rows.select(
        "source_id", "enabled", F.lit(True).alias("permitted"), (~F.col("configured")).alias("config_missing"),
        F.when(F.col("state") == "error", "error").otherwise("ok").alias("status"), crawler.alias("crawler"),
        F.when(crawler, F.col("state")).alias("state"))
    return reports.status_totals(reports.source_status(rows), "crawler")


@query(
    "profile_facts",
    """WITH e AS (SELECT event_id, CAST(props::JSON->>'$.k' AS INT) AS k FROM events)
       SELECT event_id, 'profile.current_title' AS evidence_id, 'current_title' AS category, concat('T', k) AS value FROM e
       UNION ALL SELECT event_id, concat('profile.skill.', i), 'skill', concat('s', i, '-', k) FROM e, range(3) r(i)
       UNION ALL SELECT event_id, 'profile.experience.0', 'work_experience', concat('2020 · R', k) FROM e
       UNION ALL SELECT event_id, 'profile.experience.0.responsibility.1', 'responsibility', concat('task ', k) FROM e""",
)
def profile_facts(spark, d):
    k = F.get_json_object("props", "$.k")
    data = F.to_json(
        F.struct(
            F.concat(F.lit("T"), k).alias("current_title"),
            F.array(*[F.concat(F.lit(f"s{i}-"), k) for i in range(3)]).alias("skills"),
            F.array(
                F.struct(
                    F.lit("2020").alias("period"), F.concat(F.lit("R"), k).alias("role"),
                    F.lit(" ").alias("employer"),
                    F.array(F.lit(""), F.concat(F.lit("task "), k)).alias("responsibilities"),
                )
            ).alias("work_experience"),
        )
    )
    rows = table(spark, d, "events").select("event_id", data.alias("data"))
    return apps.profile_facts(rows, "event_id", "data")


@query(
    "safe_error",
    r"SELECT doc_id, substring(trim(regexp_replace(text, '[\s\x{0085}\x{00A0}\x{000B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), 1, 1000) AS message FROM documents",
)
def safe_error(spark, d):
    from vakanz.functions.text import error_text

    return table(spark, d, "documents").select("doc_id", error_text(F.col("text")).alias("message"))


