"""Scores, learning and rescoring over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz.operators import learning, rescore, scoring, upsert
from vakanz.operators.common import latest_per_key, open_array
from vakanz.plans.registry import query
from vakanz.plans.views import (
    LATEST,
    POSTINGS,
    SCORES,
    STATUS_LOG,
    TEXT_RUBRIC,
    ctes,
    norm_sql,
    postings,
    quote,
    scores,
    status_log,
    table,
)

_COUNTS = [
    " + ".join(f"CASE WHEN contains(body, {quote(t.strip())}) THEN 1 ELSE 0 END" for t in g.terms)
    for g in TEXT_RUBRIC.groups
]


def _points_sql(i: int, value) -> str:
    possible = TEXT_RUBRIC.groups[i].possible
    return f"CASE n{i} WHEN 0 THEN 0.0000 " + " ".join(
        f"WHEN {n} THEN {value(possible, n):.4f}" for n in (1, 2, 3)
    ) + f" ELSE {value(possible, 4):.4f} END"


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(t)})" for t in terms) + ")"


SCORED_SQL = (
    f"normal AS (SELECT job_id, {norm_sql('title')} AS tt, {norm_sql('description_text')} AS body FROM postings)",
    "counted AS (SELECT job_id, tt, body, "
    + ", ".join(f"{c} AS n{i}" for i, c in enumerate(_COUNTS))
    + " FROM normal)",
    "parts AS (SELECT *, "
    + ", ".join(f"CAST({_points_sql(i, scoring.group_points)} AS DECIMAL(9,4)) AS p{i}" for i in range(len(_COUNTS)))
    + f", CASE WHEN {_any('tt', TEXT_RUBRIC.title_terms)} THEN 15 ELSE 0 END AS pt"
    + f", CASE WHEN {_any('concat(tt, chr(32), body)', TEXT_RUBRIC.false_friends)} AND n0 = 0 THEN 20 ELSE 0 END AS pen"
    + " FROM counted)",
    "scored AS (SELECT *, CAST(round(greatest(0, least(100, pt - pen + "
    + " + ".join(f"p{i}" for i in range(len(_COUNTS)))
    + ")), 1) AS DOUBLE) AS relevance FROM parts)",
)


@query("rubric_score", ctes(POSTINGS, *SCORED_SQL) + " SELECT job_id, relevance FROM scored")
def rubric_score(spark, d):
    scored = scoring.rubric_score(
        postings(spark, d), "title", "description_text", TEXT_RUBRIC, reasons=None
    )
    return scored.select("job_id", "relevance")


@query(
    "rubric_top",
    ctes(POSTINGS, *SCORED_SQL)
    + " SELECT job_id, relevance FROM scored ORDER BY relevance DESC, job_id LIMIT 20",
)
def rubric_top(spark, d):
    """The 20 best postings: a top-k over one scan."""
    return rubric_score(spark, d).orderBy(F.desc("relevance"), "job_id").limit(20)


_REASONS = [
    f"SELECT job_id, '{g.code}' AS code, CASE WHEN n{i} > 0 THEN 'positive' ELSE 'neutral' END AS effect, "
    f"CAST({_points_sql(i, scoring.shown_points)} AS DOUBLE) AS points, CAST({g.possible} AS DOUBLE) AS possible_points, "
    f"CAST(least(5, n{i}) AS INT) AS shown FROM parts"
    for i, g in enumerate(TEXT_RUBRIC.groups)
]


@query(
    "rubric_reasons",
    ctes(POSTINGS, *SCORED_SQL)
    + " "
    + " UNION ALL ".join(_REASONS)
    + " UNION ALL SELECT job_id, 'role_title', CASE WHEN pt > 0 THEN 'positive' ELSE 'neutral' END, CAST(pt AS DOUBLE), 15.0, "
    "CAST((CASE WHEN contains(tt, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(tt, 'der') THEN 1 ELSE 0 END + CASE WHEN contains(tt, 'que') THEN 1 ELSE 0 END) AS INT) FROM parts"
    " UNION ALL SELECT job_id, 'unrelated_assistance', 'negative', -20.0, 0.0, "
    "CAST((CASE WHEN contains(concat(tt, ' ', body), 'worthless') THEN 1 ELSE 0 END + CASE WHEN contains(concat(tt, ' ', body), 'lorem') THEN 1 ELSE 0 END) AS INT) FROM parts WHERE pen > 0",
)
def rubric_reasons(spark, d):
    scored = scoring.rubric_score(postings(spark, d), "title", "description_text", TEXT_RUBRIC)
    rows = open_array(scored, ["job_id"], F.col("relevance_reasons"), "r")
    return rows.select(
        "job_id", "r.code", "r.effect", "r.points", "r.possible_points", F.size("r.evidence").alias("shown")
    )


PROFILE = scoring.Profile(
    skills=("Organisation", "PowerPoint"),
    employment_types=("Vollzeit",),
    contract_types=("unbefristet",),
    languages=("Deutsch", "de"),
    onsite_weight=0.75,
    hybrid_weight=1.0,
    remote_weight=0.35,
    commute_penalty_minutes=40,
    max_commute_minutes=80,
    min_salary=10000,
    target_salary=30000,
    industries=("branch 3", "branch 4"),
    max_travel_percent=30,
)
FIT_SQL = (
    """dims AS (SELECT job_id,
     CASE WHEN employment_type IS NOT NULL THEN 15.0 ELSE 0 END AS o_emp,
     CASE WHEN employment_type = 'Vollzeit' THEN 15.0 ELSE 0 END AS p_emp,
     CASE WHEN contract_type IS NOT NULL THEN 10.0 ELSE 0 END AS o_con,
     CASE WHEN contract_type IN ('unbefristet', 'befristet') THEN 10.0 ELSE 0 END AS p_con,
     10.0 AS o_lan, CASE WHEN language = 'de' THEN 10.0 ELSE 0 END AS p_lan,
     20.0 AS o_mod, 20 * CASE coalesce(remote_type, 'onsite') WHEN 'remote' THEN 0.35 WHEN 'hybrid' THEN 1.0 ELSE 0.75 END AS p_mod,
     CASE WHEN coalesce(remote_type, 'onsite') <> 'remote' THEN 10.0 ELSE 0 END AS o_com,
     CASE WHEN remote_type = 'remote' THEN 0 WHEN job_id % 120 <= 40 THEN 10.0 WHEN job_id % 120 >= 80 THEN 0
       ELSE CAST(80 - job_id % 120 AS DOUBLE) * 10 / 40 END AS p_com,
     10.0 AS o_sal, CASE WHEN n_chars * 10 >= 30000 THEN 10.0 WHEN n_chars * 10 >= 10000
       THEN 5 + CAST(n_chars * 10 - 10000 AS DOUBLE) * 5 / 20000 ELSE 0 END AS p_sal,
     10.0 AS o_ind, CASE WHEN job_id % 9 IN (3, 4) THEN 10.0 ELSE 0 END AS p_ind,
     5.0 AS o_tra, CASE WHEN job_id % 101 <= 30 THEN 5.0 ELSE 0 END AS p_tra
     FROM postings)""",
    """fitted AS (SELECT job_id, CAST(round(CAST(100 * (0.0::DOUBLE + p_emp + p_con + p_lan + p_mod + p_com + p_sal + p_ind + p_tra)
       / (0.0::DOUBLE + o_emp + o_con + o_lan + o_mod + o_com + o_sal + o_ind + o_tra) AS DECIMAL(12,6)), 1) AS DOUBLE) AS fit FROM dims)""",
)


@query("fit_score", ctes(POSTINGS, *FIT_SQL) + " SELECT job_id, fit FROM fitted")
def fit_score(spark, d):
    p = postings(spark, d)
    scored = scoring.fit_score(p, fit_inputs(), PROFILE, "structured_data", reasons=None)
    return scored.select("job_id", "fit")


def fit_inputs():
    return {n: F.col(n) for n in ("employment_type", "contract_type", "language", "remote_type")}


@query(
    "fit_dimensions",
    ctes(POSTINGS, *FIT_SQL)
    + """ SELECT job_id, 'employment_type' AS code, o_emp AS possible_points, p_emp AS points FROM dims WHERE o_emp > 0
      UNION ALL SELECT job_id, 'contract_type', o_con, p_con FROM dims WHERE o_con > 0
      UNION ALL SELECT job_id, 'language', o_lan, p_lan FROM dims
      UNION ALL SELECT job_id, 'work_mode', o_mod, round(p_mod, 1) FROM dims
      UNION ALL SELECT job_id, 'commute', o_com, round(p_com, 1) FROM dims
      UNION ALL SELECT job_id, 'salary', o_sal, round(p_sal, 1) FROM dims
      UNION ALL SELECT job_id, 'industry', o_ind, p_ind FROM dims
      UNION ALL SELECT job_id, 'travel', o_tra, p_tra FROM dims
      UNION ALL SELECT job_id, 'skills', 0, 0 FROM dims""",
)
def fit_dimensions(spark, d):
    scored = scoring.fit_score(postings(spark, d), fit_inputs(), PROFILE, "structured_data")
    rows = open_array(scored, ["job_id"], F.col("fit_reasons"), "r")
    return rows.select("job_id", "r.code", "r.possible_points", "r.points")


# --- learning -------------------------------------------------------------------------------

_FEATURES = (
    "remote_type", "employment_type", "contract_type", "state", "language", "industry",
    "company_size", "role_family",
)
FEATURES_SQL = (
    """feats AS (SELECT job_id, lower(remote_type) AS remote_type, lower(employment_type) AS employment_type,
       lower(contract_type) AS contract_type, lower(state) AS state, lower(language) AS language,
       concat('branch ', CAST(job_id % 9 AS VARCHAR)) AS industry, CAST(NULL AS VARCHAR) AS company_size,
       CAST(NULL AS VARCHAR) AS role_family FROM postings)""",
)
EXAMPLES_SQL = (
    """examples AS (SELECT f.*, CASE WHEN l.quality = 1 THEN 1 ELSE -1 END AS direction
       FROM labels l JOIN feats f ON f.job_id = l.doc_id)""",
)
_WEIGHT = {
    "remote_type": 25, "employment_type": 20, "contract_type": 15, "state": 10, "language": 5,
    "industry": 10, "company_size": 5, "role_family": 10,
}
_SIM = " + ".join(f"CASE WHEN t.{f} = e.{f} THEN {w} ELSE 0 END" for f, w in _WEIGHT.items())
PAIRS_SQL = (
    f"pairs AS (SELECT t.job_id, e.job_id AS example_id, e.direction, {_SIM} AS sim FROM feats t JOIN examples e ON e.job_id <> t.job_id)",
    """signal AS (SELECT job_id, CAST(round(CAST(greatest(-10, least(10, coalesce(sum(CASE WHEN sim >= 20 THEN
         direction * 2 * sim END), 0) / 100.0)) AS DECIMAL(12,4)), 1) AS DOUBLE) AS adjustment,
       count(*) AS considered, count(*) FILTER (WHERE sim >= 20) AS matched,
       count(*) FILTER (WHERE sim >= 20 AND direction > 0) AS positive,
       count(*) FILTER (WHERE sim >= 20 AND direction < 0) AS negative
       FROM pairs GROUP BY job_id)""",
)


def targets(spark, d):
    p = postings(spark, d)
    features = learning.feature_columns(F.col("structured_data"))
    return p.select("job_id", *[c.alias(n) for n, c in features.items()])


def decided(spark, d):
    """Labels as decisions: good quality was kept, the rest was rejected."""
    direction = F.when(F.col("quality") == 1, 1).otherwise(-1)
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("job_id"), direction.alias("direction"))
    return targets(spark, d).join(rows, "job_id")


@query(
    "feedback_examples",
    ctes(STATUS_LOG)
    + """ SELECT job_id, decision, CASE WHEN decision = 'Merkliste' THEN 1 ELSE -1 END AS direction FROM (
      SELECT job_id, value AS decision, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM status_log WHERE value IN ('Merkliste', 'Nicht passend')) WHERE rn = 1""",
)
def feedback_examples(spark, d):
    return learning.feedback_examples(status_log(spark, d), newest=("ts", "event_id"))


@query(
    "feedback_signal",
    ctes(POSTINGS, *FEATURES_SQL, *EXAMPLES_SQL, *PAIRS_SQL)
    + " SELECT job_id, adjustment, considered, matched, positive, negative FROM signal",
)
def feedback_signal(spark, d):
    return learning.feedback_signal(targets(spark, d), decided(spark, d))


@query(
    "feedback_evidence",
    ctes(POSTINGS, *FEATURES_SQL, *EXAMPLES_SQL, *PAIRS_SQL)
    + """ SELECT job_id, CAST(rn AS INT) AS position, example_id, direction, sim AS similarity,
      CAST(round(CAST(direction * 2 * sim / 100.0 AS DECIMAL(12,4)), 2) AS DOUBLE) AS points FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sim DESC, example_id) AS rn FROM pairs WHERE sim >= 20)
      WHERE rn <= 8""",
)
def feedback_evidence(spark, d):
    return learning.feedback_evidence(targets(spark, d), decided(spark, d))


ADJUSTED_SQL = (
    """adjusted AS (SELECT f.job_id, f.fit, s.adjustment,
      CAST(round(CAST(greatest(0, least(100, CAST(f.fit AS DECIMAL(9,2)) + CAST(coalesce(s.adjustment, 0) AS DECIMAL(9,2)))) AS DECIMAL(9,2)), 1) AS DOUBLE) AS adjusted_fit
      FROM fitted f LEFT JOIN signal s ON s.job_id = f.job_id)""",
)


@query(
    "adjusted_score",
    ctes(POSTINGS, *FIT_SQL, *FEATURES_SQL, *EXAMPLES_SQL, *PAIRS_SQL, *ADJUSTED_SQL)
    + """ SELECT job_id, fit, adjustment, adjusted_fit,
      CAST(round(CAST(adjusted_fit AS DECIMAL(9,2)) - CAST(fit AS DECIMAL(9,2)), 1) AS DOUBLE) AS applied_adjustment FROM adjusted""",
)
def adjusted_score(spark, d):
    scored = fit_score(spark, d)
    rows = learning.adjusted_score(scored, feedback_signal(spark, d))
    return rows.select("job_id", "fit", "adjustment", "adjusted_fit", "applied_adjustment")


@query(
    "rescore_all",
    ctes(POSTINGS, *SCORED_SQL, *FIT_SQL, *FEATURES_SQL, *EXAMPLES_SQL, *PAIRS_SQL, *ADJUSTED_SQL)
    + """ SELECT a.job_id, s.relevance, a.adjusted_fit AS candidate_fit, 1 AS profile_version, 1 AS preference_version
      FROM adjusted a JOIN scored s ON s.job_id = a.job_id""",
)
def rescore_all(spark, d):
    p = postings(spark, d)
    labels = table(spark, d, "labels")
    direction = F.when(F.col("quality") == 1, 1).otherwise(-1)
    result = rescore.score_all(
        p,
        labels.select(F.col("doc_id").alias("job_id"), direction.alias("direction")),
        PROFILE,
        columns=fit_inputs(),
        structured="structured_data",
        features=learning.feature_columns(F.col("structured_data")),
        rubric=TEXT_RUBRIC,
        reasons=False,
    )
    return result.select(
        "job_id", "relevance", F.col("adjusted_fit").alias("candidate_fit"),
        "profile_version", "preference_version",
    )


@query(
    "scores_due",
    ctes(POSTINGS, SCORES, LATEST)
    + """ SELECT job_id, due_reason FROM (SELECT p.job_id, CASE WHEN l.job_id IS NULL THEN 'never_scored'
      WHEN p.n_chars % 5 = 0 THEN 'content_changed' WHEN l.profile_version IS DISTINCT FROM 2 THEN 'profile_changed'
      WHEN l.preference_version IS DISTINCT FROM 1 THEN 'preferences_changed' END AS due_reason
      FROM postings p LEFT JOIN latest l ON l.job_id = p.job_id) WHERE due_reason IS NOT NULL""",
)
def scores_due(spark, d):
    latest = latest_per_key(scores(spark, d), ["job_id"], ["created_at", "score_id"])
    due = upsert.scores_due(
        postings(spark, d), latest, key="job_id", profile_version=F.lit(2),
        preference_version=F.lit(1), changed=F.col("n_chars") % 5 == 0,
    )
    return due.select("job_id", "due_reason")


@query(
    "current_profile",
    """SELECT owner, profile_id FROM (SELECT c_nationkey AS owner, c_custkey AS profile_id, row_number() OVER (
       PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC, c_custkey DESC) AS rn FROM customer
       WHERE c_custkey % 3 <> 0) WHERE rn = 1""",
)
def current_profile(spark, d):
    from vakanz.operators.profiles import current_profile as pick

    profiles = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("owner"),
        F.col("c_custkey").alias("profile_id"),
        F.floor(F.col("c_acctbal") / 100).alias("updated_at"),
        (F.col("c_custkey") % 3 != 0).alias("is_confirmed"),
    )
    return pick(profiles, "owner").select("owner", "profile_id")


_FIT_POSTINGS = """SELECT p_partkey AS job_id, split(p_name, ' ') AS skills, array(p_brand) AS company_size,
  split(p_type, ' ') AS industry, CASE p_size % 3 WHEN 0 THEN array('Vollzeit') WHEN 1 THEN array('Teilzeit') END AS employment_type,
  CAST(array() AS ARRAY<STRING>) AS contract_type, CASE WHEN p_size % 7 > 0 THEN array('de') END AS language FROM {part}"""
_FIT_PROFILES = """SELECT c_custkey AS profile_id, concat(split(p_name, ' '), CASE WHEN c_custkey % 4 = 0 THEN array(' Excel', '') ELSE array('excel') END) AS skills,
  CASE WHEN c_custkey % 5 > 0 THEN array(lower(p_brand), 'Brand#11') END AS company_size, split(p_type, ' ') AS industry,
  CASE WHEN c_custkey % 2 = 0 THEN array('vollzeit') ELSE array('Teilzeit', 'Minijob') END AS employment_type,
  array('befristet') AS contract_type, CASE WHEN c_custkey % 3 > 0 THEN array('DE', 'en') ELSE array('fr') END AS language
  FROM {customer} JOIN {part} ON p_partkey = c_custkey"""


@query(
    "fit_topk",
    """WITH j AS (SELECT p_partkey AS job_id, list_distinct(string_split(lower(p_name), ' ')) AS sk, [lower(p_brand)] AS co, list_distinct(string_split(lower(p_type), ' ')) AS ind,
         CASE p_size % 3 WHEN 0 THEN ['vollzeit'] WHEN 1 THEN ['teilzeit'] ELSE [] END AS em, CASE WHEN p_size % 7 > 0 THEN ['de'] ELSE [] END AS la FROM part),
       p AS (SELECT c_custkey AS profile_id, list_append(string_split(lower(p_name), ' '), 'excel') AS sk, CASE WHEN c_custkey % 5 > 0 THEN [lower(p_brand), 'brand#11'] ELSE [] END AS co,
         string_split(lower(p_type), ' ') AS ind, CASE WHEN c_custkey % 2 = 0 THEN ['vollzeit'] ELSE ['teilzeit', 'minijob'] END AS em,
         CASE WHEN c_custkey % 3 > 0 THEN ['de', 'en'] ELSE ['fr'] END AS la FROM customer JOIN part ON p_partkey = c_custkey),
       s AS (SELECT profile_id, job_id, 35.0 * len(list_filter(j.sk, lambda x: list_contains(p.sk, x))) / len(j.sk) + CASE WHEN list_has_any(j.co, p.co) THEN 5 ELSE 0 END
           + CASE WHEN list_has_any(j.ind, p.ind) THEN 10 ELSE 0 END + CASE WHEN list_has_any(j.em, p.em) THEN 15 ELSE 0 END + CASE WHEN list_has_any(j.la, p.la) THEN 10 ELSE 0 END AS earned,
         35 + CASE WHEN len(p.co) > 0 THEN 5 ELSE 0 END + 10 + CASE WHEN len(j.em) > 0 THEN 15 ELSE 0 END + CASE WHEN len(j.la) > 0 THEN 10 ELSE 0 END AS possible FROM j, p),
       f AS (SELECT profile_id, job_id, floor(round(100.0 * earned / possible, 6) * 10 + 0.5) / 10 AS fit FROM s)
       SELECT profile_id, job_id, CAST(fit AS DOUBLE) AS fit, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY fit DESC, job_id) AS INT) AS position FROM f
       QUALIFY position <= 5""",
)
def fit_topk(spark, d):
    """The five best postings of every profile; postings from parts, profiles from customers."""
    from vakanz.operators import matching

    part, customer = table(spark, d, "part"), table(spark, d, "customer")
    return matching.fit_topk(
        spark.sql(_FIT_POSTINGS, part=part), spark.sql(_FIT_PROFILES, part=part, customer=customer), 5)
