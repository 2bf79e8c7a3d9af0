"""The given tables seen as postings, scores, decisions, targets and runs.

Each view exists twice, as a DataFrame and as a SQL fragment, with the same rows. Time columns
stay zone-free as in the files, so results do not depend on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vakanz import fixed
from vakanz.operators.scoring import Group, Rubric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(column: str, values: tuple[str | None, ...]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None
    )
    return f"CASE {column} % {len(values)} {whens} END"


REMOTE = ("onsite", "hybrid", "remote", None)
EMPLOYMENT = ("Vollzeit", "Teilzeit", None)
CONTRACT = ("unbefristet", "befristet", "unbefristet", None, "Ausbildung")
STATE = ("Baden-Württemberg", "Bayern", "Berlin", "Hessen", "Sachsen", None)

# expressions that read the same in both dialects
_COMMON = f"""
  doc_id AS job_id,
  CAST(substring(source, 4) AS INT) AS source_id,
  CAST(doc_id AS STRING) AS external_id,
  source,
  concat('E', CAST(doc_id % 37 AS STRING)) AS employer,
  text AS description_text,
  lang AS language,
  {_cycle('doc_id', REMOTE)} AS remote_type,
  {_cycle('doc_id', EMPLOYMENT)} AS employment_type,
  {_cycle('doc_id', CONTRACT)} AS contract_type,
  {_cycle('doc_id', STATE)} AS state,
  doc_id % 11 <> 0 AS is_active,
  n_chars
"""
_STRUCTURED = (
    "concat('{\"salary_max\":', CAST(n_chars * 10 AS STRING), ',\"commute_minutes\":', "
    "CAST(doc_id % 120 AS STRING), ',\"travel_percent\":', CAST(doc_id % 101 AS STRING), "
    "',\"industry\":\"branch ', CAST(doc_id % 9 AS STRING), '\"}')"
)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(
        *[p.strip() for p in _split(_COMMON)],
        "trim(split_part(text, '\\n', 1)) AS title",
        "concat('Ort ', CAST(doc_id % 50 AS STRING)) AS location_text",
        f"{_STRUCTURED} AS structured_data",
        "timestampadd(HOUR, CAST(doc_id % 720 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS published_at",
        "timestampadd(DAY, CAST(doc_id % 60 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at",
    )


def _split(block: str) -> list[str]:
    """Split a select list at top-level commas."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(block):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and depth == 0 and not quoted:
            parts.append(block[start:i])
            start = i + 1
    return [*parts, block[start:]]


POSTINGS = f"""
postings AS (
  SELECT {_COMMON.strip()},
    trim(split_part(text, chr(10), 1)) AS title,
    concat('Ort ', CAST(doc_id % 50 AS STRING)) AS location_text,
    {_STRUCTURED} AS structured_data,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INT)) AS published_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 60 AS INT)) AS created_at
  FROM documents)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only scores: an event is a score of the posting with the user's number."""
    return table(spark, sf_dir, "events").selectExpr(*SCORE_COLUMNS)


SCORE_COLUMNS = (
    "event_id AS score_id",
    "user_id AS job_id",
    "ts AS created_at",
    "CAST((event_id * 37) % 1001 AS DOUBLE) / 10 AS relevance_score",
    "CAST((event_id * 53) % 1001 AS DOUBLE) / 10 AS candidate_fit_score",
    "CAST(event_id % 3 AS INT) AS profile_version",
    "CAST(event_id % 2 AS INT) AS preference_version",
)
SCORES = f"scores AS (SELECT {', '.join(SCORE_COLUMNS)} FROM events)"

EVENT_STATUS = {
    "view": fixed.NEW,
    "signup": fixed.SAVED,
    "click": fixed.PLANNED,
    "purchase": fixed.APPLIED,
    "error": fixed.NOT_SUITABLE,
}
_STATUS = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATUS.items()
) + " END"
LOG_COLUMNS = (
    "event_id", "user_id AS job_id", "ts", f"{_STATUS} AS status",
    "'application_status' AS event_type", f"{_STATUS} AS value",
)


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: an event sets the status of the posting with the user's number."""
    return table(spark, sf_dir, "events").selectExpr(*LOG_COLUMNS)


STATUS_LOG = f"status_log AS (SELECT {', '.join(LOG_COLUMNS)} FROM events)"
APPLICATIONS = """
applications AS (
  SELECT job_id, status, ts AS updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM status_log WHERE status IS NOT NULL) WHERE rn = 1)
"""
LATEST = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, score_id DESC) AS rn
    FROM scores) WHERE rn = 1)
"""
LISTED = """
listed AS (
  SELECT p.*, l.score_id, l.relevance_score, l.candidate_fit_score, a.status
  FROM postings p LEFT JOIN latest l ON l.job_id = p.job_id
  LEFT JOIN applications a ON a.job_id = p.job_id)
"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vakanz.operators.applications import application_state

    return application_state(status_log(spark, sf_dir))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vakanz.operators.listing import with_latest

    return with_latest(
        postings(spark, sf_dir), scores(spark, sf_dir), applications(spark, sf_dir)
    )


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


LISTING = (POSTINGS, SCORES, STATUS_LOG, APPLICATIONS, LATEST, LISTED)

# A rubric whose terms occur in the given texts.
TEXT_RUBRIC = Rubric(
    (
        Group("articles", "Articles", 25, ("der ", "die ", "the ", "les ", "los ")),
        Group("joins", "Conjunctions", 15, (" und ", " and ", " et ")),
        Group("links", "Prepositions", 15, (" for ", " with ", " pour ", " para ")),
        Group("nouns", "Noun endings", 12, ("heit", "keit", "tion", "ment")),
        Group("shapes", "Syllables", 10, ("onre", "thha", "eau", "sch")),
        Group("rare", "Rare words", 8, ("license", "copyright", "http", "@")),
    ),
    ("the", "der", "que"),
    ("worthless", "lorem"),
)


def norm_sql(column: str) -> str:
    """``normalize_text`` in SQL; the texts hold no white space beyond these classes."""
    return (
        f"trim(regexp_replace(replace(lower(coalesce({column}, '')), 'ß', 'ss'), "
        r"'[\s\x{00A0}\x{0085}\x{000B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
    )


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
