import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.operators import applications, learning, lifecycle, pages, profiles, reports, scoring, upsert
from vakanz.operators.common import global_row_number, lag_by_bucket
from vakanz.operators.rescore import process_rescore, score_all
from vakanz.sources.tables import VersionedTable, apply_upsert

# --- upsert -------------------------------------------------------------------------------

POSTING = "source_id int, external_id string, title string, description_text string"
HASHED = ("title", "description_text")


def test_upsert_sequence(spark, tmp_path):
    """A, A, B, A: created, same, updated, updated without a new snapshot."""
    store = VersionedTable(spark, str(tmp_path / "postings"))
    snapshots = str(tmp_path / "snapshots")
    seen = []
    for text in ("A", "A", "B", "A"):
        batch = spark.createDataFrame([(1, "x", "Office Manager", text)], POSTING)
        outcome = apply_upsert(
            store, snapshots, batch, keys=["source_id", "external_id"], hash_cols=HASHED,
            now=F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"), text_col="description_text",
        )
        seen.append((outcome.first().outcome, spark.read.parquet(snapshots).count()))
    assert seen == [("created", 1), ("skipped", 1), ("updated", 2), ("updated", 2)]
    assert store.read().count() == 1
    kinds = {r.change_kind for r in spark.read.parquet(snapshots).collect()}
    assert kinds == {"created", "changed"}


def test_upsert_is_idempotent_and_unique(spark):
    rows = [(i % 3, str(i), f"t{i}", "d") for i in range(50)]
    batch = spark.createDataFrame(rows + rows[:7], POSTING)
    current = batch.limit(0).withColumn("content_hash", F.lit("")).withColumn("last_seen_at", F.lit(0))
    none = current.select("source_id", "external_id", "content_hash")
    args = dict(keys=["source_id", "external_id"], hash_cols=HASHED, now=F.lit(1))
    first = upsert.upsert_versioned(current, none, batch, **args)
    assert first.current.count() == 50 == first.new_snapshots.count()
    again = upsert.upsert_versioned(first.current, first.new_snapshots, batch, **args)
    assert again.new_snapshots.count() == 0
    assert {r.outcome for r in again.outcomes.collect()} == {"skipped"}


# --- scores -------------------------------------------------------------------------------


def posting(spark, **values):
    base = dict(
        job_id=1, title="", description_text="", state=None, remote_type=None, employment_type=None,
        contract_type=None, language=None, structured_data="{}",
    )
    base.update(values)
    schema = "job_id long, " + ", ".join(f"{k} string" for k in base if k != "job_id")
    return spark.createDataFrame([tuple(base.values())], schema)


INPUTS = ("employment_type", "contract_type", "language", "remote_type")


def scored(spark, profile, **values):
    columns = {n: F.col(n) for n in INPUTS}
    df = scoring.evaluate(
        posting(spark, **values), "title", "description_text", columns, profile, "structured_data"
    )
    return df.first()


BODY = (
    "Direkte Unterstützung der Geschäftsführung, Terminmanagement und Kalender, Korrespondenz, "
    "Vorbereitung von Besprechungen mit Protokoll, Präsentationen in PowerPoint, Reiseplanung."
)


def test_relevance_and_fit(spark):
    profile = scoring.Profile(
        skills=("Organisation", "PowerPoint"), employment_types=("Vollzeit",),
        contract_types=("unbefristet",), languages=("Deutsch", "de"),
    )
    row = scored(
        spark, profile, title="Assistenz der Geschäftsführung", description_text=BODY,
        employment_type="Vollzeit", contract_type="unbefristet", language="de", remote_type="onsite",
        structured_data=json.dumps({"required_skills": ["Organisation", "PowerPoint"]}),
    )
    assert row.relevance >= 70 and row.fit >= 90
    assert [r.code for r in row.relevance_reasons][:6] == [g[0] for g in fixed.ROLE_GROUPS]


def test_tasks_beat_title(spark):
    none = scoring.Profile(has_preferences=False)
    tasks = scored(spark, none, title="Mitarbeiter", description_text=BODY).relevance
    title = scored(spark, none, title="Executive Assistant", description_text="Nichts").relevance
    assert tasks > title == 15.0


def test_extra_title_term_and_false_friend(spark):
    extra = scoring.Profile(role_terms=("Stabsmitarbeiter",))
    row = scored(spark, extra, title="Stabsmitarbeiter", description_text="x")
    assert [r.evidence for r in row.relevance_reasons if r.code == "role_title"] == [["stabsmitarbeiter"]]
    row = scored(spark, extra, title="Pflegeassistenz", description_text="Termine und Kalender")
    assert any(r.code == "unrelated_assistance" and r.points == -20 for r in row.relevance_reasons)
    assert row.relevance == 0.0


def test_missing_data_is_neutral(spark):
    row = scored(spark, scoring.Profile(has_preferences=False))
    assert row.fit == 50.0
    assert row.fit_reasons[-1].code == "insufficient_profile_data"
    row = scored(spark, scoring.Profile(min_salary=50000), remote_type="onsite")
    salary = [r for r in row.fit_reasons if r.code == "salary"][0]
    assert (salary.possible_points, salary.effect) == (0, "neutral")


def test_optional_dimensions(spark):
    profile = scoring.Profile(industries=("Energie",), company_sizes=("Mittelstand",), max_travel_percent=20)
    data = {"industry": "Energiewirtschaft", "company_size": ["mittelstand"], "travel_required": False}
    row = scored(spark, profile, structured_data=json.dumps(data))
    points = {r.code: (r.points, r.possible_points) for r in row.fit_reasons}
    assert (points["industry"], points["company_size"], points["travel"]) == ((10, 10), (5, 5), (5, 5))


def test_salary_and_commute_slopes(spark):
    profile = scoring.Profile(min_salary=50000, target_salary=60000, commute_penalty_minutes=60, max_commute_minutes=80)
    data = {"salary_max": "55000", "commute_minutes": 70}
    row = scored(spark, profile, structured_data=json.dumps(data))
    points = {r.code: r.points for r in row.fit_reasons}
    assert (points["salary"], points["commute"], points["work_mode"]) == (7.5, 5.0, 20.0)


# --- learning -----------------------------------------------------------------------------

NAMES = list(fixed.FEATURE_WEIGHTS)
FEATURES = "job_id long, " + ", ".join(f"{n} string" for n in NAMES)
SAME = ("hybrid", "vollzeit", "unbefristet", "berlin", "de", "energie", None, "assistenz")


def signal(spark, target, examples):
    targets = spark.createDataFrame([target], FEATURES)
    rows = spark.createDataFrame(examples, FEATURES + ", direction int")
    return learning.feedback_signal(targets, rows).first()


def test_one_match(spark):
    other = ("onsite", "teilzeit", "befristet", "hessen", "en", "bau", None, "lager")
    row = signal(spark, (1, *SAME), [(2, *SAME, 1), (3, *other, -1)])
    assert (row.considered, row.matched, row.positive) == (2, 1, 1)
    assert 0 < row.adjustment <= 10


@pytest.mark.parametrize("direction, expected", [(1, 10.0), (-1, -10.0)])
def test_cap(spark, direction, expected):
    row = signal(spark, (1, *SAME), [(i, *SAME, direction) for i in range(2, 22)])
    assert row.adjustment == expected and row.matched == 20


def test_own_decision_is_excluded(spark):
    row = signal(spark, (1, *SAME), [(1, *SAME, 1)])
    assert (row.adjustment, row.considered, row.matched) == (0.0, 0, 0)


def test_signal_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    values = [("a", "b", None), ("x", "y"), ("p", None), ("k", "l", "m"), ("de",), ("i", None), (None, "s"), ("r", "q")]
    pick = lambda i: (i, *[rng.choice(v) for v in values])
    targets = [pick(i) for i in range(40)]
    examples = [(*pick(i), rng.choice((1, -1))) for i in range(20, 80)]
    examples = [(*targets[e[0]], e[-1]) if e[0] < 40 else e for e in examples]
    got = {
        r.job_id: (r.adjustment, r.considered, r.matched, r.positive, r.negative)
        for r in learning.feedback_signal(
            spark.createDataFrame(targets, FEATURES),
            spark.createDataFrame(examples, FEATURES + ", direction int"),
        ).collect()
    }
    weights = list(fixed.FEATURE_WEIGHTS.values())
    for t in targets:
        total = pos = neg = seen = 0
        for e in examples:
            if e[0] == t[0]:
                continue
            seen += 1
            sim = sum(w for w, a, b in zip(weights, t[1:], e[1:-1]) if a is not None and a == b)
            if sim >= 20:
                total += e[-1] * 2 * sim
                pos, neg = pos + (e[-1] > 0), neg + (e[-1] < 0)
        want = scoring.half_up(max(-1000, min(1000, total)) / 100)
        assert got[t[0]] == (want, seen, pos + neg, pos, neg), t


def test_latest_decision_only(spark):
    rows = [
        (1, 5, "application_status", "Merkliste", datetime(2026, 1, 1)),
        (2, 5, "application_status", "Nicht passend", datetime(2026, 1, 2)),
        (3, 5, "note", "Merkliste", datetime(2026, 1, 3)),
        (4, 5, "application_status", "Beworben", datetime(2026, 1, 4)),
    ]
    events = spark.createDataFrame(rows, "event_id long, job_id long, event_type string, value string, created_at timestamp")
    assert [tuple(r) for r in learning.feedback_examples(events).collect()] == [(5, "Nicht passend", -1)]


# --- rescore ------------------------------------------------------------------------------


def test_rescore_is_atomic(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "scores"))
    postings = posting(spark, title="Executive Assistant", description_text=BODY)
    examples = spark.createDataFrame([], "job_id long, direction int")

    def build(profile):
        return score_all(
            postings, examples, profile, columns={n: F.col(n) for n in INPUTS},
            features=learning.feature_columns(F.col("structured_data")), structured="structured_data",
        )

    pending = {"status": "pending", "reason": "feedback_changed"}
    assert process_rescore(store, None, scoring.Profile(), build).status == "idle"
    assert process_rescore(store, {"status": "completed"}, scoring.Profile(), build).status == "idle"
    assert process_rescore(store, pending, None, build).status == "blocked"
    assert process_rescore(store, pending, scoring.Profile(has_preferences=False), build).status == "blocked"

    def broken(profile):
        return build(profile).withColumn("x", F.raise_error(F.lit("boom")))

    with pytest.raises(Exception):
        process_rescore(store, pending, scoring.Profile(), broken)
    assert store.read() is None
    done = process_rescore(store, pending, scoring.Profile(version=3, preference_version=4), build)
    assert (done.status, done.version) == ("completed", 1)
    row = store.read().first()
    assert (row.profile_version, row.preference_version) == (3, 4)
    assert row.fit_reasons[-1].code == "feedback_preference"


# --- lifecycle ----------------------------------------------------------------------------

LIFE = (
    "job_id long, is_active boolean, availability_status string, availability_failures int, "
    "availability_checked_at timestamp, availability_check_method string, availability_reason string, "
    "expires_at timestamp"
)
NOW = datetime(2026, 7, 22)


def test_availability_transitions(spark):
    old, fresh = datetime(2026, 7, 1), datetime(2026, 7, 21, 20)
    rows = [
        (1, True, "active", 2, old, "s", "r", datetime(2026, 7, 2)),
        (2, True, "active", 2, fresh, "s", "r", None),
        (3, True, "active", 1, old, "s", "r", None),
        (4, False, "inactive", 3, old, "s", "r", None),
        (5, True, "active", 1, old, "s", "r", None),
    ]
    checks = [(2, "inactive"), (3, "check_failed"), (4, "active"), (5, "inactive")]
    out = lifecycle.apply_availability(
        spark.createDataFrame(rows, LIFE),
        spark.createDataFrame(checks, "job_id long, check_status string")
        .withColumn("check_method", F.lit("http")).withColumn("check_reason", F.lit("x")),
        F.lit(NOW),
    )
    got = {r.job_id: (r.availability_status, r.is_active, r.availability_failures, r.transition) for r in out.collect()}
    assert got == {
        1: ("inactive", False, 0, "expired"),
        2: ("active", True, 2, "cached"),
        3: ("check_failed", True, 2, "checked"),
        4: ("active", True, 0, "checked"),
        5: ("inactive", False, 0, "checked"),
    }
    assert tuple(lifecycle.maintenance_counts(out).first()) == (4, 2, 1, 1)


def test_retention_and_candidates(spark):
    rows = [(1, datetime(2026, 4, 22), "a"), (2, datetime(2026, 4, 24), "b"), (3, datetime(2026, 1, 1), "c")]
    snaps = spark.createDataFrame(rows, "snapshot_id long, fetched_at timestamp, raw string")
    kept = lifecycle.retention(snaps, F.lit(NOW), days=90)
    assert {r.snapshot_id: r.raw for r in kept.collect()} == {1: None, 2: "b", 3: None}
    some = lifecycle.retention(snaps, F.lit(NOW), days=90, batch=1)
    assert {r.snapshot_id: r.raw for r in some.collect()} == {1: "a", 2: "b", 3: None}
    jobs = spark.createDataFrame(
        [(1, datetime(2026, 1, 1), None), (2, datetime(2026, 2, 1), "Merkliste"), (3, datetime(2026, 7, 20), "Merkliste")],
        "job_id long, last_seen_at timestamp, status string",
    )
    assert [r.job_id for r in lifecycle.check_candidates(jobs, F.lit(NOW), limit=1).collect()] == [2]


@pytest.mark.parametrize(
    "html, title, expected",
    [
        ("<p>Die Stelle ist nicht mehr verfügbar</p>", "Office Manager", ("inactive", "closed_page_marker")),
        ('<script>{"@type" : "JobPosting"}</script>', "x", ("active", "jobposting_structured_data")),
        ("<h1>Office &amp; Team Manager</h1>", "Office &amp; Team  Manager", ("active", "job_title_present")),
        ("<h1>Kurz</h1>", "Kurz", ("check_failed", "job_content_not_recognized")),
    ],
)
def test_page_verdict(spark, html, title, expected):
    status, why = lifecycle.page_verdict(F.col("t"), F.col("h"))
    assert tuple(spark.createDataFrame([(title, html)], "t string, h string").select(status, why).first()) == expected


# --- pages --------------------------------------------------------------------------------

LD = {
    "@context": "https://schema.org",
    "@graph": [
        {"@type": "Organization"},
        {
            "@type": "JobPosting",
            "title": "Executive Assistant",
            "url": "https://firma.example/karriere/ea?utm_source=x",
            "hiringOrganization": {"name": "Firma GmbH"},
            "identifier": {"value": "EA-42"},
            "jobLocationType": "TELECOMMUTE",
            "employmentType": ["FULL_TIME"],
            "datePosted": "2026-07-01",
            "description": "<p>Text</p>",
            "jobLocation": [{"address": {"postalCode": "70173", "addressLocality": "Stuttgart",
                                         "addressRegion": "Baden-Württemberg", "addressCountry": "DE"}}],
            "baseSalary": {"currency": "EUR", "value": {"minValue": 55000, "maxValue": 65000, "unitText": "YEAR"}},
        },
    ],
}


def page(spark, url, html, kind="company_site", **extra):
    row = {"url": url, "html": html, "target_url": "https://firma.example/", "target_kind": kind,
           "target_label": "Firma", **extra}
    return pages.page_to_posting(spark.createDataFrame([row])).first()


def test_json_ld_page(spark):
    html = f"<script type='application/ld+json'>{json.dumps(LD)}</script>"
    row = page(spark, "https://firma.example/karriere/ea", html)
    assert row.accepted and row.confidence == "high"
    assert row.canonical_url == "https://firma.example/karriere/ea"
    assert row.locations == ["70173 Stuttgart, Baden-Württemberg, DE"]
    assert row.salary == "55000-65000 EUR YEAR"
    assert row.provider_identifier == "EA-42" and row.company == "Firma GmbH"
    assert row.remote_basis == "json_ld_telecommute" and row.remote is True
    assert row.employment_types == ["FULL_TIME"]


def test_heuristic_page_and_rejections(spark):
    body = "<title>Office Manager</title><p>Deine Aufgaben: ... Wir bieten: ...</p>"
    row = page(spark, "https://firma.example/jobs/office-manager", body)
    assert row.accepted and row.confidence == "medium"
    assert not page(spark, "https://firma.example/about", "<title>About us</title>").accepted
    assert not page(spark, "https://firma.example/jobs/x", "<title>Careers</title>" + body[29:]).accepted
    assert not page(spark, "https://firma.example/", body, kind="job_portal").accepted


def test_match_targets_by_suffix(spark):
    rows = spark.createDataFrame([(1, "https://jobs.firma.example/x"), (2, "https://xfirma.example/")], "page_id long, url string")
    targets = spark.createDataFrame([(0, "https://www.firma.example/"), (1, "https://jobs.firma.example/")], "target_pos int, target_url string")
    found = pages.match_targets(rows, targets, page_key="page_id").collect()
    assert [(r.page_id, r.target_pos) for r in found] == [(1, 0)]


# --- reports ------------------------------------------------------------------------------


def test_run_ledger_status(spark):
    rows = [(1, "created"), (1, "duplicate"), (2, "created"), (2, "error"), (3, "error"), (4, "skipped")]
    outcomes = spark.createDataFrame(rows, "run_id long, outcome string")
    got = {r.run_id: (r.discovered, r.fetched, r.skipped, r.errors, r.status, r.source_status)
           for r in reports.run_ledger(outcomes, ["run_id"]).collect()}
    assert got == {
        1: (2, 1, 1, 0, "succeeded", "healthy"),
        2: (2, 1, 0, 1, "partial", "limited"),
        3: (1, 0, 0, 1, "failed", "error"),
        4: (1, 1, 1, 0, "succeeded", "healthy"),
    }


def test_parse_targets(spark):
    meta = {"firecrawl": {"targets": ["https://a.example/", {"url": "https://b.example/", "label": "B", "category": "job_portal"}, {"label": "none"}]}}
    sources = spark.createDataFrame([(1, json.dumps(meta))], "source_id int, metadata_json string")
    rows = reports.parse_targets(sources).orderBy("target_pos").collect()
    assert [(r.target_label, r.target_kind) for r in rows] == [("a.example", "company_site"), ("B", "job_portal")]


def test_crawler_state_stale(spark):
    sources = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, True), (4, True, False)],
                                    "source_id int, enabled boolean, configured boolean")
    runs = spark.createDataFrame(
        [(1, 9, "running", datetime(2026, 7, 21, 20)), (2, 8, "running", datetime(2026, 7, 21, 23)), (2, 7, "failed", NOW)],
        "source_id int, run_id int, status string, started_at timestamp",
    ).withColumn("finished_at", F.lit(None).cast("timestamp")).withColumn("created_at", F.col("started_at"))
    got = {r.source_id: r.state for r in reports.crawler_state(sources, runs, F.lit(NOW)).collect()}
    assert got == {1: "error", 2: "running", 3: "paused", 4: "pending"}


# --- applications and profiles ------------------------------------------------------------


def test_feedback_from_status(spark):
    log = [(i, 1, datetime(2026, 1, 1 + i), s) for i, s in enumerate(
        ["Merkliste", "Merkliste", "Nicht passend", "Beworben", "Merkliste"])]
    df = spark.createDataFrame(log, "event_id long, job_id long, ts timestamp, status string")
    rows = applications.feedback_from_status(df).orderBy("event_id").collect()
    assert [(r.event_id, r.direction) for r in rows] == [(0, 1), (2, -1), (4, 1)]


def test_review_status(spark):
    scores = F.create_map(*[F.lit(x) for n in ("relevance", "evidence", "clarity", "motivation") for x in (n, 4)])
    none = F.array().cast("array<string>")
    ok = applications.review_status(F.lit("approve"), scores, none, none)
    bad = applications.review_status(F.lit("approve"), scores, F.array(F.lit("fix")), none)
    assert tuple(spark.range(1).select(ok, bad).first()) == ("reviewed", "needs_revision")


CV = """JANE DOE
Kontakt:
E-Mail: Jane.Doe@example.com
Tel: +49 711 1234567
Berufserfahrung
Jan 2021 – heute Executive Assistant
03/2016 - 12/2020 Office Manager
Sprachen
Deutsch, Englisch
Kenntnisse
MS Office, SAP"""


def test_profile_text(spark):
    df = spark.createDataFrame([(1, CV)], "id int, text string")
    rows = profiles.text_sections(df, "id", "text").withColumn("name", profiles.heading_section(F.col("heading")))
    names = {(r.section_no, r.name) for r in rows.collect()}
    assert names == {(0, None), (1, "other"), (2, "experience"), (3, "languages"), (4, "skills")}
    assert tuple(profiles.contacts(df, "id", "text").first())[1:] == ("jane.doe@example.com", "+49 711 1234567")
    langs = df.select(profiles.term_mentions(F.col("text"), fixed.LANGUAGE_TERMS).alias("l")).first().l
    skills = df.select(profiles.term_mentions(F.col("text"), fixed.SKILL_TERMS).alias("l")).first().l
    assert langs == ["Deutsch", "Englisch"] and skills == ["Microsoft Office", "SAP"]
    spans = rows.filter("name = 'experience'").select(
        "id", profiles.period_interval(F.col("line"), F.lit(2025 * 12 + 11)).alias("p")
    ).select("id", "p.start", "p.end")
    assert tuple(profiles.interval_union(spans, "id", "start", "end").first()) == (1, 118, 9)


def test_taxonomy(spark):
    first, rest = profiles.taxonomy_split(F.array(F.lit("A"), F.lit("a"), F.lit("B")), F.array(F.lit("b"), F.lit("C")))
    row = spark.range(1).select(first.alias("f"), rest.alias("r"), profiles.taxonomy_issues(first, rest).alias("i")).first()
    assert (row.f, row.r, row.i) == (["A", "B"], ["C"], [])


# --- shared blocks ------------------------------------------------------------------------


def test_global_row_number(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    rows = global_row_number(df, [F.col("v")]).filter("row_no <> v")
    assert rows.count() == 0


def test_lag_by_bucket_equals_lag(spark):
    from pyspark.sql import Window

    df = spark.range(2000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 2000).alias("t"), F.col("id").alias("v")
    )
    ours = lag_by_bucket(df, ["k"], ["t"], F.floor(F.col("t") / 100), {"v": "p"}).select("k", "t", "p")
    plain = df.select("k", "t", F.lag("v").over(Window.partitionBy("k").orderBy("t")).alias("p"))
    assert ours.exceptAll(plain).count() == 0 == plain.exceptAll(ours).count()
