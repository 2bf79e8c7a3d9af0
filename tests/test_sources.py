import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vakanz.operators import profiles, scoring
from vakanz.sources import catalogue, landing
from vakanz.sources import specs  # noqa: F401
from vakanz.sources.landing import SPECS, normalize_payload, to_posting
from vakanz.sources.tables import VersionedTable
from vakanz.streaming import jobs

TARGET = "struct<company:string,base_url:string,tenant:string,language:string>"


def run(spark, provider, payload, company=None, base_url=None, tenant=None, language="de"):
    body = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    df = spark.createDataFrame(
        [(body, (company, base_url, tenant, language))], f"payload string, target {TARGET}"
    )
    valid, rejected = normalize_payload(df, SPECS[provider])
    return valid.collect(), rejected.count()


def test_greenhouse(spark):
    job = {
        "id": 42, "title": "Executive Assistant", "location": {"name": "Stuttgart / Remote"},
        "content": "<p>Support the CEO</p>", "absolute_url": "https://boards.greenhouse.io/acme/jobs/42",
        "updated_at": "2026-07-15T11:00:00Z", "metadata": [{"name": "Employment Type", "value": "Full-time"}],
        "offices": [{"name": "Stuttgart / Remote"}, {"location": "Ulm"}],
    }
    rows, rejected = run(spark, "greenhouse", {"jobs": [job, {"id": 1}]}, company="Acme GmbH")
    row = rows[0]
    assert (row.source_job_id, row.company, row.employment_types, row.remote) == ("42", "Acme GmbH", ["Full-time"], True)
    assert row.locations == ["Stuttgart / Remote", "Ulm"] and rejected == 1
    assert row.updated_at == datetime(2026, 7, 15, 11)


def test_lever(spark):
    job = {
        "id": "lever-1", "text": "Executive Assistant 1",
        "categories": {"location": "Karlsruhe", "commitment": "Full-time", "department": "Operations"},
        "descriptionPlain": "Support management", "hostedUrl": "https://jobs.lever.co/acme/1",
        "createdAt": 1784116800000, "workplaceType": "hybrid",
        "salaryRange": {"min": 1, "max": 2, "currency": "EUR", "interval": "per-year"},
    }
    for payload in ([job], {"data": [job]}):
        row = run(spark, "lever", payload)[0][0]
        assert (row.locations, row.employment_types, row.remote) == (["Karlsruhe"], ["Full-time"], None)
        assert (row.description_format, row.salary) == ("text", "1–2 EUR per-year")
        assert row.apply_url == "https://jobs.lever.co/acme/1"
        assert row.metadata == {"department": "Operations", "workplace_type": "hybrid"}


def test_ashby(spark):
    job = {
        "title": "Assistenz der Geschäftsführung", "employmentType": "FullTime", "location": "Mannheim",
        "secondaryLocations": [{"name": "Heidelberg"}], "isRemote": False, "descriptionPlain": "x",
        "jobUrl": "https://jobs.ashbyhq.com/acme/ashby-1",
        "compensation": {"scrapeableCompensationSalarySummary": "50.000–60.000 EUR"},
    }
    row = run(spark, "ashby", {"jobs": [job]})[0][0]
    assert (row.source_job_id, row.locations, row.remote) == ("ashby-1", ["Mannheim", "Heidelberg"], False)
    assert row.salary == "50.000–60.000 EUR"


def test_smartrecruiters(spark):
    job = {
        "id": "sr-1", "name": "Executive Assistant", "company": {"name": "Acme GmbH"},
        "location": {"fullLocation": "Stuttgart, Baden-Württemberg, de", "country": "de", "remote": False, "hybrid": True},
        "typeOfEmployment": {"label": "Full-time"},
        "jobAd": {"sections": {"jobDescription": {"title": "Job Description", "text": "<p>Support the CEO</p>"}}},
    }
    row = run(spark, "smartrecruiters", {"content": [job]}, tenant="acme")[0][0]
    assert row.metadata["remote_type"] == "hybrid" and row.company == "Acme GmbH"
    assert row.description == "<h2>Job Description</h2><p>Support the CEO</p>"
    assert row.canonical_url == "https://jobs.smartrecruiters.com/acme/sr-1"


PERSONIO = """<?xml version="1.0"?><workzag-jobs><position><id>personio-1</id>
<subcompany>Beispiel GmbH</subcompany><office>Stuttgart</office>
<additionalOffices><office>Remote</office></additionalOffices><name>Vorstandsassistenz</name>
<jobDescriptions><jobDescription><name>Aufgaben</name><value><![CDATA[<p>Unterstützung</p>]]></value></jobDescription></jobDescriptions>
<employmentType>permanent</employmentType><schedule>full-time</schedule><createdAt>2026-07-20T09:00:00Z</createdAt>
</position></workzag-jobs>"""


def test_personio(spark):
    row = run(spark, "personio", PERSONIO, base_url="https://beispiel.jobs.personio.de")[0][0]
    assert (row.source_job_id, row.title, row.company) == ("personio-1", "Vorstandsassistenz", "Beispiel GmbH")
    assert row.locations == ["Stuttgart", "Remote"] and row.remote is True
    assert row.employment_types == ["permanent", "full-time"]
    assert row.description == "<h2>Aufgaben</h2><p>Unterstützung</p>"
    assert row.canonical_url == "https://beispiel.jobs.personio.de/job/personio-1?language=de"


RSS = """<rss xmlns:content="x"><channel><title>Firma</title><item><title>Office &amp; Team</title>
<link>https://jobs.firma.example/jobs/77-office</link><content:encoded><![CDATA[<p>Hi</p>]]></content:encoded>
<location>Ulm</location><pubDate>Wed, 22 Jul 2026 10:00:00 +0200</pubDate></item></channel></rss>"""


def test_teamtailor(spark):
    row = run(spark, "teamtailor", RSS, company="Firma")[0][0]
    assert (row.source_job_id, row.title, row.locations) == ("77-office", "Office & Team", ["Ulm"])
    assert row.published_at == datetime(2026, 7, 22, 8) and row.description == "<p>Hi</p>"


def test_arbeitnow_jobicy_remotive(spark):
    job = {"slug": "new-1", "title": "A", "remote": False, "job_types": ["full-time"], "location": "Stuttgart", "created_at": 1784505600}
    row = run(spark, "arbeitnow", {"data": [job]})[0][0]
    assert (row.locations, row.metadata["country"], row.published_at) == (["Stuttgart"], "DE", datetime(2026, 7, 20))
    jobs_ = [
        {"id": 1, "jobTitle": "EA", "jobGeo": "Europe", "salaryMin": 55000, "salaryMax": 65000, "salaryCurrency": "EUR", "salaryPeriod": "year"},
        {"id": 2, "jobTitle": "US", "jobGeo": "USA only"},
    ]
    rows, _ = run(spark, "jobicy", {"jobs": jobs_})
    assert [(r.source_job_id, r.salary) for r in rows] == [("1", "55000–65000 EUR year")]
    rows, _ = run(spark, "remotive", {"jobs": [
        {"id": 10, "title": "Chief of Staff", "candidate_required_location": "Worldwide"},
        {"id": 11, "title": "US only", "candidate_required_location": "USA"}]})
    assert [(r.source_job_id, r.remote) for r in rows] == [("10", True)]


def test_enterprise(spark):
    row = run(spark, "successfactors", {"searchResults": {"jobs": [
        {"jobId": "sf-1", "jobTitle": "EA", "jobUrl": "/job/sf-1", "location": "Stuttgart"}]}}, base_url="https://jobs.acme.example")[0][0]
    assert (row.source_job_id, row.canonical_url) == ("sf-1", "https://jobs.acme.example/job/sf-1")
    row = run(spark, "workday", {"jobPostings": [
        {"title": "EA", "externalPath": "/job/Stuttgart/Executive-Assistant_WD-1", "bulletFields": ["Vollzeit", "WD-1"]}]},
        base_url="https://acme.wd5.myworkdayjobs.com/de-DE", tenant="External")[0][0]
    assert row.source_job_id == "Executive-Assistant_WD-1"
    assert row.canonical_url.endswith("/External/job/Stuttgart/Executive-Assistant_WD-1")
    row = run(spark, "workable", {"jobs": [
        {"shortcode": "WB-1", "title": "EA", "location": {"city": "Stuttgart", "country": "Germany"}, "remote": False}]}, tenant="acme")[0][0]
    assert (row.canonical_url, row.locations, row.remote) == ("https://apply.workable.com/acme/j/WB-1/", ["Stuttgart, Germany"], False)
    row = run(spark, "recruitee", {"offers": [{"id": 7, "title": "EA", "slug": "ea", "careers_url": "https://evil.example/x"}]}, base_url="https://acme.recruitee.com")[0][0]
    assert row.canonical_url == "https://acme.recruitee.com/o/ea"
    row = run(spark, "oracle", {"items": [{"requisitionList": [{"Id": "3", "Title": "EA", "PrimaryLocation": "Ulm", "WorkplaceType": "Home Office"}]}]}, base_url="https://a.oraclecloud.com")[0][0]
    assert (row.source_job_id, row.remote, row.locations) == ("3", True, ["Ulm"])
    row = run(spark, "phenom", {"refineSearch": {"hits": {"hits": [{"_source": {"jobId": "P", "title": "EA", "city": "Ulm", "country": "DE"}}]}}}, base_url="https://careers.a.example")[0][0]
    assert (row.source_job_id, row.locations) == ("P", ["Ulm, DE"])
    row = run(spark, "tkms", {"jobs": [{"data": {"id": "9", "title": "EA", "remote": "Hybrid"}}]}, language="de")[0][0]
    assert (row.source_job_id, row.remote, row.canonical_url) == ("9", True, "https://jobs.tkmsgroup.com/de/job/9")
    row = run(spark, "join", {"props": {"pageProps": {"initialState": {"jobs": {"items": [
        {"id": "join-1", "idParam": "join-1-x", "title": "V", "city": {"cityName": "Stuttgart", "countryName": "Deutschland"}, "workplaceType": "remote"}]}}}}},
        company="Acme GmbH", tenant="acme")[0][0]
    assert (row.remote, row.locations, row.canonical_url) == (True, ["Stuttgart, Deutschland"], "https://join.com/companies/acme/join-1-x")
    row = run(spark, "adzuna", {"results": [{"id": 5, "title": "A", "salary_min": 55000.0, "salary_max": 65000, "contract_time": "full_time", "redirect_url": "https://x.example/1"}]})[0][0]
    assert (row.salary, row.employment_types) == ("€55.000 - €65.000", ["full_time"])


def test_ba_jobsuche(spark):
    item = {
        "summary": {"referenznummer": "10-1", "titel": "Alt", "homeofficetyp": "TEILWEISE"},
        "detail": {
            "stellenangebotsTitel": "Office Manager", "firma": "Beispiel GmbH", "arbeitszeitVollzeit": True,
            "arbeitszeitTeilzeitAbend": "true", "homeofficemoeglich": True, "verguetungsangabe": "KEINE_ANGABE",
            "stellenlokationen": [{"adresse": {"plz": "70173", "ort": "Stuttgart", "region": "BADEN_WUERTTEMBERG", "land": "DEUTSCHLAND"}}],
        },
    }
    row = run(spark, "ba_jobsuche", {"items": [item]})[0][0]
    assert (row.title, row.employment_types, row.remote, row.salary) == ("Office Manager", ["VOLLZEIT", "TEILZEIT"], True, None)
    assert row.locations == ["70173 Stuttgart, BADEN_WUERTTEMBERG"]
    assert row.metadata["remote_type"] == "hybrid"


def test_html_cards(spark):
    db = ('<div id="resultItems"><a class="m-search-hit x" data-job-id="db-1" href="/job/db-1"><span class="m-search-hit__title-text">Vorstands&shy;assistenz</span>'
          '<div><i aria-label="Arbeitsort"></i> Stuttgart, Ulm</div><div><i aria-label="Arbeitgeber:in"></i>Deutsche Bahn AG</div></a></div>')
    row = run(spark, "deutsche_bahn", db.replace("&shy;", ""))[0][0]
    assert (row.source_job_id, row.title, row.company, row.locations) == ("db-1", "Vorstandsassistenz", "Deutsche Bahn AG", ["Stuttgart", "Ulm"])
    assert row.canonical_url == "https://db.jobs/job/db-1"
    rm = '<a href="/de/job/assistenz/4711"><b>Assistenz</b> | Rheinmetall AG | Düsseldorf</a><a href="/de/job/x/">Nichts</a>'
    rows, rejected = run(spark, "rheinmetall", rm)
    assert [(r.source_job_id, r.title, r.company, r.locations) for r in rows] == [("4711", "Assistenz", "Rheinmetall AG", ["Düsseldorf"])]
    assert rejected == 1
    ia = '<tr class="ia-e-table__row"><td data-field="StellenangebotId">123 </td><td data-field="Stellenbezeichnung">Referent</td><td data-field="Von">22.07.2026</td><td data-field="Dienstort">vor Ort</td></tr>'
    row = run(spark, "interamt", ia)[0][0]
    assert (row.source_job_id, row.published_at, row.remote) == ("123", datetime(2026, 7, 22), False)
    sg = ('<div class="matchElement" id="job_id_5"><div class="date">2026-07-01</div><a href="../job/5/ea">EA</a><div class="ProjectGeoLocationCity">Ulm; Bonn</div></div>'
          '<div class="matchElement" id="job_id_6"><a href="../job/6/x">X</a></div>')
    rows, _ = run(spark, "softgarden", sg, base_url="https://acme.softgarden.io/de/vacancies")
    assert [(r.source_job_id, r.title, r.locations) for r in rows] == [("5", "EA", ["Ulm", "Bonn"]), ("6", "X", [])]


def test_icims(spark):
    item = {"id": "42", "url": "https://c.icims.com/jobs/42/job", "title": "x", "job": {
        "title": "EA", "jobLocation": {"address": {"postalCode": "70173", "addressLocality": "Stuttgart", "addressCountry": {"name": "DE"}}},
        "url": "https://evil.example/", "jobLocationType": "TELECOMMUTE"}}
    row = run(spark, "icims", {"items": [item]})[0][0]
    assert (row.title, row.locations, row.remote, row.canonical_url) == ("EA", ["70173, Stuttgart, DE"], True, "https://c.icims.com/jobs/42/job")


def test_all_specs_compile(spark):
    for name in SPECS:
        rows, _ = run(spark, name, "{}")
        assert rows == []


LANDED = "source string, source_job_id string, title string, company string, locations array<string>, description string, " \
    "description_format string, canonical_url string, apply_url string, published_at timestamp, updated_at timestamp, " \
    "employment_types array<string>, remote boolean, salary string, metadata map<string,string>, raw string"


def test_landing_record(spark):
    row = ("ba_jobsuche", "BA-100", "Office Manager", "Beispiel GmbH", ["70173 Stuttgart, Baden-Wuerttemberg"],
           "<p>Direkte <b>Unterstuetzung</b> der Geschaeftsfuehrung</p>", "html", None, "https://x.example/a", None, None,
           ["VOLLZEIT", "HEIM_TELEARBEIT"], True, None, {}, "{}")
    p = to_posting(spark.createDataFrame([row], LANDED)).first()
    assert p.description_text == "Direkte Unterstuetzung der Geschaeftsfuehrung"
    assert (p.postcode, p.city, p.state, p.remote_type) == ("70173", "Stuttgart", "Baden-Württemberg", "hybrid")
    assert (p.employment_type, p.canonical_url, p.country) == ("VOLLZEIT, HEIM_TELEARBEIT", "https://x.example/a", "DE")
    assert json.loads(p.structured_data)["raw_payload_hash"]


def test_boards_and_targets(spark):
    long = "b" * 290
    ids = spark.createDataFrame([("acme", "1"), (long, "x" * 20)], "b string, i string")
    got = [r.n for r in ids.select(landing.namespaced_id(F.col("b"), F.col("i")).alias("n")).collect()]
    assert got[0] == "acme:1" and got[1].startswith("b" * 200 + ":") and len(got[1]) == 265
    targets = spark.createDataFrame(
        [(1, "https://A.example/x/", "crawl", 0), (1, "https://a.example/x#y", "CRAWL ", 1), (1, "https://a.example/x", "search", 2)],
        "source_id int, url string, mode string, pos int")
    assert sorted(r.pos for r in landing.dedupe_targets(targets, "source_id", "url", "mode", "pos").collect()) == [0, 2]


def test_enrich_batches(spark):
    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(size=len(frame))

    out = catalogue.enrich(spark.range(45).coalesce(1), fn, "id long, size long", 20)
    assert sorted(r.size for r in out.collect()) == [5] * 5 + [20] * 40


def test_extra_dimension(spark):
    def bonus(columns):
        return scoring.Dimension("bonus", "Bonus", F.lit(3.0), F.lit(4.0), F.lit("positive"), F.array(F.lit("x")), F.lit("own rule"))

    df = spark.createDataFrame([("a",)], "remote_type string")
    row = scoring.fit_score(df, {}, scoring.Profile(has_preferences=False), extra=[bonus]).first()
    assert row.fit == 75.0 and row.fit_reasons[-1].code == "bonus"


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Jan 2021 – heute: Executive Assistant bei Firma GmbH", ("Jan 2021 – heute", "Executive Assistant", "Firma GmbH")),
        ("03/2016 - 12/2020 | Beispiel AG | Office Manager", ("03/2016 - 12/2020", "Office Manager", "Beispiel AG")),
        ("seit 2019 Referentin", ("seit 2019", "Referentin", None)),
    ],
)
def test_work_experience(spark, line, expected):
    row = profiles.work_experience(spark.createDataFrame([(line,)], "line string")).first()
    assert (row.period, row.role, row.employer) == expected


# --- streams --------------------------------------------------------------------------------


def test_continuous_ingest_and_restart(spark, tmp_path):
    """Files that arrive later are processed by the restarted query, nothing twice."""
    landing_dir, store = tmp_path / "in", VersionedTable(spark, str(tmp_path / "postings"))
    landing_dir.mkdir()
    stream = jobs.read_landing(spark, str(landing_dir), "payload string", fmt="json")

    def drop(n, jobs_):
        (landing_dir / f"{n}.json").write_text(json.dumps({"payload": json.dumps({"data": jobs_})}))

    def ingest():
        jobs.continuous_ingest(
            stream, SPECS["arbeitnow"], store, str(tmp_path / "snap"), str(tmp_path / "ckpt"),
            F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"),
        ).awaitTermination()

    drop(1, [{"slug": "a", "title": "A", "description": "<p>x</p>"}, {"slug": "b", "title": "B"}])
    ingest()
    assert store.read().count() == 2 and store.current()[0] == 1
    drop(2, [{"slug": "a", "title": "A", "description": "<p>changed</p>"}, {"slug": "c", "title": "C"}])
    ingest()
    ingest()
    assert store.read().count() == 3 and store.current()[0] == 2
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 4
    merged = store.read()
    store.compact()
    assert store.read().exceptAll(merged).count() == 0 and store.current()[0] == 3


def test_two_streams_one_table(spark, tmp_path):
    """Each stream has its own batches; neither takes the other's for its own."""
    store = VersionedTable(spark, str(tmp_path / "postings"))
    for name, spec, jobs_ in (
        ("one", "arbeitnow", {"data": [{"slug": "a", "title": "A"}]}),
        ("two", "lever", [{"id": "b", "text": "B"}]),
        ("three", "arbeitnow", {"data": [{"slug": "c", "title": "C"}]}),
    ):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "1.json").write_text(json.dumps({"payload": json.dumps(jobs_)}))
        stream = jobs.read_landing(spark, str(folder), "payload string", fmt="json")
        for _ in range(2):
            jobs.continuous_ingest(
                stream, SPECS[spec], store, str(tmp_path / "snap"), str(tmp_path / f"ckpt-{name}"),
                F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"), compact_after=2,
            ).awaitTermination()
    assert sorted(r.external_id for r in store.read().select("external_id").collect()) == ["a", "b", "c"]
    held = {f for _, f in store.visible()}
    gone = store.vacuum(hours=0)
    assert gone and not held & set(gone) and store.read().count() == 3


def test_ingest_keeps_what_gives_no_posting(spark, tmp_path):
    """Broken pages, filtered and invalid items are kept once with their reason, also if a batch is repeated."""
    folder, store = tmp_path / "in", VersionedTable(spark, str(tmp_path / "postings"))
    folder.mkdir()
    item = lambda i, **more: {"id": i, "title": f"T{i}", "candidate_required_location": "Worldwide"} | more
    whole = json.dumps({"jobs": [item(1), item(2, title=" "), item(3, candidate_required_location="USA only")]})
    payloads = [whole, whole[:-4], json.dumps({"error": 1}), None]
    (folder / "1.json").write_text("\n".join(json.dumps({"page": i, "payload": p}) for i, p in enumerate(payloads)))
    stream = jobs.read_landing(spark, str(folder), "page long, payload string", fmt="json")
    for checkpoint in ("a", "a", "b"):
        jobs.continuous_ingest(
            stream, SPECS["remotive"], store, str(tmp_path / "snap"), str(tmp_path / checkpoint),
            F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"),
        ).awaitTermination()
    lost = spark.read.parquet(f"{store.root}-rejected").filter(F.col("note").contains(f"{tmp_path}/a "))
    rows = sorted((r.landed, r.reason, r.item_pos) for r in lost.collect())
    assert rows == [('{"page":0}', "filtered", 2), ('{"page":0}', "invalid", 1), ('{"page":1}', "unreadable", None),
                    ('{"page":2}', "no list", None), ('{"page":3}', "unreadable", None)]
    raw = {r.reason: r.raw for r in lost.filter("raw IS NOT NULL").collect()}
    assert raw["unreadable"] == payloads[1] and json.loads(raw["filtered"])["id"] == 3 and '"id":2' in raw["invalid"]
    assert [r.external_id for r in store.read().collect()] == ["1"]


def test_quarantine_of_feeds_and_pages(spark):
    from vakanz.sources import landing

    spec = SPECS["personio"]
    feed = f"<feed><{spec.xml_items}><id>1</id></{spec.xml_items}>"
    rows = [(1, feed + "</feed>"), (2, feed + f"<{spec.xml_items}><id>2</id>"), (3, "<feed></feed>"), (4, " ")]
    got = landing.quarantine(spark.createDataFrame(rows, "k long, payload string"), spec).collect()
    assert sorted((r.k, r.reason) for r in got) == [(2, "cut off"), (3, "no list"), (4, "unreadable")]
    cards = next(s for s in SPECS.values() if s.payload == "html")
    got = landing.quarantine(spark.createDataFrame([(1, "<p>Service down</p>")], "k long, payload string"), cards)
    assert [(r.reason, r.raw) for r in got.collect()] == [("no list", "<p>Service down</p>")]


def test_concurrent_commits(spark, tmp_path):
    """Two writers that saw the same version get two numbers; a base made from an old one is refused."""
    from vakanz.sources.tables import ConcurrentCommit, create_once

    store = VersionedTable(spark, str(tmp_path / "t"), keys=["k"])
    frame = lambda *ks: spark.createDataFrame([(k, k) for k in ks], "k long, v long")
    store.append(frame(1))
    other = VersionedTable(spark, store.root, keys=["k"])
    seen = store.current
    store.current = lambda: (1, "stale") if not store.__dict__.pop("told", None) and store.__dict__.setdefault("told", 1) else seen()
    other.append(frame(2))
    assert store.append(frame(3)) == 3
    assert sorted(r.k for r in other.read().collect()) == [1, 2, 3]
    with pytest.raises(ConcurrentCommit):
        other.replace(frame(9), after=2)
    assert not create_once(spark, f"{store.root}/manifest/v-000000000003.json", "x")


def _files(spark, rows, schema, folder):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_landing(spark, folder, schema, files_per_batch=1)


def test_stuck_runs(spark, tmp_path):
    """A run is an error when event time has passed its limit, whenever its rows come; a late end finishes it."""
    schema = "run long, at timestamp, done boolean"
    day = lambda n, h=0: datetime(2026, 1, n, h)
    rows = ([(1, day(1), False), (3, day(1), False)], [(9, day(20), True)], [(1, day(20), False), (2, day(1), False)],
            [(9, day(20, 1), True), (4, day(20), False)], [(3, day(2), True)])
    stream, out = _files(spark, rows, schema, str(tmp_path / "in")), str(tmp_path / "out")

    def sink(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    jobs.run_once(jobs.run_states(stream, "run", "at", F.col("done")), sink, str(tmp_path / "c"), "update").awaitTermination()
    newest = F.max_by(F.struct("start", "last", "finished"), "batch").alias("s")
    states = spark.read.parquet(out).groupBy("run_id").agg(newest).select("run_id", "s.*")
    assert {r.run_id: r.state for r in jobs.stuck_runs(states).collect()} == {
        1: "error", 2: "error", 3: "finished", 4: "running", 9: "finished"}


def test_state_over_many_batches(spark, tmp_path):
    """Rows in any order, each batch late against the ones before and one given twice, end in the batch result."""
    rows = [(i % 4, datetime(2026, 1, 1 + i // 10, i % 10), i, i % 5 == 0, i % 7 == 3, None if i % 11 == 0 else "abc"[i % 3])
            for i in range(120)]
    schema = "key long, at timestamp, tie long, failed boolean, success boolean, value string"
    shuffled = sorted(rows, key=lambda r: r[2] * 37 % 101)
    parts = [shuffled[n:n + 24] for n in range(0, 120, 24)] + [shuffled[24:48]]
    stream, df = _files(spark, parts, schema, str(tmp_path / "in")), spark.createDataFrame(rows, schema)
    flags = ["key", "at", "tie", "failed", "success"]
    store = jobs.KeyedRows(spark, str(tmp_path / "fail"), schema.replace(", value string", ""), buckets=3)
    jobs.keep_rows(stream.select(*flags), store, str(tmp_path / "c1"), jobs.open_failures).awaitTermination()
    once = jobs.failure_counts(df)
    found = jobs.failure_counts(store.read())
    assert found.exceptAll(once).count() == 0 == once.exceptAll(found).count()
    assert store.read().count() < df.count()

    plain = "key long, at timestamp, tie long, value string"
    last, out = (jobs.KeyedRows(spark, str(tmp_path / n), plain, buckets=3) for n in ("last", "out"))
    jobs.keep_rows(stream.select("key", "at", "tie", "value"), last, str(tmp_path / "c2"), derive=jobs.changes_in,
                   derived=out).awaitTermination()
    whole = jobs.changes_in(df.select("key", "at", "tie", "value"))
    assert out.read().exceptAll(whole).count() == 0 == whole.exceptAll(out.read()).count()
    assert last.touched(df.limit(0)) == [] and last.read([]).count() == 0


def test_hot_keys_are_split_and_merged(spark, tmp_path):
    """One key with most rows: parts are reduced on their own, the result is that of the whole."""
    at = lambda i: datetime(2026, 1, 1 + i // 96, i // 4 % 24, i % 4 * 15)
    rows = [(0 if i % 3 else i % 5, at(i * (7 if i > 60 else 1)), i) for i in range(200)]
    schema = "key long, at timestamp, n long"
    stream = _files(spark, [rows[i::4] for i in range(4)], schema, str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    jobs.run_once(jobs.partial_sessions(stream, "at", "key", "2 hours", "60 days", salts=4), sink, str(tmp_path / "c"),
                  "complete").awaitTermination()
    parts = spark.read.parquet(f"{out}/3")
    want = spark.createDataFrame(rows, schema).groupBy(F.session_window("at", "2 hours").alias("w"), "key").agg(
        F.count("*").alias("n")).select("key", "w.start", "w.end", "n")
    found = jobs.merge_sessions(parts, "key")
    assert found.exceptAll(want).count() == 0 == want.exceptAll(found).count()
    assert parts.count() > want.count()
    seen = []
    jobs.run_once(jobs.dedupe_stream(stream, ["key"], "at", "60 days"), lambda b, _: seen.extend(b.collect()),
                  str(tmp_path / "d")).awaitTermination()
    assert sorted(r.key for r in seen) == sorted({r[0] for r in rows})


@pytest.mark.parametrize("provider", ["lever", "remotive"])
def test_left_out_opens_a_payload_once(spark, provider):
    """The same rows as from the frames of quarantine and normalize_payload, from one scan."""
    items = ('[{"id":"1","text":"a","title":"a","candidate_required_location":"USA only"},null,7,{"id":" ","text":"b","title":"b"},'
             '{"id":"2","title":"c","text":"c","candidate_required_location":"Worldwide"},{"id":"3"}]')
    payloads = [None, "", "{", "7", "null", '{"jobs":7}', '{"error":1}', "[]", '{"jobs":[]}', items, f'{{"jobs":{items}}}']
    df = spark.createDataFrame(list(enumerate(payloads)), "k long, payload string")
    spec = landing.SPECS[provider]
    landed = F.to_json(F.struct("k")).alias("landed")
    pos = F.col("item_pos").cast("int").alias("item_pos")
    _, rejected = landing.normalize_payload(df, spec)
    wanted = landing.quarantine(df, spec).select(landed, "reason", pos, "raw").unionByName(
        rejected.select(landed, F.lit("invalid").alias("reason"), pos, "raw"))
    got = landing.left_out(df, spec)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect())) and not got.isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
