"""Résumé lines and preference texts on small cases."""

import pytest
from pyspark.sql import functions as F

from vakanz.operators import preferences, resumes

NOW = 2026 * 12 + 6
LONG = [
    "MIRA HOLM", "OPERATIONS ANALYST", "mira.holm@example.org | +49 30 5550199", "PROFESSIONAL SUMMARY",
    "Keeps three teams on time.", "CORE COMPETENCIES", "Travel planning | Budget rounds | budget rounds | Vendor talks",
    "PROFESSIONAL EXPERIENCE", "Feb 2020 - Nov 2024 | Senior Operations Manager | Nordlicht Ltd",
    "Led the move of two sites.", "▸ Wrote the yearly plan.", "Wrote the yearly plan.",
    "May 2015 - Jan 2020 | Project Coordinator | Sample Corporation", "Booked travel and reports.",
    "EDUCATION", "Master of Science in Logistics | Example University | 2014", "CERTIFICATIONS", "Certified Planner | 2021",
    "LANGUAGES", "English - Native | German - B2", "TECHNICAL SKILLS", "Excel | Jira | 2019 - 2020",
]


def experience(spark, lines):
    df = spark.createDataFrame([(1, "\n".join(lines))], "k long, text string")
    return resumes.work_experience(df, "k", "text", F.lit(NOW)).orderBy("position").collect()


def suggested(spark, lines):
    df = spark.createDataFrame([(1, None if lines is None else "\n".join(lines))], "k long, text string")
    return resumes.profile_suggestions(df, "k", "text").collect()[0]


def test_entries_of_a_section_with_their_duties(spark):
    first, second = experience(spark, LONG)
    assert (first.period, first.role, first.employer) == ("Feb 2020 - Nov 2024", "Senior Operations Manager", "Nordlicht Ltd")
    assert first.responsibilities == ["Led the move of two sites.", "Wrote the yearly plan."]
    assert (second.role, second.employer, second.responsibilities) == (
        "Project Coordinator", "Sample Corporation", ["Booked travel and reports."])
    assert (first.start_month, first.end_month) == (2020 * 12 + 1, 2024 * 12 + 10)
    assert first.source_text.startswith(LONG[8] + " | Led the move")


def test_names_stand_after_or_before_a_bare_period(spark):
    rows = experience(spark, [
        "Berufserfahrung", "03/2021 - heute", "Teamleitung Empfang", "Muster GmbH", "Plant Termine", "Analyst | Alt AG",
        "2016 – 2018", "Schreibt Berichte", "seit 2010: Sachbearbeitung", "2001 - 2002", "ohne Namen"])
    assert [(r.period, r.role, r.employer, r.responsibilities) for r in rows] == [
        ("03/2021 - heute", "Teamleitung Empfang", "Muster GmbH", ["Plant Termine"]),
        ("2016 – 2018", "Analyst", "Alt AG", ["Schreibt Berichte"]),
        ("seit 2010", "Sachbearbeitung", None, []),
    ]
    assert rows[0].end_month == NOW


def test_without_a_section_an_entry_needs_a_role(spark):
    rows = experience(spark, ["2019 - 2020 | Gardening club", "2020 - 2021 | Office Manager | Blau KG", "Orders paper",
                              "office manager | BLAU KG | 2020 - 2021", "EDUCATION", "Bachelor | 2018 - 2019"])
    assert [(r.role, r.employer, r.responsibilities) for r in rows] == [("Office Manager", "Blau KG", ["Orders paper"])]
    assert experience(spark, ["", "  "]) == [] and experience(spark, ["no period at all"]) == []


def test_nothing_is_cut(spark):
    lines = ["WORK EXPERIENCE"]
    for i in range(40):
        lines += [f"{1970 + i} - {1971 + i} | Manager | Firma {i} GmbH", *[f"Duty {i} {j} " + "x" * 200 for j in range(20)]]
    rows = experience(spark, lines)
    assert len(rows) == 40 and all(len(r.responsibilities) == 20 for r in rows)
    assert [r.start_month for r in rows] == sorted((r.start_month for r in rows), reverse=True)


def test_suggested_fields(spark):
    r = suggested(spark, LONG)
    assert (r.full_name, r.current_title, r.email) == ("MIRA HOLM", "OPERATIONS ANALYST", "mira.holm@example.org")
    assert r.phone == "+49 30 5550199" and r.summary == "Keeps three teams on time."
    assert r.languages == ["Englisch", "Deutsch"] or r.languages == ["Deutsch", "Englisch"]
    assert r.skills == ["Travel planning", "Budget rounds", "Vendor talks", "Excel", "Jira"]
    assert r.education == [LONG[15]] and r.certifications == [LONG[17]]


@pytest.mark.parametrize("line, name", [
    ("Name: Ole Berg", "Ole Berg"), ("Lebenslauf", None), ("Jean-Luc d'Arc", None), ("Zoë O'Neil-Roy Ünal", "Zoë O'Neil-Roy Ünal"),
    ("Office Manager", None), ("Ole Berg, +49 711 1234567", None), ("Ole", None), ("Ole Berg 2", None), ("Work History", None),
])
def test_names(spark, line, name):
    assert suggested(spark, ["Resume", line]).full_name == name


def test_titles_and_empty_texts(spark):
    assert suggested(spark, ["Ole Berg", "Head of Music", "Current role: Pianist"]).current_title == "Pianist"
    assert suggested(spark, ["2020 - 2021 Manager", "me@x.org Manager", "Manager | Team,"]).current_title == "Manager | Team"
    for lines in (None, [""], ["just a line"]):
        r = suggested(spark, lines)
        assert (r.full_name, r.current_title, r.email, r.skills, r.languages) == (None, None, None, [], [])


def test_years_and_newest_role_come_from_the_entries(spark):
    df = spark.createDataFrame([(1, "\n".join(["EXPERIENCE", *LONG[7:14]])), (2, "nothing")], "k long, text string")
    work = resumes.work_experience(df, "k", "text", F.lit(NOW))
    rows = {r.k: r for r in resumes.with_experience(resumes.profile_suggestions(df, "k", "text"), work, "k").collect()}
    assert (rows[1].experience_years, rows[1].current_title) == (9, "Senior Operations Manager")
    assert (rows[2].experience_years, rows[2].current_title) == (None, None)


# --- preferences ------------------------------------------------------------------------------

CURRENT = ("k long, employment_types array<string>, contract_types array<string>, languages array<string>, "
           "industries array<string>, company_sizes array<string>, preferred_states array<string>, "
           "include_germany_remote boolean, workplace_preference string, onsite_weight double, hybrid_weight double, "
           "remote_weight double, commute_penalty_minutes int, max_commute_minutes int, min_salary bigint, "
           "target_salary bigint, max_travel_percent bigint, primary_role_terms array<string>, "
           "additional_role_terms array<string>")
BASE = (1, ["Vollzeit"], [], ["Deutsch"], [], [], ["Berlin"], False, None, 1.0, 0.55, 0.2, 30, 60, 40000, 50000, None,
        ["Assistenz"], [])


def compiled(spark, prompt, taxonomy=None):
    current = spark.createDataFrame([BASE], CURRENT)
    prompts = spark.createDataFrame([(1, prompt, taxonomy)], "k long, prompt string, taxonomy string")
    values, issues = preferences.compile_preferences(current, prompts, "k", taxonomy="taxonomy")
    found = sorted((r.source, r.line_number, r.code) for r in issues.collect())
    return values.collect()[0], found


def test_labelled_lines(spark):
    v, issues = compiled(spark, "Arbeitszeit: Teilzeit, Vollzeit; Teilzeit\n\nPreferred regions: Bavaria, Thüringen\n"
                                "Include Germany-wide remote jobs: ja\nPreferred work model: hybrid\nCommute: 20 to 45 minutes\n"
                                "Minimum annual salary: 55.000 EUR\nTarget annual salary: not specified\nMaximum travel: 15 %")
    assert issues == []
    assert v.employment_types == ["Teilzeit", "Vollzeit"] and v.preferred_states == ["Bayern", "Thüringen"]
    assert (v.include_germany_remote, v.workplace_preference) == (True, "hybrid")
    assert (v.onsite_weight, v.hybrid_weight, v.remote_weight) == (0.75, 1.0, 0.35)
    assert (v.commute_penalty_minutes, v.max_commute_minutes) == (20, 45)
    assert (v.min_salary, v.target_salary, v.max_travel_percent) == (55000, None, 15)
    assert v.languages == ["Deutsch"] and v.primary_role_terms == ["Assistenz"]


def test_the_last_usable_line_wins(spark):
    v, issues = compiled(spark, "Languages: French\nLanguages: none\nMinimum annual salary: 45000\nMinimum annual salary: many\n"
                                "Work-model weights: 10 %, 20 %, 100 %\nPreferred work model: remote")
    assert v.languages == [] and v.min_salary == 45000 and issues == [("preference_prompt", 4, "invalid_salary")]
    assert (v.onsite_weight, v.hybrid_weight, v.remote_weight, v.workplace_preference) == (0.1, 0.2, 1.0, "remote")


def test_every_issue(spark):
    many = ", ".join(f"w{i}" for i in range(21))
    _, issues = compiled(spark, "Preferred regions: Atlantis\nInclude Germany-wide remote jobs: maybe\nPreferred work model: tent\n"
                                "Work-model weights: 10 %, 20 %\nCommute: 50 to 20\nMinimum annual salary: 0\nMaximum travel: 101 %\n"
                                "Favourite colour: red\nhello there\nTarget annual salary: 10000\nCommute: 9\n"
                                f"Preferred industries: {many}\nPreferred regions: Berlin, Hessen, Bremen, Hamburg, Sachsen, Bayern",
                         "Titles:\nloose\nMain role terms:\n-\n* " + "t" * 101)
    assert [i[1:] for i in issues if i[0] == "role_taxonomy"] == [
        (0, "role_list_too_large"), (1, "unknown_role_section"), (2, "invalid_role_term"), (4, "invalid_role_term")]
    assert [i[1:] for i in issues if i[0] == "preference_prompt"] == [
        (0, "list_too_large"), (0, "target_below_minimum"), (0, "too_many_states"), (1, "invalid_state"), (2, "invalid_boolean"),
        (3, "invalid_workplace"), (4, "invalid_weights"), (5, "invalid_commute"), (6, "invalid_salary"), (7, "invalid_percentage"),
        (8, "unknown_instruction"), (9, "unknown_instruction"), (11, "invalid_commute")]


def test_prose(spark):
    v, issues = compiled(spark, "I prefer Hamburg instead of Bavaria\nPlease include remote work\nmaximal 25 Minuten\nBevorzugt hybrid")
    assert issues == [] and v.preferred_states == ["Hamburg"] and v.include_germany_remote is True
    assert (v.commute_penalty_minutes, v.max_commute_minutes, v.workplace_preference, v.hybrid_weight) == (25, 25, "hybrid", 1.0)
    v, issues = compiled(spark, "maximum 10 minutes\nCommute: 20 to 90\nmaximum 80 min\nno remote please")
    assert (v.commute_penalty_minutes, v.max_commute_minutes, v.include_germany_remote) == (20, 80, False)


def test_role_lists(spark):
    v, issues = compiled(spark, None, "Hauptbegriffe:\n- Assistenz\n* assistenz\n- Office\n\nSimilar titles:\n- OFFICE\n- Empfang")
    assert issues == [] and v.primary_role_terms == ["Assistenz", "Office"] and v.additional_role_terms == ["Empfang"]
    assert compiled(spark, "", "")[1] == [("role_taxonomy", 0, "missing_primary_role_terms")]


def test_terms_are_sought_by_plain_search_first(spark):
    """A pattern is tried only where a spelling occurs at all; the words found stay the same."""
    from vakanz.operators.profiles import term_mentions

    terms = {"Excel": ("excel",), "German": ("deutsch", "fran\u00e7ais"), "C": ("c++",)}
    texts = ["EXCEL und C++", "excellent deutsch.", "Fran\u00c7ais", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(term_mentions(F.col("t"), terms).alias("f"))
    assert [r.f for r in df.collect()][:4] == [["Excel", "C"], ["German"], ["German"], []]
    lines = spark.createDataFrame([(["Excel, word", "ms word"], ["ms excel"]), (["nothing"], []), ([], [])],
                                  "l array<string>, s array<string>")
    got = lines.select(resumes.mentioned_skills(F.col("l"), F.col("s")).alias("m"),
                       resumes.spoken_languages(F.col("l")).alias("p")).collect()
    assert [(r.m, r.p) for r in got] == [(["Word"], []), ([], []), ([], [])]
    assert "contains(" in df._jdf.queryExecution().analyzed().toString().lower()


# --- cost ---------------------------------------------------------------------------------------

def patterns_in_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(name) for name in ("regexp_", "RLIKE", "translate("))


def test_work_experience_tries_every_pattern_once(spark):
    """patterns written into the plan again and again are tried again for every line."""
    df = spark.createDataFrame([(1, "\n".join(LONG))], "k long, text string")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    found = patterns_in_plan(resumes.work_experience(df, "k", "text", F.lit(NOW)))
    assert 0 < found < 60, found


def test_plain_lines_are_not_searched_for_every_term(spark):
    """lines are folded and joined once a use, not once a term; the few that hold a word of a term are kept in order."""
    plain = [f"Handled part {i} for supplier {i}" for i in range(300)]
    lines = [" Name: Ole Berg ", *plain, "• SKILLS :", "Vim; Excel", "# Training #", "First aid\u0001", *plain,
             "Reads MS-Word and ms word, caféexcel", "ProtokollfÜHRUNG", *plain, "knİt", "Tel 0711 1234567", "Speaks French"]
    r = suggested(spark, lines)
    assert (r.full_name, r.phone, r.languages) == ("Ole Berg", "0711 1234567", ["Franzoesisch"])
    assert r.skills == ["Vim", "Excel", "Word", "Protokollfuehrung"]
    assert r.certifications == ["First aid", *plain, *lines[-305:-303], *lines[-3:]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "k long, text string")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = resumes.profile_suggestions(df, "k", "text")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("array_join(") < 10 and 0 < plan.count("lower(") < 40 and "translate(" not in plan
    kept = spark.createDataFrame([(lines,), ([],), (None,)], "l array<string>").select(
        resumes.notable_lines(F.col("l"), ["ms word", "café", "protokollführung"]).alias("n"),
        resumes.notable_lines(F.col("l"), ["c", "&&"]).alias("all")).collect()
    assert [(n["at"], n["line"]) for n in kept[0].n] == [(i, lines[i]) for i in (605, 606)]
    assert len(kept[0].all) == len(lines) and (kept[1].n, kept[2].n) == ([], None)
    cut = spark.createDataFrame([(["a", "\u0001Skills", "x\u0002y", "Education: z", "b"],), (["a"],), (None,)],
                                "l array<string>").select(resumes.sections(F.col("l")).alias("s")).collect()
    assert [r.s and [(s["section"], s["lines"]) for s in r.s] for r in cut] == [
        [("skills", ["x y"]), ("education", ["z", "b"])], [], None]
