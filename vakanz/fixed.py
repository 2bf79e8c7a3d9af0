"""Fixed values the results depend on: term lists, lookup tables, weights, patterns.

Nothing here is logic. Every operator takes these as defaults and accepts others.
"""

from __future__ import annotations

# --- fixed values: application statuses ------------------------------------------------
NEW = "Neu"
SAVED = "Merkliste"
NOT_SUITABLE = "Nicht passend"
PLANNED = "Bewerbung geplant"
APPLIED = "Beworben"
INTERVIEW = "Gespräch"
OFFER = "Angebot"
CLOSED = "Abgeschlossen"
STATUSES = (NEW, SAVED, NOT_SUITABLE, PLANNED, APPLIED, INTERVIEW, OFFER, CLOSED)
BLOCKED_STATUSES = (NOT_SUITABLE, APPLIED, INTERVIEW, OFFER, CLOSED)
ACTIVE_STATUSES = (PLANNED, APPLIED, INTERVIEW, OFFER)
STATUS_TIME_COLUMNS = {
    PLANNED: "planned_at",
    APPLIED: "applied_at",
    INTERVIEW: "interview_at",
    OFFER: "offer_at",
    CLOSED: "closed_at",
}
CHECK_PRIORITY = {PLANNED: 0, SAVED: 1, NEW: 2}

# --- fixed values: role rubric (code, label, points, terms) ----------------------------
ROLE_GROUPS = (
    (
        "executive_support",
        "Direkte Unterstützung der Geschäftsführung",
        25,
        (
            "geschäftsführung",
            "geschäftsleitung",
            "vorstand",
            "ceo",
            "executive support",
            "entlastung der geschäftsführung",
            "office of the ceo",
        ),
    ),
    (
        "calendar_coordination",
        "Termin- und Organisationsmanagement",
        15,
        (
            "terminmanagement",
            "terminkoordination",
            "termine",
            "kalender",
            "calendar management",
            "organisation",
            "wiedervorlage",
        ),
    ),
    (
        "communication",
        "Korrespondenz und Schnittstellenkommunikation",
        15,
        (
            "korrespondenz",
            "kommunikation",
            "ansprechpartner",
            "schnittstelle",
            "stakeholder",
            "correspondence",
        ),
    ),
    (
        "meetings",
        "Vor- und Nachbereitung von Besprechungen",
        12,
        (
            "besprechung",
            "sitzung",
            "protokoll",
            "meeting",
            "agenda",
            "vor- und nachbereitung",
        ),
    ),
    (
        "documents",
        "Präsentationen und Entscheidungsvorlagen",
        10,
        (
            "präsentation",
            "entscheidungsvorlage",
            "recherche",
            "reporting",
            "powerpoint",
            "unterlagen aufbereiten",
        ),
    ),
    (
        "travel_events",
        "Reise- und Veranstaltungsorganisation",
        8,
        (
            "reisemanagement",
            "reiseplanung",
            "geschäftsreise",
            "travel management",
            "veranstaltung",
            "eventorganisation",
        ),
    ),
)
TITLE_TERMS = (
    "assistenz der geschäftsführung",
    "geschäftsführungsassistenz",
    "executive assistant",
    "management assistenz",
    "vorstandsassistenz",
    "referent der geschäftsführung",
    "referentin der geschäftsführung",
    "chief of staff",
)
FALSE_FRIENDS = (
    "verkaufsassistenz",
    "pflegeassistenz",
    "sozialassistenz",
    "zahnmedizinische assistenz",
    "laborassistenz",
)
DEFAULT_PRIMARY_ROLE_TERMS = (
    "Assistenz der Geschäftsführung",
    "Executive Assistant",
)
DEFAULT_ADDITIONAL_ROLE_TERMS = (
    "Assistenz",
    "Assistant",
    "Geschäftsführung",
    "Geschäftsleitung",
    "Referent",
    "Office Manager",
    "Chief of Staff",
    "CEO Office",
    "Projektkoordination",
    "Stabsmitarbeiter",
    "Vorstandsassistenz",
    "Executive Office",
    "Management Coordinator",
    "Referent des Vorstands",
)
STRATEGIC_TITLE_TERMS = ("chief of staff", "geschäftsführungsrefer", "ceo office", "vorstandsrefer")
MANAGEMENT_TERMS = ("geschäftsführung", "geschaeftsfuehrung", " ceo ", "vorstand")

# --- fixed values: feedback features and their weights (hundredths) --------------------
FEATURE_WEIGHTS = {
    "remote_type": 25,
    "employment_type": 20,
    "contract_type": 15,
    "state": 10,
    "language": 5,
    "industry": 10,
    "company_size": 5,
    "role_family": 10,
}

# --- fixed values: closed-page phrases --------------------------------------------------
CLOSED_MARKERS = (
    "job is no longer available",
    "job is no longer accepting applications",
    "position has been filled",
    "vacancy has expired",
    "job posting has expired",
    "stelle ist nicht mehr verfügbar",
    "stelle nicht mehr verfügbar",
    "stellenangebot ist nicht mehr verfügbar",
    "bewerbungen werden nicht mehr angenommen",
    "position wurde besetzt",
)

# --- fixed values: country names to codes -----------------------------------------------
COUNTRY_CODES = {
    "deutschland": "DE",
    "germany": "DE",
    "österreich": "AT",
    "oesterreich": "AT",
    "austria": "AT",
    "schweiz": "CH",
    "switzerland": "CH",
    "frankreich": "FR",
    "france": "FR",
    "niederlande": "NL",
    "netherlands": "NL",
    "belgien": "BE",
    "belgium": "BE",
    "luxemburg": "LU",
    "luxembourg": "LU",
    "polen": "PL",
    "poland": "PL",
    "vereinigtes königreich": "GB",
    "united kingdom": "GB",
    "uk": "GB",
    "united states": "US",
    "usa": "US",
}

# --- fixed values: workplace synonyms ---------------------------------------------------
WORKPLACE_SYNONYMS = {
    "onsite": ("onsite", "on-site", "praesenz", "präsenz"),
    "hybrid": ("hybrid", "teilweise-remote", "partial-remote", "mixed"),
    "remote": ("remote", "fully-remote", "full-remote", "homeoffice"),
}

# --- fixed values: state names ----------------------------------------------------------
STATE_ALIASES = {
    "baden-wurttemberg": "Baden-Württemberg",
    "baden-wuerttemberg": "Baden-Württemberg",
    "bavaria": "Bayern",
    "bayern": "Bayern",
    "berlin": "Berlin",
    "brandenburg": "Brandenburg",
    "bremen": "Bremen",
    "hamburg": "Hamburg",
    "hesse": "Hessen",
    "hessen": "Hessen",
    "lower saxony": "Niedersachsen",
    "niedersachsen": "Niedersachsen",
    "mecklenburg-western pomerania": "Mecklenburg-Vorpommern",
    "mecklenburg-vorpommern": "Mecklenburg-Vorpommern",
    "north rhine-westphalia": "Nordrhein-Westfalen",
    "nordrhein-westfalen": "Nordrhein-Westfalen",
    "rhineland-palatinate": "Rheinland-Pfalz",
    "rheinland-pfalz": "Rheinland-Pfalz",
    "saarland": "Saarland",
    "saxony": "Sachsen",
    "sachsen": "Sachsen",
    "saxony-anhalt": "Sachsen-Anhalt",
    "sachsen-anhalt": "Sachsen-Anhalt",
    "schleswig-holstein": "Schleswig-Holstein",
    "thuringia": "Thüringen",
    "thuringen": "Thüringen",
}

# --- fixed values: profile text terms ---------------------------------------------------
LANGUAGE_TERMS = {
    "Deutsch": ("deutsch", "german"),
    "Englisch": ("englisch", "english"),
    "Franzoesisch": ("franzoesisch", "französisch", "french"),
    "Spanisch": ("spanisch", "spanish"),
    "Italienisch": ("italienisch", "italian"),
    "Tuerkisch": ("tuerkisch", "türkisch", "turkish"),
    "Polnisch": ("polnisch", "polish"),
    "Russisch": ("russisch", "russian"),
    "Arabisch": ("arabisch", "arabic"),
    "Portugiesisch": ("portugiesisch", "portuguese"),
    "Niederlaendisch": ("niederlaendisch", "niederländisch", "dutch"),
    "Chinesisch": ("chinesisch", "chinese", "mandarin"),
    "Japanisch": ("japanisch", "japanese"),
    "Koreanisch": ("koreanisch", "korean"),
    "Hindi": ("hindi",),
    "Ukrainisch": ("ukrainisch", "ukrainian"),
    "Tschechisch": ("tschechisch", "czech"),
    "Schwedisch": ("schwedisch", "swedish"),
    "Daenisch": ("daenisch", "dänisch", "danish"),
    "Norwegisch": ("norwegisch", "norwegian"),
}
SKILL_TERMS = {
    "Microsoft Office": ("microsoft office", "ms office", "microsoft 365", "office 365"),
    "Excel": ("excel",),
    "PowerPoint": ("powerpoint",),
    "Word": ("microsoft word", "ms word"),
    "Outlook": ("outlook",),
    "Microsoft Teams": ("microsoft teams", "ms teams"),
    "SAP": ("sap",),
    "DATEV": ("datev",),
    "Salesforce": ("salesforce",),
    "Jira": ("jira",),
    "Confluence": ("confluence",),
    "Projektmanagement": ("projektmanagement", "project management", "project coordination"),
    "Eventmanagement": ("eventmanagement", "event management", "event coordination"),
    "Reisemanagement": (
        "reisemanagement",
        "reiseplanung",
        "travel management",
        "travel planning",
    ),
    "Terminmanagement": (
        "terminmanagement",
        "kalendersteuerung",
        "calendar management",
        "calendar coordination",
        "calendar scheduling",
    ),
    "Sitzungsorganisation": (
        "sitzungsorganisation",
        "meeting coordination",
        "board meeting coordination",
    ),
    "Stakeholdermanagement": (
        "stakeholdermanagement",
        "stakeholder management",
        "stakeholder relations",
    ),
    "Korrespondenz": ("korrespondenz", "correspondence"),
    "Protokollfuehrung": (
        "protokollfuehrung",
        "protokollführung",
        "minute taking",
        "meeting minutes",
    ),
    "Budgetplanung": ("budgetplanung", "budget planning"),
    "Controlling": ("controlling",),
    "Recruiting": ("recruiting",),
    "Ausgabenmanagement": (
        "ausgabenmanagement",
        "expense management",
        "expense reporting",
    ),
}
# words of a section or a level, never a skill of their own
NO_SKILLS = (
    "skills", "kenntnisse", "kompetenzen", "tools", "software", "advanced", "intermediate", "beginner",
    "fortgeschritten", "grundkenntnisse",
)
# document titles that are no name
RESUME_TITLES = ("lebenslauf", "curriculum vitae", "resume", "résumé", "bewerbung")
SECTION_HEADINGS = {
    "summary": (
        "profil",
        "kurzprofil",
        "profilübersicht",
        "profiluebersicht",
        "zusammenfassung",
        "profile",
        "professional profile",
        "professional summary",
        "executive summary",
        "personal statement",
        "about me",
    ),
    "experience": (
        "berufserfahrung",
        "beruflicher werdegang",
        "berufliche erfahrung",
        "berufspraxis",
        "work experience",
        "professional experience",
        "employment history",
        "career history",
        "work history",
    ),
    "skills": (
        "kenntnisse",
        "fähigkeiten",
        "faehigkeiten",
        "kompetenzen",
        "kernkompetenzen",
        "qualifikationen",
        "skills",
        "key skills",
        "core skills",
        "core competencies",
        "competencies",
        "areas of expertise",
        "expertise",
    ),
    "tools": (
        "edv-kenntnisse",
        "it-kenntnisse",
        "software",
        "tools",
        "technical skills",
        "digital skills",
        "systems",
    ),
    "languages": ("sprachen", "sprachkenntnisse", "languages", "language skills"),
    "education": (
        "ausbildung",
        "studium",
        "bildungsweg",
        "akademischer werdegang",
        "education",
        "academic background",
        "academic history",
    ),
    "certifications": (
        "zertifikate",
        "zertifizierungen",
        "weiterbildungen",
        "fortbildungen",
        "certifications",
        "certificates",
        "professional development",
        "training",
        "courses",
    ),
    "other": (
        "kontakt",
        "persönliche daten",
        "persoenliche daten",
        "contact",
        "personal details",
        "interessen",
        "hobbys",
        "interests",
        "projects",
        "projekte",
        "awards",
        "auszeichnungen",
        "references",
        "referenzen",
        "volunteering",
        "ehrenamt",
    ),
}

# --- fixed values: month names ----------------------------------------------------------
MONTH_NAMES = {
    1: ("jan", "january", "januar"),
    2: ("feb", "february", "februar"),
    3: ("mar", "march", "märz", "maerz"),
    4: ("apr", "april"),
    5: ("may", "mai"),
    6: ("jun", "june", "juni"),
    7: ("jul", "july", "juli"),
    8: ("aug", "august"),
    9: ("sep", "sept", "september"),
    10: ("oct", "october", "okt", "oktober"),
    11: ("nov", "november"),
    12: ("dec", "december", "dez", "dezember"),
}

# --- fixed values: page signals, titles, URL shapes ------------------------------------
SIGNAL_GROUPS = (
    ("aufgaben", "responsibilities", "your role", "what you'll do"),
    ("anforderungen", "qualifikation", "requirements", "your profile"),
    ("bewerben", "bewerbung", "apply now", "apply for"),
    ("benefits", "wir bieten", "what we offer"),
)
GENERIC_TITLES = (
    "",
    "jobs",
    "careers",
    "karriere",
    "stellenangebote",
    "jobsearch",
    "search",
    "suche",
    "offene stellen",
    "vacancies",
    "career opportunities",
)
JOB_PATHS = (
    r"/(?:job|jobs|position|positions|vacancy|vacancies)/(?:view/)?[^/]+$",
    r"/(?:stellenangebot|stellenangebote|stellenanzeige|karriere|jdp)/[^/]+$",
    r"/(?:job-listing|job-openings|desc|details)/[^/]+$",
    r"/stellenangebote--.+",
)
STRONG_JOB_PATHS = (
    r"/(?:job|jobs)/view/[^/]+$",
    r"/(?:job|position|vacancy|stellenangebot|stellenanzeige|karriere|jdp)/[^/]+$",
    r"/(?:job-listing|job-openings|desc|details)/[^/]+$",
    r"/stellenangebote--.+",
    r"/jobs/[^/]*\d[^/]*$",
)
JOB_QUERY_KEYS = ("id", "jk", "jobid", "job_id", "gh_jid", "vjk")
TRACKING_KEYS = ("fbclid", "gclid")
TITLE_STOP_WORDS = (
    "and", "der", "des", "die", "für", "fuer", "of", "the", "to", "und", "zur", "zum",
)
LOCATION_TITLE_PATTERNS = (
    r"(?i)\bjob in (.+)$",
    r"(?i)\bhiring .+ in (.+?)\s*\|\s*linkedin$",
    r"(?i)\bstellen ([^|]+)$",
)

# --- fixed values: eligibility phrases ---------------------------------------------------
ELIGIBLE_PHRASES = (
    "anywhere",
    "worldwide",
    "global",
    "germany",
    "deutschland",
    "europe",
    "european",
    "emea",
    "dach",
    "cet",
    "cest",
)

# --- fixed values: language guess -------------------------------------------------------
GERMAN_WORDS = (" der ", " die ", " und ", " sie ", "für")
ENGLISH_WORDS = (" the ", " and ", " you ", " with ", " for ")

# --- fixed values: board providers (host, rule) and known portals ----------------------
BOARD_HOSTS = {
    "greenhouse": ("greenhouse.io",),
    "lever": ("lever.co",),
    "ashby": ("jobs.ashbyhq.com",),
    "smartrecruiters": ("jobs.smartrecruiters.com",),
    "personio": ("jobs.personio.de",),
    "join": ("join.com",),
    "softgarden": ("softgarden.io",),
    "workday": ("myworkdayjobs.com", "workdayjobs.com"),
    "workable": ("workable.com",),
    "recruitee": ("recruitee.com",),
    "teamtailor": ("teamtailor.com",),
    "icims": ("icims.com",),
    "oracle": ("oraclecloud.com",),
}
SUBDOMAIN_PROVIDERS = ("personio", "softgarden", "recruitee", "teamtailor", "icims")
URL_PROVIDERS = ("successfactors", "workday", "oracle", "phenom", "radancy", "beesite")
# first labels of a career site under the employer's own name
CAREER_LABELS = ("career", "careers", "job", "jobs")
PHENOM_HOST = "phenompeople.com"
KNOWN_PORTALS = {
    "adzuna.de": "Adzuna",
    "glassdoor.de": "Glassdoor",
    "indeed.com": "Indeed",
    "jobware.de": "Jobware",
    "jooble.org": "Jooble",
    "kimeta.de": "Kimeta",
    "linkedin.com": "LinkedIn Jobs",
    "meinestadt.de": "meinestadt.de Jobs",
    "monster.de": "Monster",
    "stellenanzeigen.de": "stellenanzeigen.de",
    "stepstone.de": "StepStone",
    "talent.com": "Talent.com",
    "xing.com": "XING Jobs",
}

# --- fixed values: crawler state ranking ------------------------------------------------
STATE_RANK = {"paused": 0, "pending": 1, "ready": 2, "limited": 3, "error": 4, "running": 5}

# --- fixed values: preference parsing ---------------------------------------------------
NOT_SPECIFIED = (
    "",
    "nicht angegeben",
    "nicht festgelegt",
    "keine",
    "none",
    "not provided",
    "not specified",
)
TRUE_VALUES = ("ja", "yes", "true", "ein", "include", "included")
FALSE_VALUES = ("nein", "no", "false", "aus", "exclude", "excluded")

# --- fixed values: HTML entities used in the feeds -------------------------------------
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®",
    "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "bdquo": "„", "laquo": "«", "raquo": "»",
    "euro": "€", "pound": "£", "sect": "§", "deg": "°", "times": "×", "trade": "™",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
    "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ",
    "amp": "&",
}

# --- fixed values: labels of preference lines (accent-free keys) ------------------------
PREFERENCE_LABELS = {
    "arbeitszeit": "employment_types",
    "employment scope": "employment_types",
    "vertragsarten": "contract_types",
    "contract types": "contract_types",
    "bevorzugte regionen": "preferred_states",
    "preferred regions": "preferred_states",
    "deutschlandweite remote-stellen einbeziehen": "include_germany_remote",
    "include germany-wide remote jobs": "include_germany_remote",
    "bevorzugtes arbeitsmodell": "workplace_preference",
    "preferred work model": "workplace_preference",
    "gewichtung der arbeitsmodelle": "workplace_weights",
    "work-model weights": "workplace_weights",
    "fahrtzeit": "commute",
    "commute": "commute",
    "mindestgehalt pro jahr": "min_salary",
    "minimum annual salary": "min_salary",
    "zielgehalt pro jahr": "target_salary",
    "target annual salary": "target_salary",
    "sprachen": "languages",
    "languages": "languages",
    "bevorzugte branchen": "industries",
    "preferred industries": "industries",
    "bevorzugte unternehmensgrossen": "company_sizes",
    "preferred company sizes": "company_sizes",
    "maximale reisetatigkeit": "max_travel_percent",
    "maximum travel": "max_travel_percent",
}

# --- fixed values: role list headings, mode weights, commute limits in prose ------------
ROLE_SECTION_LABELS = {
    "hauptbegriffe": "primary_role_terms",
    "main role terms": "primary_role_terms",
    "primary role terms": "primary_role_terms",
    "zusatzliche titel": "additional_role_terms",
    "additional titles": "additional_role_terms",
    "similar titles": "additional_role_terms",
}
# weights for onsite, hybrid, remote
MODE_WEIGHTS = {"onsite": (1.0, 0.55, 0.2), "hybrid": (0.75, 1.0, 0.35), "remote": (0.4, 0.7, 1.0)}
COMMUTE_PATTERN = r"(?:maximum|maximal(?:e)?|hochstens)\D{0,24}(\d{1,3})\s*(?:minutes|minuten|min)"

# --- fixed values: working-time flags and their labels ----------------------------------
WORKING_TIME_FLAGS = (
    ("arbeitszeitVollzeit", "VOLLZEIT"),
    ("arbeitszeitTeilzeitFlexibel", "TEILZEIT"),
    ("arbeitszeitTeilzeitVormittag", "TEILZEIT"),
    ("arbeitszeitTeilzeitNachmittag", "TEILZEIT"),
    ("arbeitszeitTeilzeitAbend", "TEILZEIT"),
    ("arbeitszeitSchichtNachtWochenende", "SCHICHT_NACHTARBEIT_WOCHENENDE"),
    ("istGeringfuegigeBeschaeftigung", "MINIJOB"),
)
NO_ANSWER = ("keine_angabe", "keine_angaben", "nicht_bekannt")

# --- fixed values: work modes and language names in scores -------------------------------
REMOTE_MODES = ("remote", "fully remote", "vollständig remote")
LANGUAGE_ALIASES = {"deutsch": "de", "german": "de", "englisch": "en", "english": "en"}

# --- fixed values: preference fields that change what is collected -----------------------
COVERAGE_FIELDS = (
    "preferred_states",
    "include_germany_remote",
    "primary_role_terms",
    "additional_role_terms",
)

# --- fixed values: words that mark a role, forms that mark a company ---------------------
ROLE_WORDS = (
    "assistenz",
    "assistant",
    "referent",
    "manager",
    "coordinator",
    "koordinator",
    "sachbearbeit",
    "specialist",
    "consultant",
    "controller",
    "administrator",
    "secretary",
    "sekretär",
    "sekretaer",
    "chief of staff",
    "director",
    "head of",
    "team lead",
    "teamleit",
    "projektleit",
    "project lead",
    "office management",
    "operations",
    "analyst",
    "advisor",
    "officer",
)
COMPANY_WORDS = (
    "gmbh",
    "ag",
    "kg",
    "se",
    "ug",
    "holding",
    "gruppe",
    "group",
    "company",
    "unternehmen",
    "e.v.",
    "ltd",
    "limited",
    "llc",
    "inc",
    "incorporated",
    "corp",
    "corporation",
    "plc",
    "partners",
)
