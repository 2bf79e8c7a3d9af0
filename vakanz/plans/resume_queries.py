"""Résumé texts, made from customers, orders and line items, and the facts read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.operators import resumes
from vakanz.plans.registry import query
from vakanz.plans.views import _cycle, table

_MONTH = _cycle("(month(o_orderdate) + 11)", ("Jan", "Feb", "März", "Apr", "Mai", "Jun", "Juli", "August", "Sept", "Okt", "Nov", "Dez."))
_FIRST = _cycle("c_custkey", ("Anna", "Erik", "JANE", "Maria-Luise", "van"))
_LAST = _cycle("(c_custkey % 97)", ("Schmidt", "O''Neil", "DOE", "Weber", "Kaya", "Manager"))
_Y = "year(o_orderdate)"


def _s(number: str) -> str:
    return f"CAST({number} AS STRING)"


# One row per line; reads the same in both dialects. Every fourth text has no experience heading.
LINES = f"""
SELECT c_custkey AS k, -100 AS pos, CASE WHEN c_custkey % 6 = 4 THEN 'Name: ' WHEN c_custkey % 6 = 5 THEN 'Lebenslauf ' ELSE '' END
  || {_FIRST} || ' ' || {_LAST} AS line FROM {{customer}}
UNION ALL SELECT c_custkey, -99, {_FIRST} || ' ' || {_LAST} FROM {{customer}} WHERE c_custkey % 6 = 5
UNION ALL SELECT c_custkey, -90, CASE WHEN c_custkey % 3 = 0 THEN 'EXECUTIVE ASSISTANT' ELSE 'Current role: Teamleitung ' || {_s('c_custkey')} END
  FROM {{customer}} WHERE c_custkey % 3 < 2
UNION ALL SELECT c_custkey, -80, 'c' || {_s('c_custkey')} || '@Example.com | Tel. +49 711 ' || {_s('1000000 + c_custkey')} FROM {{customer}}
UNION ALL SELECT c_custkey, -70, 'Profil: Reliable with numbers' FROM {{customer}} WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, -69, '- and with ' || c_mktsegment FROM {{customer}} WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, -60, 'SPRACHEN' FROM {{customer}} WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, -59, 'English - C1 | Deutsch - B2' FROM {{customer}} WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, -50, 'Skills: Excel, Kalendersteuerung; Tool ' || {_s('c_custkey % 7')} || ' | excel | Advanced' FROM {{customer}}
UNION ALL SELECT c_custkey, -65, 'Outlook, French correspondence' FROM {{customer}} WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, -10, 'PROFESSIONAL EXPERIENCE' FROM {{customer}} WHERE c_custkey % 4 <> 3
UNION ALL SELECT o_custkey, o_orderkey * 100, CASE o_orderkey % 4
    WHEN 0 THEN {_MONTH} || ' ' || {_s(_Y)} || ' - ' || {_MONTH} || ' ' || {_s(f'{_Y} + 2')} || ' | Executive Assistant | Acme ' || {_s('o_custkey % 50')} || ' GmbH'
    WHEN 1 THEN {_s('month(o_orderdate)')} || '/' || {_s(_Y)} || ' bis heute'
    WHEN 2 THEN 'Team Coordinator | Beispiel KG'
    ELSE 'seit ' || {_MONTH} || ' ' || {_s(_Y)} || ': Sachbearbeitung Nummer ' || {_s('o_custkey % 9')} END FROM {{orders}}
UNION ALL SELECT o_custkey, o_orderkey * 100 + 1, CASE WHEN o_orderkey % 4 = 1 THEN 'Office Manager bei Firma ' || {_s('o_custkey % 9')} || ' AG'
    ELSE {_s(_Y)} || ' – ' || {_s(f'{_Y} + 1')} END FROM {{orders}} WHERE o_orderkey % 4 IN (1, 2)
UNION ALL SELECT o_custkey, o_orderkey * 100 + 10 + l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN '- ' ELSE '' END
    || 'Handled part ' || {_s('l_partkey')} || ' for supplier ' || {_s('l_suppkey')} FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
UNION ALL SELECT c_custkey, 1000000000000, 'EDUCATION' FROM {{customer}}
UNION ALL SELECT c_custkey, 1000000000001, '• Bachelor of Arts ' || {_s('c_custkey % 3')} || ' | 2015' FROM {{customer}}
UNION ALL SELECT c_custkey, 1000000000002, 'Certificates: Administrative Professional' FROM {{customer}} WHERE c_custkey % 2 = 1
"""

_ROLE = "|".join(fixed.ROLE_WORDS)
_FIRM = r"\b(?:" + "|".join(w.replace(".", r"\.") for w in fixed.COMPANY_WORDS) + r")\b"
_D = r"(?:0?[1-9]|1[0-2])[./](?:19|20)[0-9]{2}|\p{L}{3,9}\.?\s+(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}"
_P = rf"(?i)((?:{_D})\s*(?:[-–—]|bis)\s*(?:{_D}|heute)|seit\s+(?:{_D}))"
# a heading line's section and the rest of the line
_HEADS = r"""
l AS (SELECT k, pos, trim(line) AS line FROM lines WHERE line IS NOT NULL AND trim(line) <> ''),
h AS (SELECT *, CASE WHEN line = 'PROFESSIONAL EXPERIENCE' THEN 'experience' WHEN line = 'EDUCATION' THEN 'education'
    WHEN line = 'SPRACHEN' THEN 'languages' WHEN starts_with(line, 'Skills:') THEN 'skills' WHEN starts_with(line, 'Profil:') THEN 'summary'
    WHEN starts_with(line, 'Certificates:') THEN 'certifications' END AS head, position(':' IN line) AS colon FROM l),
s AS (SELECT *, CASE WHEN head IS NULL THEN line WHEN colon > 0 THEN trim(substr(line, colon + 1)) END AS own,
    last_value(head IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos, line) AS section FROM h)
"""
_SQL_LINES = LINES.format(customer="customer", orders="orders", lineitem="lineitem")
_MONTHS = "CASE {} " + " ".join(
    f"WHEN '{w}' THEN {m}" for m, words in fixed.MONTH_NAMES.items() for w in words) + " END"


def _month(value: str, else_: str) -> str:
    word = _MONTHS.format(rf"regexp_extract(lower({value}), '(\p{{L}}{{3,9}})\.? ', 1)")
    number = rf"TRY_CAST(regexp_extract({value}, '([0-9]+)[./]', 1) AS INT)"
    return rf"CAST(regexp_extract({value}, '((?:19|20)[0-9]{{2}})', 1) AS INT) * 12 + coalesce({number}, {word}, {else_}) - 1"


WORK_SQL = rf"""
WITH lines AS ({_SQL_LINES}), {_HEADS},
m AS (SELECT *, bool_or(section = 'experience' AND own IS NOT NULL) OVER (PARTITION BY k) AS in_section FROM s),
c AS (SELECT k, in_section, head IS NOT NULL AND NOT in_section AS is_heading, row_number() OVER (PARTITION BY k ORDER BY pos, line) AS spot,
    CASE WHEN in_section THEN own ELSE line END AS line FROM m WHERE NOT in_section OR (section = 'experience' AND own IS NOT NULL)),
f AS (SELECT *, nullif(regexp_extract(line, '{_P}', 1), '') AS period,
    regexp_replace(regexp_replace(line, '{_P}', '', 'g'), '^[\s|,;:–—\-]+|[\s|,;:–—\-]+$', '', 'g') AS beside,
    length(line) <= 180 AND NOT regexp_matches(line, '[.;]$') AND NOT contains(line, '@') AND NOT regexp_matches(line, '[0-9]{{7}}')
    AND (regexp_matches(lower(line), '{_ROLE}') OR regexp_matches(lower(line), '{_FIRM}') OR contains(line, '|')
      OR regexp_matches(line, '\s(?:bei|at)\s')) AS names FROM c),
g AS (SELECT *, period IS NOT NULL OR names OR is_heading AS stops, CASE WHEN names AND period IS NULL THEN line END AS ident FROM f),
w AS (SELECT *, lead(ident, 1) OVER x AS n1, lead(ident, 2) OVER x AS n2, lag(ident, 1) OVER x AS p1, lag(ident, 2) OVER x AS p2,
    max(CASE WHEN stops THEN spot END) OVER (PARTITION BY k ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island
  FROM g WINDOW x AS (PARTITION BY k ORDER BY spot)),
e AS (SELECT *, CASE WHEN beside <> '' THEN beside WHEN n1 IS NOT NULL THEN concat_ws(' | ', n1, n2)
      WHEN p1 IS NOT NULL THEN concat_ws(' | ', p2, p1) ELSE '' END AS context,
    spot + CASE WHEN beside <> '' OR n1 IS NULL THEN 0 WHEN n2 IS NULL THEN 1 ELSE 2 END AS ends FROM w WHERE period IS NOT NULL),
p AS (SELECT *, [trim(y) FOR y IN regexp_split_to_array(context, '\s*[|–—]\s*') IF trim(y) <> ''] AS parts FROM e
  WHERE context <> '' AND (in_section OR regexp_matches(lower(context), '{_ROLE}'))),
q AS (SELECT *, regexp_matches(context, '\s(?:bei|at)\s') AS direct,
    list_position([regexp_matches(lower(y), '{_ROLE}') FOR y IN parts[1:3]], true) AS ra,
    list_position([regexp_matches(lower(y), '{_FIRM}') FOR y IN parts[1:3]], true) AS fa FROM p),
r AS (SELECT k, spot, ends, period, CASE WHEN direct THEN regexp_extract(context, '^(.*?)\s+(?:bei|at)\s', 1) WHEN len(parts) < 2 THEN
      CASE WHEN ra IS NULL AND fa IS NOT NULL THEN NULL ELSE context END
      ELSE parts[CASE WHEN ra IS NOT NULL THEN ra WHEN fa = 1 THEN 2 ELSE 1 END] END AS role,
    CASE WHEN direct THEN regexp_extract(context, '^.*?\s+(?:bei|at)\s+(.*)$', 1) WHEN len(parts) < 2 THEN
      CASE WHEN ra IS NULL AND fa IS NOT NULL THEN context END
      ELSE parts[CASE WHEN fa IS NOT NULL THEN fa WHEN ra = 1 THEN 2 WHEN ra IS NOT NULL THEN 1 ELSE 2 END] END AS employer FROM q),
d AS (SELECT k, island, regexp_replace(line, '^[-–—]+\s*', '') AS duty, min(spot) AS spot FROM w WHERE NOT stops AND NOT contains(line, '@') GROUP BY ALL),
a AS (SELECT k, island, string_agg(duty, '|' ORDER BY spot) AS duties FROM d WHERE duty <> '' GROUP BY k, island),
u AS (SELECT r.*, a.duties FROM r LEFT JOIN a ON a.k = r.k AND a.island = r.ends WHERE role IS NOT NULL OR employer IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r.k, lower(period), lower(coalesce(role, '')), lower(coalesce(employer, '')) ORDER BY spot) = 1),
v AS (SELECT *, regexp_extract_all(period, '(?i)(?:{_D})') AS dates FROM u),
z AS (SELECT *, {_month("dates[1]", "1")} AS start_month, CASE WHEN len(dates) > 1 THEN {_month("dates[2]", "12")} ELSE 2024 * 12 + 6 END AS end_month FROM v)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN end_month >= start_month THEN start_month END DESC NULLS LAST, spot) AS position,
  period, role, employer, CAST(CASE WHEN end_month >= start_month THEN start_month END AS INT) AS start_month,
  CAST(CASE WHEN end_month >= start_month THEN end_month END AS INT) AS end_month, coalesce(duties, '') AS duties FROM z
"""


def resume_texts(spark, d):
    lines = spark.sql(LINES, **{t: table(spark, d, t) for t in ("customer", "orders", "lineitem")})
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.filter("line is not null").groupBy("k").agg(F.array_join(ordered["line"], "\n").alias("text"))


@query("work_experience", WORK_SQL)
def work_experience(spark, d):
    found = resumes.work_experience(resume_texts(spark, d), "k", "text", F.lit(2024 * 12 + 6))
    return found.select("k", F.col("position").cast("long").alias("position"), "period", "role", "employer", "start_month",
                        "end_month", F.array_join("responsibilities", "|").alias("duties"))


def _terms(table_: dict, value: str) -> str:
    """List of the names of a term table that a line mentions as whole words, in the table's order."""
    edge = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    found = ", ".join(
        f"CASE WHEN regexp_matches(lower({value}), '{edge[0]}(?:{'|'.join(words)}){edge[1]}') THEN '{name}' END"
        for name, words in table_.items())
    return f"[y FOR y IN [{found}] IF y IS NOT NULL]"


# Known skills that the lines of these texts can mention; the others never occur in them.
_SPOKEN = {name: words for name, words in fixed.SKILL_TERMS.items() if name in (
    "Excel", "Outlook", "Terminmanagement", "Korrespondenz")}
_LETTERS = r"[A-ZÄÖÜ][\p{L}]*(?:[-''][A-ZÄÖÜ][\p{L}]*)*"

SUGGESTED_SQL = rf"""
WITH lines AS ({_SQL_LINES}), {_HEADS},
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, line) AS spot FROM s),
name AS (SELECT k, line, CASE WHEN starts_with(line, 'Name: ') THEN substr(line, 7) ELSE line END AS value, spot FROM n WHERE spot <= 15),
best AS (SELECT k, min_by(value, spot) AS full_name, min_by(line, spot) AS source FROM name
  WHERE regexp_matches(value, '^{_LETTERS}(?:\s+{_LETTERS}){{1,4}}$') AND NOT regexp_matches(lower(value), '{_ROLE}')
    AND lower(value) NOT IN ('professional experience') GROUP BY k),
title AS (SELECT n.k, min_by(CASE WHEN starts_with(line, 'Current role: ') THEN substr(line, 15) ELSE line END,
    CASE WHEN starts_with(line, 'Current role: ') THEN spot ELSE 100 + spot END) AS current_title
  FROM n LEFT JOIN best USING (k) WHERE (starts_with(line, 'Current role: ') AND spot <= 30) OR (spot <= 20 AND line IS DISTINCT FROM best.source
    AND head IS NULL AND NOT contains(line, '@') AND NOT regexp_matches(line, '[0-9]{{7}}') AND regexp_matches(lower(line), '{_ROLE}')
    AND NOT regexp_matches(line, '{_P}')) GROUP BY n.k),
contact AS (SELECT k, min_by(lower(regexp_extract(line, '[\w.+-]+@[\w.-]+')), spot) AS email, min_by(regexp_extract(line, '\+49 [0-9 ]+'), spot) AS phone
  FROM n WHERE contains(line, '@') GROUP BY k),
summary AS (SELECT k, string_agg(regexp_replace(own, '^[-–—]+\s*', ''), ' ' ORDER BY spot) AS summary FROM n WHERE section = 'summary' AND own IS NOT NULL GROUP BY k),
spoken AS (SELECT k, spot, bool_or(section = 'languages' AND own IS NOT NULL) OVER (PARTITION BY k) AS listed, section = 'languages' AND own IS NOT NULL AS here,
    {_terms(fixed.LANGUAGE_TERMS, "line")} AS found FROM n),
each AS (SELECT k, spot, unnest(found) AS language, generate_subscripts(found, 1) AS i FROM spoken WHERE here OR NOT listed),
languages AS (SELECT k, string_agg(language, '|' ORDER BY spot, i) AS languages FROM (SELECT k, language, min(spot) AS spot, min_by(i, spot) AS i FROM each GROUP BY k, language) GROUP BY k),
items AS (SELECT k, spot, i, trim(x, ' •·|,;:-') AS skill FROM (SELECT k, spot, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
    SELECT k, spot, regexp_split_to_array(own, '\s*[|•·;,]\s*') AS xs FROM n WHERE section = 'skills' AND own IS NOT NULL)) ),
kept AS (SELECT k, skill, spot, i FROM items WHERE regexp_matches(skill, '[A-Za-zÄÖÜäöüß]') AND lower(skill) NOT IN ('advanced')
  AND NOT regexp_matches(skill, '{_P}') QUALIFY row_number() OVER (PARTITION BY k, lower(skill) ORDER BY spot, i) = 1),
listed AS (SELECT k, string_agg(skill, '|' ORDER BY spot, i) AS skills, string_agg(lower(skill), '|') AS keys FROM kept GROUP BY k),
said AS (SELECT k, unnest({_terms(_SPOKEN, "line")}) AS skill FROM n),
extra AS (SELECT DISTINCT said.k, said.skill FROM said JOIN listed USING (k) WHERE NOT regexp_matches(listed.keys,
    CASE said.skill {" ".join(f"WHEN '{name}' THEN '{'|'.join(words)}'" for name, words in _SPOKEN.items())} END)),
known AS (SELECT k, string_agg(skill, '|' ORDER BY list_position({list(_SPOKEN)}, skill)) AS more FROM extra GROUP BY k),
education AS (SELECT k, string_agg(trim(own, ' •'), '|' ORDER BY spot) AS education FROM n WHERE section = 'education' AND own IS NOT NULL GROUP BY k),
certs AS (SELECT k, string_agg(own, '|' ORDER BY spot) AS certifications FROM n WHERE section = 'certifications' AND own IS NOT NULL GROUP BY k)
SELECT k, full_name, current_title, email, phone, summary, coalesce(languages, '') AS languages, concat_ws('|', skills, more) AS skills, coalesce(education, '') AS education,
  coalesce(certifications, '') AS certifications
FROM (SELECT DISTINCT k FROM n) LEFT JOIN best USING (k) LEFT JOIN title USING (k) LEFT JOIN contact USING (k) LEFT JOIN summary USING (k)
LEFT JOIN languages USING (k) LEFT JOIN listed USING (k) LEFT JOIN known USING (k) LEFT JOIN education USING (k) LEFT JOIN certs USING (k)
"""


@query("profile_suggestions", SUGGESTED_SQL)
def profile_suggestions(spark, d):
    found = resumes.profile_suggestions(resume_texts(spark, d), "k", "text")
    joined = [F.array_join(c, "|").alias(c) for c in ("languages", "skills", "education", "certifications")]
    return found.select("k", "full_name", "current_title", "email", "phone", "summary", *joined)
