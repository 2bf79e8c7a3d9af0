"""Preference texts, made from customers and their nations, compiled into settings and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.operators import preferences
from vakanz.plans.registry import query
from vakanz.plans.views import _cycle, table


def _s(number: str) -> str:
    return f"CAST({number} AS STRING)"


_K = "c_custkey"
# one row per line of a text; reads the same in both dialects
LINES = f"""
SELECT {_K} AS k, 1 AS n, 'Arbeitszeit: ' || {_cycle(_K, ('Teilzeit, Vollzeit; Teilzeit', 'keine', 'Vollzeit', 'Minijob;'))} AS line FROM {{customer}}
UNION ALL SELECT {_K}, 2, 'Preferred regions: ' || {_cycle(_K, ('Bavaria, Thuringia', 'Berlin; Hesse, berlin', 'Atlantis, Berlin', 'not specified', 'Bayern, Berlin, Bremen, Hamburg, Hessen, Sachsen'))} FROM {{customer}}
UNION ALL SELECT {_K}, 3, 'Commute: ' || {_s(f'{_K} % 60')} || CASE WHEN {_K} % 7 = 0 THEN '' ELSE ' to ' || {_s(f'{_K} % 97')} END || ' minutes' FROM {{customer}}
UNION ALL SELECT {_K}, 4, '  ' FROM {{customer}} WHERE {_K} % 2 = 0
UNION ALL SELECT {_K}, 5, 'Minimum annual salary: ' || CASE WHEN {_K} % 11 = 0 THEN 'much' ELSE {_s(f'30000 + {_K} * 37 % 50000')} || ' EUR' END FROM {{customer}}
UNION ALL SELECT {_K}, 6, 'Zielgehalt pro Jahr: ' || CASE WHEN {_K} % 10 = 0 THEN 'Nicht angegeben' ELSE {_s(f'20000 + {_K} * 91 % 60000')} END FROM {{customer}}
UNION ALL SELECT {_K}, 7, 'Work-model weights: ' || {_s(f'{_K} % 120')} || ' %, 50 %, ' || {_s(f'{_K} % 80')} || ' %' FROM {{customer}} WHERE {_K} % 3 = 0
UNION ALL SELECT {_K}, 8, 'Preferred work model: ' || {_cycle(_K, ('Hybrid', 'remote first', 'Präsenz', 'tent'))} FROM {{customer}} WHERE {_K} % 5 > 0
UNION ALL SELECT {_K}, 9, 'Include Germany-wide remote jobs: ' || {_cycle(_K, ('ja', 'No', 'perhaps'))} FROM {{customer}}
UNION ALL SELECT {_K}, 10, 'Maximum travel: ' || {_s(f'{_K} % 140')} || ' %' FROM {{customer}}
UNION ALL SELECT {_K}, 11, 'Favourite country: ' || n_name FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE {_K} % 13 = 0
UNION ALL SELECT {_K}, 12, 'Mindestgehalt pro Jahr: ' || {_s(f'40000 + {_K} % 1000')} FROM {{customer}} WHERE {_K} % 4 = 1
UNION ALL SELECT {_K}, 13, {_cycle(f'({_K} % 9)', ('I prefer Hamburg instead of Bavaria', 'Please allow remote work', 'kein Remote', 'maximum 45 minutes', 'Bevorzugt remote', 'hello'))} FROM {{customer}} WHERE {_K} % 9 < 6
UNION ALL SELECT {_K}, 14, 'Preferred industries: ' || c_mktsegment || ', Other' FROM {{customer}}
"""
_SQL_LINES = LINES.format(customer="customer", nation="nation")
_UNSET = ", ".join(f"'{x}'" for x in fixed.NOT_SPECIFIED)
_STATES = "MAP {" + ", ".join(f"'{a}': '{s}'" for a, s in fixed.STATE_ALIASES.items()) + "}"
_ITEMS = f"CASE WHEN v IN ({_UNSET}) THEN [] ELSE [trim(x) FOR x IN string_split_regex(value, '[,;]') IF trim(x) <> ''] END"

# numbers, states and modes are read from the lines; the last line without an issue sets a field
_PARSED = f"""
WITH lines AS ({_SQL_LINES}),
t AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) AS n, trim(line) AS line FROM lines),
p AS (SELECT *, contains(line, ':') AS labelled, lower(split_part(line, ':', 1)) AS label, trim(substr(line, position(':' IN line) + 1)) AS value,
    replace(lower(trim(substr(line, position(':' IN line) + 1))), 'ä', 'a') AS v FROM t WHERE line <> ''),
f AS (SELECT *, CASE label WHEN 'arbeitszeit' THEN 'types' WHEN 'preferred regions' THEN 'states' WHEN 'commute' THEN 'commute'
    WHEN 'minimum annual salary' THEN 'low' WHEN 'mindestgehalt pro jahr' THEN 'low' WHEN 'zielgehalt pro jahr' THEN 'high'
    WHEN 'work-model weights' THEN 'weights' WHEN 'preferred work model' THEN 'mode' WHEN 'include germany-wide remote jobs' THEN 'flag'
    WHEN 'maximum travel' THEN 'travel' WHEN 'preferred industries' THEN 'industries' END AS field,
    list_transform(regexp_extract_all(value, '[0-9]+'), lambda x: x::INT) AS nums, {_ITEMS} AS items FROM p),
s AS (SELECT *, CASE WHEN field = 'states' THEN [{_STATES}[lower(x)] FOR x IN items] END AS states,
    CASE WHEN contains(v, 'hybrid') THEN 'hybrid' WHEN contains(v, 'remote') THEN 'remote' WHEN contains(v, 'prasenz') THEN 'onsite' END AS mode,
    CASE WHEN v IN ('ja', 'yes') THEN true WHEN v IN ('nein', 'no') THEN false END AS flag FROM f),
i AS (SELECT *, CASE WHEN NOT labelled THEN CASE WHEN NOT regexp_matches(v, 'instead|allow|kein|maximum|bevorzugt') THEN 'unknown_instruction' END
    WHEN field IS NULL THEN 'unknown_instruction' WHEN field = 'states' AND list_count(states) < len(states) THEN 'invalid_state'
    WHEN field = 'commute' AND (len(nums) < 2 OR nums[1] > nums[2]) THEN 'invalid_commute'
    WHEN field IN ('low', 'high') AND v NOT IN ({_UNSET}) AND len(nums) = 0 THEN 'invalid_salary'
    WHEN field = 'weights' AND list_max(nums) > 100 THEN 'invalid_weights' WHEN field = 'mode' AND mode IS NULL THEN 'invalid_workplace'
    WHEN field = 'flag' AND flag IS NULL THEN 'invalid_boolean' WHEN field = 'travel' AND nums[1] > 100 THEN 'invalid_percentage' END AS issue FROM s),
g AS (SELECT k, max_by(items, n) FILTER (field = 'types') AS types, max_by(items, n) FILTER (field = 'industries') AS industries,
    max_by(CASE WHEN labelled THEN states ELSE ['Hamburg'] END, n) FILTER ((field = 'states' AND issue IS NULL) OR contains(v, 'instead')) AS states,
    max_by(nums, n) FILTER (field = 'commute' AND issue IS NULL) AS pair, bool_or(contains(v, 'maximum 45')) AS capped,
    max_by([nums[1]], n) FILTER (field = 'low' AND issue IS NULL) AS low, max_by([nums[1]], n) FILTER (field = 'high' AND issue IS NULL) AS high,
    max_by(CASE WHEN labelled THEN [x / 100.0 FOR x IN nums] ELSE [0.4, 0.7, 1.0] END, n)
      FILTER ((field = 'weights' AND issue IS NULL) OR (NOT labelled AND contains(v, 'bevorzugt'))) AS weights,
    max_by(mode, n) FILTER ((field = 'mode' AND issue IS NULL) OR (NOT labelled AND contains(v, 'bevorzugt'))) AS mode,
    max_by(CASE WHEN labelled THEN flag ELSE contains(v, 'allow') END, n)
      FILTER ((field = 'flag' AND issue IS NULL) OR (NOT labelled AND regexp_matches(v, 'allow|kein'))) AS flag,
    max_by([nums[1]], n) FILTER (field = 'travel' AND issue IS NULL) AS travel FROM i GROUP BY k),
o AS (SELECT *, CASE WHEN k % 2 = 0 THEN [1.0, 0.55, 0.2] ELSE [0.4, 0.7, 1.0] END AS old FROM g),
w AS (SELECT *, coalesce(weights, old) AS own, CASE WHEN k % 2 = 0 THEN 'onsite' ELSE 'remote' END AS before FROM o),
m AS (SELECT *, coalesce(mode, CASE WHEN own[1] >= own[2] AND own[1] >= own[3] THEN 'onsite' WHEN own[2] >= own[3] THEN 'hybrid' ELSE 'remote' END) AS after FROM w),
c AS (SELECT k, list_filter(types, lambda x, j: list_position(types, x) = j) AS types, industries, CASE WHEN states IS NULL THEN ['Berlin'] ELSE
      list_filter(states, lambda x, j: list_position(states, x) = j) END AS states, coalesce(flag, false) AS flag, after,
    CASE WHEN after <> before AND own = old THEN CASE after WHEN 'onsite' THEN [1.0, 0.55, 0.2] WHEN 'hybrid' THEN [0.75, 1.0, 0.35] ELSE [0.4, 0.7, 1.0] END
      ELSE own END AS weights, CASE WHEN capped THEN least(coalesce(pair[1], 30), 45) ELSE coalesce(pair[1], 30) END AS penalty,
    CASE WHEN capped THEN 45 ELSE coalesce(pair[2], 60) END AS most, CASE WHEN low IS NULL THEN 40000 ELSE low[1] END AS low,
    CASE WHEN high IS NULL THEN 50000 ELSE high[1] END AS high, CASE WHEN travel IS NOT NULL THEN travel[1] END AS travel FROM m)
"""


def _compiled(spark, d):
    lines = spark.sql(LINES, customer=table(spark, d, "customer"), nation=table(spark, d, "nation"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
    prompts = lines.groupBy("k").agg(F.array_join(ordered["line"], "\n").alias("prompt"))
    none, k = F.array().cast("array<string>"), F.col("c_custkey")
    weight = lambda even, odd: F.when(k % 2 == 0, even).otherwise(odd)
    current = table(spark, d, "customer").select(
        k.alias("k"), F.array(F.lit("Vollzeit")).alias("employment_types"), none.alias("contract_types"),
        F.array(F.lit("Deutsch")).alias("languages"), none.alias("industries"), none.alias("company_sizes"),
        F.array(F.lit("Berlin")).alias("preferred_states"), F.lit(False).alias("include_germany_remote"),
        F.lit(None).cast("string").alias("workplace_preference"), weight(1.0, 0.4).alias("onsite_weight"),
        weight(0.55, 0.7).alias("hybrid_weight"), weight(0.2, 1.0).alias("remote_weight"),
        F.lit(30).alias("commute_penalty_minutes"), F.lit(60).alias("max_commute_minutes"),
        F.lit(40000).cast("bigint").alias("min_salary"), F.lit(50000).cast("bigint").alias("target_salary"),
        F.lit(None).cast("bigint").alias("max_travel_percent"), F.array(F.lit("Assistenz")).alias("primary_role_terms"),
        none.alias("additional_role_terms"))
    return preferences.compile_preferences(current, prompts, "k")


@query(
    "preference_compile",
    _PARSED + """SELECT k, array_to_string(types, '|') AS employment_types, array_to_string(industries, '|') AS industries,
      array_to_string(states, '|') AS preferred_states, flag AS include_germany_remote, after AS workplace_preference,
      CAST(weights[1] AS DOUBLE) AS onsite_weight, CAST(weights[2] AS DOUBLE) AS hybrid_weight, CAST(weights[3] AS DOUBLE) AS remote_weight,
      penalty AS commute_penalty_minutes, most AS max_commute_minutes, CAST(low AS BIGINT) AS min_salary, CAST(high AS BIGINT) AS target_salary,
      CAST(travel AS BIGINT) AS max_travel_percent FROM c""",
)
def preference_compile(spark, d):
    values, _ = _compiled(spark, d)
    joined = [F.array_join(c, "|").alias(c) for c in ("employment_types", "industries", "preferred_states")]
    return values.select("k", *joined, "include_germany_remote", "workplace_preference", "onsite_weight", "hybrid_weight",
                         "remote_weight", "commute_penalty_minutes", "max_commute_minutes", "min_salary", "target_salary",
                         "max_travel_percent")


@query(
    "preference_issues",
    _PARSED + """SELECT k, CAST(n AS INT) AS line_number, line, issue AS code FROM i WHERE issue IS NOT NULL
      UNION ALL SELECT k, 0, '', 'target_below_minimum' FROM c WHERE high < low
      UNION ALL SELECT k, 0, '', 'commute_order' FROM c WHERE penalty > most
      UNION ALL SELECT k, 0, '', 'too_many_states' FROM c WHERE len(states) > 5""",
)
def preference_issues(spark, d):
    _, issues = _compiled(spark, d)
    return issues.select("k", "line_number", "line", "code")


@query(
    "preference_roles",
    """SELECT c_custkey AS k, n_name || CASE WHEN c_custkey % 2 = 0 THEN '|' || c_mktsegment ELSE '' END AS primary_role_terms,
         CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || '|' ELSE '' END || 'Empfang' AS additional_role_terms
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def preference_roles(spark, d):
    """Headed bullet lists: repeated terms go, and additional terms that are primary ones."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    even = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n- "), "c_mktsegment")).otherwise("")
    text = F.concat(F.lit("Main role terms:\n- "), "n_name", F.lit("\n* "), F.lower("n_name"), even,
                    F.lit("\n\nZusätzliche Titel:\n-"), "c_mktsegment", F.lit("\n- Empfang"))
    lists, _ = preferences.role_lists(rows.select(F.col("c_custkey").alias("k"), text.alias("taxonomy")), "k", "taxonomy")
    return lists.select("k", *[F.array_join(c, "|").alias(c) for c in ("primary_role_terms", "additional_role_terms")])
