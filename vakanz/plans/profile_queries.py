"""Profile text, preference versions and term lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz.operators import profiles
from vakanz.plans.registry import query
from vakanz.plans.views import table

_SHORT = r"^\s*\S+(?:\s+\S+){0,2}\s*$"


@query(
    "text_sections",
    r"""WITH l AS (SELECT doc_id, trim(line) AS line, pos FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line,
         generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM documents) WHERE trim(line) <> ''),
       h AS (SELECT *, regexp_matches(line, '^\s*\S+(?:\s+\S+){0,2}\s*$') AS is_h FROM l),
       s AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM h),
       w AS (SELECT *, first_value(line) OVER (PARTITION BY doc_id, section_no ORDER BY pos) AS head FROM s)
       SELECT doc_id, CAST(section_no AS INT) AS section_no, CASE WHEN section_no > 0 THEN head END AS heading, line, count(*) AS n
       FROM w WHERE NOT is_h GROUP BY ALL""",
)
def text_sections(spark, d):
    rows = profiles.text_sections(table(spark, d, "documents"), "doc_id", "text", _SHORT)
    return rows.groupBy("doc_id", "section_no", "heading", "line").agg(F.count("*").alias("n"))


_SKILLS = {"Der": ("der", "die"), "The": ("the",), "Pour": ("pour", "para"), "Is": ("is",)}
_EDGE = r"(?:^|[^\p{L}\p{N}_])"


@query(
    "skill_mentions",
    " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS skill FROM documents WHERE regexp_matches(replace(lower(text), 'ß', 'ss'), "
        f"'{_EDGE}(?:{'|'.join(words)})(?:$|[^\\p{{L}}\\p{{N}}_])')"
        for name, words in _SKILLS.items()
    ),
)
def skill_mentions(spark, d):
    from vakanz.operators.common import open_array

    found = profiles.term_mentions(F.col("text"), _SKILLS)
    return open_array(table(spark, d, "documents"), ["doc_id"], found, "skill")


_MONTHS = "['Jan', 'Feb', 'März', 'Apr', 'Mai', 'Jun', 'Juli', 'August', 'Sept', 'Okt', 'Nov', 'Dezember']"


@query(
    "period_intervals",
    """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
       SELECT o_orderkey, y * 12 + CASE o_orderkey % 4 WHEN 2 THEN 0 ELSE m - 1 END AS start_month,
         CASE o_orderkey % 4 WHEN 0 THEN (y + 1) * 12 + m - 1 WHEN 1 THEN 2024 * 12 + 6 WHEN 2 THEN (y + 2) * 12 + 11 ELSE y * 12 + m - 1 END AS end_month FROM o""",
)
def period_intervals(spark, d):
    """Named months, an open end, years only, and numeric months, by row."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
    )
    names = F.array(*[F.lit(x.strip(" '")) for x in _MONTHS.strip("[]").split(",")])
    month, y = F.element_at(names, F.col("m")), F.col("y").cast("string")
    number = F.col("m").cast("string")
    k = F.col("o_orderkey") % 4
    period = (
        F.when(k == 0, F.concat(month, F.lit(". "), y, F.lit(" – "), month, F.lit(" "), (F.col("y") + 1).cast("string")))
        .when(k == 1, F.concat(F.lit("seit "), month, F.lit(" "), y))
        .when(k == 2, F.concat(y, F.lit(" - "), (F.col("y") + 2).cast("string")))
        .otherwise(F.concat(number, F.lit("/"), y))
    )
    found = profiles.period_interval(period, F.lit(2024 * 12 + 6))
    return o.select(
        "o_orderkey", found["start"].alias("start_month"), found["end"].alias("end_month")
    )


@query(
    "interval_union",
    """WITH i AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + CAST(o_orderkey % 4 AS INT) AS e FROM orders),
       m AS (SELECT DISTINCT o_custkey, unnest(range(s, e + 1)) AS month FROM i)
       SELECT o_custkey, count(*) AS months, CAST(least(60, floor(count(*) / 12)) AS INT) AS years FROM m GROUP BY o_custkey""",
)
def interval_union(spark, d):
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    rows = table(spark, d, "orders").select(
        "o_custkey", start.alias("s"), (start + (F.col("o_orderkey") % 4).cast("int")).alias("e")
    )
    return profiles.interval_union(rows, "o_custkey", "s", "e")


@query(
    "config_diff",
    """WITH b AS (SELECT c_custkey, c_nationkey AS min_salary, c_mktsegment AS preferred_states, CAST(NULL AS VARCHAR) AS languages FROM customer),
       a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS min_salary,
         CASE WHEN c_custkey % 3 = 0 THEN 'ALL' ELSE c_mktsegment END AS preferred_states, CASE WHEN c_custkey % 5 = 0 THEN 'de' END AS languages FROM customer)
       SELECT b.c_custkey, 'min_salary' AS field, CAST(b.min_salary AS VARCHAR) AS before, CAST(a.min_salary AS VARCHAR) AS after, false AS requires_refresh FROM b JOIN a ON a.c_custkey = b.c_custkey WHERE a.min_salary IS DISTINCT FROM b.min_salary
       UNION ALL SELECT b.c_custkey, 'preferred_states', b.preferred_states, a.preferred_states, true FROM b JOIN a ON a.c_custkey = b.c_custkey WHERE a.preferred_states IS DISTINCT FROM b.preferred_states
       UNION ALL SELECT b.c_custkey, 'languages', b.languages, a.languages, false FROM b JOIN a ON a.c_custkey = b.c_custkey WHERE a.languages IS DISTINCT FROM b.languages""",
)
def config_diff(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    before = c.select(
        "c_custkey", F.col("c_nationkey").alias("min_salary"),
        F.col("c_mktsegment").alias("preferred_states"), F.lit(None).cast("string").alias("languages"),
    )
    after = c.select(
        "c_custkey",
        F.when(k % 2 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("min_salary"),
        F.when(k % 3 == 0, "ALL").otherwise(F.col("c_mktsegment")).alias("preferred_states"),
        F.when(k % 5 == 0, "de").alias("languages"),
    )
    return profiles.config_diff(
        before, after, "c_custkey", ["min_salary", "preferred_states", "languages"]
    )


@query(
    "taxonomy_split",
    """SELECT p_partkey, p_brand AS primary_terms, concat_ws('|', p_type, CASE WHEN p_partkey % 2 = 1 THEN 'Other' END) AS additional_terms FROM part""",
)
def taxonomy_split(spark, d):
    second = F.when(F.col("p_partkey") % 2 == 1, "Other").otherwise(F.upper("p_brand"))
    first, rest = profiles.taxonomy_split(
        F.array("p_brand", F.lower("p_brand")), F.array("p_type", second, F.lit(" "))
    )
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(first, "|").alias("primary_terms"),
        F.array_join(rest, "|").alias("additional_terms"),
    )


@query(
    "taxonomy_expand",
    """WITH known AS (SELECT DISTINCT o_custkey, lower(o_orderpriority) AS f FROM orders WHERE o_orderkey % 4 = 0),
       sz AS (SELECT o_custkey, count(*) AS n FROM known GROUP BY 1),
       sug AS (SELECT o_custkey, lower(o_orderpriority) AS f, arg_min(upper(o_orderpriority), o_orderkey) AS term, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2),
       fresh AS (SELECT s.* FROM sug s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.o_custkey = s.o_custkey AND k.f = s.f)),
       r AS (SELECT f.o_custkey, term, row_number() OVER (PARTITION BY f.o_custkey ORDER BY pos) AS position, coalesce(sz.n, 0) AS n FROM fresh f LEFT JOIN sz ON sz.o_custkey = f.o_custkey)
       SELECT o_custkey, term, CAST(position AS INT) AS position FROM r WHERE position + n <= 4""",
)
def taxonomy_expand(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    known = o.filter("o_orderkey % 4 = 0").withColumnRenamed("o_orderpriority", "term")
    suggested = o.filter("o_orderkey % 4 <> 0").select(
        "o_custkey", F.upper("o_orderpriority").alias("term"), F.col("o_orderkey").alias("pos")
    )
    return profiles.taxonomy_expand(known, suggested, "o_custkey", "term", "pos", limit=4)


@query(
    "profile_versions",
    """SELECT user_id, event_id, value, row_number() OVER w AS version, lead(ts) OVER w AS valid_to FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def profile_versions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", "ts")
    rows = profiles.profile_versions(e, "user_id", "ts", ["ts", "event_id"], ["value"])
    return rows.select("user_id", "event_id", "value", "version", "valid_to")


@query(
    "child_list_sync",
    """WITH s AS (SELECT o_custkey, lower(o_orderpriority) AS f, min(o_totalprice) AS lat FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
       w AS (SELECT o_custkey, lower(o_orderpriority) AS f, arg_min(o_orderpriority, o_orderkey) AS t, min(o_orderkey) AS position FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
       SELECT coalesce(s.o_custkey, w.o_custkey) AS o_custkey, coalesce(w.t, s.f) AS address_text, w.position, s.lat AS latitude,
         CASE WHEN w.f IS NULL THEN 'removed' WHEN s.f IS NULL THEN 'added' ELSE 'kept' END AS action
       FROM s FULL OUTER JOIN w ON w.o_custkey = s.o_custkey AND w.f = s.f""",
)
def child_list_sync(spark, d):
    o = table(spark, d, "orders")
    stored = (
        o.filter("o_orderkey % 2 = 0").groupBy("o_custkey", "o_orderpriority")
        .agg(F.min("o_totalprice").alias("latitude"))
        .withColumnRenamed("o_orderpriority", "address_text")
        .withColumn("longitude", F.lit(0.0))
    )
    wanted = o.filter("o_orderkey % 3 = 0").select(
        "o_custkey", F.col("o_orderpriority").alias("address_text"), F.col("o_orderkey").alias("position")
    )
    rows = profiles.child_list_sync(stored, wanted, "o_custkey", "address_text")
    return rows.select("o_custkey", "address_text", "position", "latitude", "action")


@query(
    "minimized_profile",
    """SELECT c_custkey, concat('Rolle: ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN concat('; Jahre im Beruf: ', CAST(c_nationkey AS VARCHAR)) ELSE '' END) AS summary,
       concat(c_mktsegment, '|Excel') AS skills, CASE c_custkey % 3 WHEN 0 THEN 'Präsenz' WHEN 1 THEN 'Hybrid' ELSE 'Remote' END AS preferred_mode FROM customer""",
)
def minimized_profile(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name",
        F.col("c_mktsegment").alias("current_title"),
        F.when(k % 2 == 0, F.col("c_nationkey")).alias("experience_years"),
        F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit(""), F.lit("Excel")).alias("skills"),
        F.array(F.lit("de")).alias("languages"),
        F.lit(0.5).alias("onsite_weight"),
        F.when(k % 3 == 0, 0.5).otherwise(0.7).alias("hybrid_weight"),
        F.when(k % 3 == 2, 1.0).otherwise(0.2).alias("remote_weight"),
    )
    return profiles.minimized_profile(rows, "c_custkey").select(
        "c_custkey", "summary", F.array_join("skills", "|").alias("skills"), "preferred_mode"
    )


@query(
    "redundant_evidence",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE concat('Segment: ', c_mktsegment) END AS source_text FROM customer""",
)
def redundant_evidence(spark, d):
    m = F.col("c_custkey") % 3
    field = F.when(m == 1, "current_title").otherwise("skills")
    source = F.when(m == 0, F.concat(F.lit("- "), F.lower("c_mktsegment"), F.lit("!"))).otherwise(
        F.concat(F.lit("Segment: "), "c_mktsegment")
    )
    return table(spark, d, "customer").select(
        "c_custkey", profiles.redundant_evidence(field, F.col("c_mktsegment"), source).alias("source_text")
    )


@query(
    "evidence_groups",
    """WITH f AS (SELECT o_custkey, o_orderstatus, lower(o_orderpriority) AS k, min(o_orderkey) AS pos, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1, 2, 3)
       SELECT o_custkey, o_orderstatus AS field, string_agg(v, ', ' ORDER BY pos) AS value FROM f GROUP BY 1, 2""",
)
def evidence_groups(spark, d):
    rows = table(spark, d, "orders").select(
        "o_custkey", F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("value"),
        F.col("o_orderkey").alias("pos"),
    )
    return profiles.group_evidence(rows, ["o_custkey", "field"])


@query(
    "preference_lines",
    """SELECT c_custkey, 1 AS line_number, 'min_salary' AS field, CAST(c_custkey AS VARCHAR) AS value, NULL AS issue FROM customer
       UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 2 = 0 THEN 'company_sizes' END, c_mktsegment, CASE WHEN c_custkey % 2 = 1 THEN 'unknown_instruction' END FROM customer""",
)
def preference_lines(spark, d):
    from vakanz import fixed

    label = F.when(F.col("c_custkey") % 2 == 0, "Bevorzugte Unternehmensgrößen").otherwise("Farbe")
    prompt = F.concat(
        F.lit("Mindestgehalt pro Jahr: "), F.col("c_custkey").cast("string"), F.lit("\n\n"), label,
        F.lit(": "), "c_mktsegment",
    )
    rows = table(spark, d, "customer").select("c_custkey", prompt.alias("prompt"))
    found = profiles.preference_lines(rows, "c_custkey", "prompt", fixed.PREFERENCE_LABELS)
    return found.select("c_custkey", "line_number", "field", "value", "issue")
