"""Preference texts compiled into typed settings.

A text is a list of lines. A line with a label sets one field, a line of prose can set several; every
line becomes rows of (line number, field, tagged value), or a row with the reason why it can't be
used. Of the rows that set a field the last one wins, so a whole text is one aggregate per owner; rules
between fields are checked on the result. Term lists come as a second text of headed bullet lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.parse import parse_boolean, parse_percentage, parse_salary, state_alias
from vakanz.functions.text import let, letter_key, lookup
from vakanz.operators.common import open_array
from vakanz.operators.profiles import taxonomy_issues, taxonomy_split
from vakanz.operators.resumes import LINE_BREAK

LISTS = ("employment_types", "contract_types", "languages", "industries", "company_sizes")
NUMBERS = ("min_salary", "target_salary", "max_travel_percent")
MODES = ("onsite", "hybrid", "remote")
MAX_STATES, MAX_ITEMS, MAX_CHARS = 5, 20, 100

# the tagged value of a row: the one field that its kind fills
_EMPTY = {
    "items": "array<string>", "flag": "boolean", "number": "bigint", "mode": "string",
    "weights": "struct<onsite: double, hybrid: double, remote: double>", "minutes": "struct<low: int, high: int>",
}


def _tagged(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _EMPTY.items()])


def _row(field: Column | str, value: Column, issue: Column | None = None) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    wrong = F.lit(None).cast("string") if issue is None else issue
    return F.struct(name.alias("field"), value.alias("value"), wrong.cast("string").alias("issue"))


def split_items(value: Column, key: Column | None = None) -> Column:
    items = F.filter(F.transform(F.split(value, "[,;]"), lambda v: F.trim(v)), lambda v: v != "")
    key = letter_key(value) if key is None else key
    return F.when(key.isin(*fixed.NOT_SPECIFIED), F.array().cast("array<string>")).otherwise(F.array_distinct(items))


def work_mode(value: Column, key: Column | None = None) -> Column:
    key = letter_key(value) if key is None else key
    return F.when(F.contains(key, F.lit("hybrid")), "hybrid").when(key.rlike("remote|entfernt"), "remote").when(
        key.rlike("prasenz|on-site|onsite"), "onsite")


def _numbers(value: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(pattern), 1), lambda n: n.cast("int"))


def weights_of(mode: Column) -> Column:
    return F.coalesce(*[
        F.when(mode == m, F.struct(*[F.lit(w).alias(n) for n, w in zip(MODES, fixed.MODE_WEIGHTS[m])])) for m in MODES])


def labelled_row(field: Column, value: Column) -> Column:
    """The row of a labelled line: its field's parser decides the kind of value and the issue."""
    return let(F.struct(field.alias("field"), value.alias("value"), letter_key(value).alias("key")),
               lambda x: _labelled(x["field"], x["value"], x["key"]))


def _labelled(field: Column, value: Column, key: Column) -> Column:
    """Every parser stands behind its field and binds what it uses twice."""
    row = lambda tagged, issue=None: _row(field, tagged, issue)
    times = lambda t: row(
        _tagged(minutes=F.struct(F.get(t, F.lit(0)).alias("low"), F.get(t, F.lit(1)).alias("high"))),
        F.when((F.size(t) < 2) | (F.get(t, F.lit(0)) > F.get(t, F.lit(1))) | (F.get(t, F.lit(1)) > 480), "invalid_commute"))
    share = lambda s, i: (F.get(s, F.lit(i)) / 100).alias(MODES[i])
    shares = lambda s: row(
        _tagged(weights=F.struct(share(s, 0), share(s, 1), share(s, 2))),
        F.when((F.size(s) != 3) | F.exists(s, lambda v: v > 100), "invalid_weights"))

    def checked(parsed: tuple[Column, Column], issue: str) -> Column:
        return let(F.struct(parsed[0].alias("number"), parsed[1].alias("fits")), lambda p: row(
            _tagged(number=p["number"]), F.when(~p["fits"], issue)))

    states = F.array_distinct(F.transform(split_items(value, key), state_alias))
    return (
        F.when(field.isNull(), _row("", _tagged(), F.lit("unknown_instruction")))
        .when(field.isin(*LISTS), row(_tagged(items=split_items(value, key))))
        .when(field == "preferred_states", let(states, lambda s: row(
            _tagged(items=s), F.when(F.exists(s, lambda v: v.isNull()), "invalid_state"))))
        .when(field == "include_germany_remote", let(parse_boolean(value), lambda f: row(
            _tagged(flag=f), F.when(f.isNull(), "invalid_boolean"))))
        .when(field == "workplace_preference", let(work_mode(value, key), lambda m: row(
            _tagged(mode=m), F.when(m.isNull(), "invalid_workplace"))))
        .when(field == "workplace_weights", let(_numbers(value, r"([0-9]{1,3})\s*%"), shares))
        .when(field == "commute", let(_numbers(value, r"\b([0-9]{1,3})\b"), times))
        .when(field.isin("min_salary", "target_salary"), checked(parse_salary(value), "invalid_salary"))
        .when(field == "max_travel_percent", checked(parse_percentage(value), "invalid_percentage"))
    )


def states_in(line: Column) -> Column:
    """``array<struct<at,state>>`` of the states a line names, in order of their places.

    A state's place is that of its first alias, in the order of the table, that occurs.
    """
    return let(letter_key(line), _states_of_key)


def _states_of_key(key: Column) -> Column:
    by_state = {}
    for alias, state in fixed.STATE_ALIASES.items():
        by_state.setdefault(state, []).append(alias)
    found = []
    for state, aliases in by_state.items():
        at = F.coalesce(*[F.nullif(F.locate(a, key), F.lit(0)) for a in aliases])
        found.append(F.struct((at - 1).alias("at"), F.lit(state).alias("state")))
    return F.sort_array(F.filter(F.array(*found), lambda s: s["at"].isNotNull()))


def prose_rows(line: Column) -> Column:
    """Rows that a line without a label sets; one row with an issue if it sets none."""
    key = letter_key(line)
    return let(let(key, lambda k: F.struct(k.alias("key"), _states_of_key(k).alias("named"), work_mode(line, k).alias("mode"))),
               lambda x: _prose(x["key"], x["named"], x["mode"]))


def _prose(key: Column, named: Column, mode: Column) -> Column:
    prefers = key.rlike("prefer|bevorzug")
    places = let(F.least(*[F.nullif(F.locate(w, key), F.lit(0)) for w in (" instead of ", " statt ")]) - 1, lambda cut:
                 F.transform(F.filter(named, lambda s: cut.isNull() | (s["at"] < cut)), lambda s: s["state"]))
    first = F.transform(F.slice(named, 1, 1), lambda s: s["state"])
    states = let(places, lambda wanted: F.when(F.size(wanted) > 0, wanted).otherwise(first))
    refuses, allows = key.rlike("no remote|kein remote|ohne remote"), key.rlike("include|einbezieh|allow|offen")
    most = F.regexp_extract(key, fixed.COMMUTE_PATTERN, 1).try_cast("int")
    rows = F.filter(F.array(
        F.when((F.size(named) > 0) & key.rlike("prefer|bevorzug|region|state"), _row("preferred_states", _tagged(items=states))),
        F.when(F.contains(key, F.lit("remote")) & (refuses | allows), _row("include_germany_remote", _tagged(flag=~refuses))),
        F.when(mode.isNotNull() & prefers, _row("workplace_preference", _tagged(mode=mode))),
        F.when(mode.isNotNull() & prefers, _row("workplace_weights", _tagged(weights=weights_of(mode)))),
        let(most, lambda m: F.when(m.between(1, 480), _row("commute_limit", _tagged(number=m)))),
    ), lambda r: r.isNotNull())
    return let(rows, lambda found: F.when(F.size(found) > 0, found).otherwise(
        F.array(_row("", _tagged(), F.lit("unknown_instruction")))))


def _line_rows(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """``preference_rows`` with a row of nulls for a blank line or text, so that no key is lost."""
    trimmed = F.transform(F.split(F.col(prompt), LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    lines = df.select(key, F.posexplode_outer(trimmed).alias("_pos", "line"))
    label = lookup(letter_key(F.substring_index("line", ":", 1)), fixed.PREFERENCE_LABELS)
    value = F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    rows = F.when(F.col("line") != "", F.when(F.contains("line", F.lit(":")), F.array(labelled_row(label, value))).otherwise(
        prose_rows(F.col("line"))))
    return lines.select(key, (F.col("_pos") + 1).alias("line_number"), "line", F.explode_outer(rows).alias("_r")).select(
        key, "line_number", "line", "_r.*")


def preference_rows(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """key, line_number, line, field, value, issue: what every line of a text sets."""
    return _line_rows(df, key, prompt).filter("field is not null")


def role_lists(df: DataFrame, key: str, taxonomy: str) -> tuple[DataFrame, DataFrame]:
    """Headed bullet lists as (key, primary_role_terms, additional_role_terms) and their issues."""
    lines = open_array(df.filter(F.col(taxonomy).isNotNull()), [key], F.split(F.col(taxonomy), LINE_BREAK), "_raw", "_pos")
    line = F.regexp_replace("_raw", r"(?U)^\s+|\s+$", "")
    lines = lines.select(key, (F.col("_pos") + 1).alias("line_number"), line.alias("line"))
    is_head = F.col("line").endswith(":")
    head = F.when(is_head, lookup(letter_key(F.regexp_replace("line", ":$", "")), fixed.ROLE_SECTION_LABELS))
    order = Window.partitionBy(key).orderBy("line_number")
    lines = lines.withColumn("_head", head).withColumn("_list", F.last("_head", ignorenulls=True).over(order))
    bullet = F.col("line").rlike(r"^[-*]\s*\S") & F.col("_list").isNotNull()
    issue = F.when(F.col("line") == "", None).when(is_head, F.when(F.col("_head").isNull(), "unknown_role_section")).when(
        ~bullet, "invalid_role_term")
    term = F.when(~is_head & bullet, F.struct("line_number", F.trim(F.substr("line", F.lit(2))).alias("term")))
    lines = lines.select(key, "line_number", "line", "_list", issue.alias("issue"), term.alias("_term"))
    listed = lambda name: F.array_sort(F.collect_list(F.when(F.col("_list") == name, F.col("_term"))))["term"]
    found = lines.groupBy(key).agg(listed("primary_role_terms").alias("_p"), listed("additional_role_terms").alias("_a"))
    primary, more = taxonomy_split(F.col("_p"), F.col("_a"))
    found = found.select(key, primary.alias("primary_role_terms"), more.alias("additional_role_terms"))
    whole = found.select(key, F.explode(taxonomy_issues(F.col("primary_role_terms"), F.col("additional_role_terms"))).alias("issue"))
    issues = lines.filter("issue is not null").select(key, "line_number", "line", "issue").unionByName(
        whole.select(key, F.lit(0).alias("line_number"), F.lit("").alias("line"), "issue"))
    return found, issues


def main_mode(choice: Column, onsite: Column, hybrid: Column, remote: Column) -> Column:
    """The chosen mode, else the first of the greatest weight."""
    top = F.greatest(onsite, hybrid, remote)
    return F.when(choice.isin(*MODES), choice).otherwise(
        F.when(onsite == top, "onsite").when(hybrid == top, "hybrid").otherwise("remote"))


def compile_preferences(
    current: DataFrame, prompts: DataFrame, key: str, prompt: str = "prompt", taxonomy: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """New settings of every owner of a text, and all issues (key, source, line_number, line, code).

    ``current`` has the list fields, ``preferred_states``, ``include_germany_remote``, the three weights,
    ``commute_penalty_minutes``, ``max_commute_minutes``, the number fields, ``workplace_preference`` and
    the two role lists, in one row per owner. A field that no line sets keeps its value. A commute limit in prose also lowers
    the penalty minutes set before it. A changed mode without changed weights gets that mode's weights.
    """
    rows = _line_rows(prompts, key, prompt)
    number = F.col("line_number")

    def last(field: str) -> Column:
        return F.max_by(F.when((F.col("field") == field) & F.col("issue").isNull(), F.col("value")),
                        F.when((F.col("field") == field) & F.col("issue").isNull(), number)).alias(f"_{field}")

    single = [*LISTS, "preferred_states", "include_germany_remote", "workplace_preference", "workplace_weights", *NUMBERS]
    is_limit = (F.col("field") == "commute_limit") & F.col("issue").isNull()
    is_pair = (F.col("field") == "commute") & F.col("issue").isNull()
    pair = F.struct(number.alias("at"), F.col("value.minutes.low").alias("low"), F.col("value.minutes.high").alias("high"))
    limit = F.struct(number.alias("at"), F.col("value.number").cast("int").alias("most"))
    found = rows.groupBy(key).agg(
        *[last(f) for f in single], F.max(F.when(is_pair, pair)).alias("_pair"),
        F.collect_list(F.when(is_limit, limit)).alias("_limits"),
        F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("line_number", "line", F.col("issue").alias("code")))).alias(
            "_issues"))
    # the lines are read once: settings and issues come from the same row
    joined = found.join(current.withColumn("_current", F.lit(True)), key, "left")
    limits = F.filter(F.coalesce("_limits", F.array().cast("array<struct<at: int, most: int>>")),
                      lambda x: F.col("_pair").isNull() | (x["at"] > F.col("_pair.at")))
    newest = F.try_element_at(F.sort_array(limits), F.lit(-1))
    low = F.coalesce("_pair.low", "commute_penalty_minutes")
    kept = lambda f, part: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")[part]).otherwise(F.col(f))
    shares = [F.coalesce(F.col("_workplace_weights.weights")[m], F.col(f"{m}_weight")) for m in MODES]
    before = main_mode(F.col("workplace_preference"), *[F.col(f"{m}_weight") for m in MODES])
    after = main_mode(kept("workplace_preference", "mode"), *shares)
    same_weights = shares[0] == F.col("onsite_weight")
    for m, s in zip(MODES[1:], shares[1:]):
        same_weights = same_weights & (s == F.col(f"{m}_weight"))
    reset = (before != after) & same_weights
    weight = lambda m, s: F.when(reset, weights_of(after)[m]).otherwise(s).alias(f"{m}_weight")
    has_limits = F.size(limits) > 0
    settled = joined.select(
        key, "_issues", "_current", *[kept(f, "items").alias(f) for f in (*LISTS, "preferred_states")],
        kept("include_germany_remote", "flag").alias("include_germany_remote"),
        after.alias("workplace_preference"), *[weight(m, s) for m, s in zip(MODES, shares)],
        F.when(has_limits, F.least(low, F.array_min(F.transform(limits, lambda x: x["most"])))).otherwise(low).alias(
            "commute_penalty_minutes"),
        F.when(has_limits, newest["most"]).otherwise(F.coalesce("_pair.high", "max_commute_minutes")).alias(
            "max_commute_minutes"),
        *[kept(f, "number").alias(f) for f in NUMBERS], "primary_role_terms", "additional_role_terms",
    )
    compiled = settled.filter("_current").drop("_issues", "_current")
    too_large = [F.when((F.size(f) > MAX_ITEMS) | F.exists(f, lambda v: F.length(v) > MAX_CHARS), "list_too_large")
                 for f in LISTS]
    rules = F.filter(F.array(
        F.when(F.col("target_salary") < F.col("min_salary"), "target_below_minimum"),
        F.when(F.col("commute_penalty_minutes") > F.col("max_commute_minutes"), "commute_order"),
        F.when(F.size("preferred_states") > MAX_STATES, "too_many_states"), *too_large), lambda c: c.isNotNull())
    broken = F.transform(rules, lambda c: F.struct(F.lit(0).alias("line_number"), F.lit("").alias("line"), c.alias("code")))
    every = F.when(F.col("_current"), F.concat("_issues", broken)).otherwise(F.col("_issues"))
    issues = open_array(settled, [key], every, "_i").select(key, F.lit("preference_prompt").alias("source"), "_i.*")
    if taxonomy:
        lists, role_issues = role_lists(prompts, key, taxonomy)
        compiled = compiled.join(lists.select(key, F.struct("primary_role_terms", "additional_role_terms").alias("_l")), key, "left")
        for f in ("primary_role_terms", "additional_role_terms"):
            compiled = compiled.withColumn(f, F.when(F.col("_l").isNotNull(), F.col("_l")[f]).otherwise(F.col(f)))
        compiled = compiled.drop("_l")
        issues = issues.unionByName(role_issues.select(
            key, F.lit("role_taxonomy").alias("source"), "line_number", "line", F.col("issue").alias("code")))
    return compiled, issues
