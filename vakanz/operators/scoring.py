"""Rubric relevance and adaptive fit score, each one projection over the posting."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.parse import coerce_list, first_number
from vakanz.functions.text import matching_terms, normalize_text, py_normalize

REASON = (
    "struct<code:string,label:string,effect:string,points:double,possible_points:double,"
    "evidence:array<string>,explanation:string>"
)


@dataclass(frozen=True)
class Group:
    code: str
    label: str
    possible: int
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Rubric:
    """Weighted term groups, title terms and terms that mark an unrelated role."""

    groups: tuple[Group, ...]
    title_terms: tuple[str, ...]
    false_friends: tuple[str, ...]
    title_points: int = 15
    penalty: int = 20


DEFAULT_RUBRIC = Rubric(
    tuple(Group(*g) for g in fixed.ROLE_GROUPS), fixed.TITLE_TERMS, fixed.FALSE_FRIENDS
)


def group_points(possible: int, matches: int) -> Decimal:
    """Exact points of a group: 65 % for the first match, 12 % for each further one."""
    share = min(Decimal(1), Decimal("0.65") + Decimal("0.12") * (matches - 1))
    return possible * share if matches else Decimal(0)


def shown_points(possible: int, matches: int) -> float:
    """Points of a group as reported, one decimal."""
    exact = group_points(possible, matches)
    return float(exact.quantize(Decimal("0.1"), ROUND_HALF_EVEN))


def _by_count(n: Column, possible: int, value: Callable[[int, int], float | Decimal]) -> Column:
    result = F.when(n == 0, F.lit(value(possible, 0)))
    for matches in (1, 2, 3):
        result = result.when(n == matches, F.lit(value(possible, matches)))
    return result.otherwise(F.lit(value(possible, 4)))


def reason(
    code: str, label: str, effect: Column, points: Column, possible: Column, evidence: Column,
    explanation: Column,
) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(label).alias("label"),
        effect.alias("effect"),
        points.cast("double").alias("points"),
        possible.cast("double").alias("possible_points"),
        evidence.cast("array<string>").alias("evidence"),
        explanation.alias("explanation"),
    ).cast(REASON)


def rubric_score(
    df: DataFrame,
    title: str,
    body: str,
    rubric: Rubric = DEFAULT_RUBRIC,
    extra_title_terms: Sequence[str] = (),
    value: str = "relevance",
    reasons: str | None = "relevance_reasons",
) -> DataFrame:
    """Add the relevance value (0..100) and, unless switched off, its reasons.

    The folded text is computed once and dropped again; there is no shuffle and no UDF.
    """
    title_terms = tuple(
        dict.fromkeys(py_normalize(t) for t in (*rubric.title_terms, *extra_title_terms))
    )
    df = df.withColumn("_title", normalize_text(F.col(title)))
    df = df.withColumn("_body", normalize_text(F.col(body)))
    for i, group in enumerate(rubric.groups):
        df = df.withColumn(
            f"_g{i}", matching_terms(F.col("_body"), [py_normalize(t) for t in group.terms])
        )
    df = df.withColumn("_gt", matching_terms(F.col("_title"), title_terms))
    both = F.concat_ws(" ", "_title", "_body")
    df = df.withColumn(
        "_gf", matching_terms(both, [py_normalize(t) for t in rubric.false_friends])
    )
    unrelated = (F.size("_gf") > 0) & (F.size("_g0") == 0)

    total = F.when(F.size("_gt") > 0, F.lit(Decimal(rubric.title_points))).otherwise(
        F.lit(Decimal(0))
    )
    total = total - F.when(unrelated, F.lit(Decimal(rubric.penalty))).otherwise(F.lit(Decimal(0)))
    for i, group in enumerate(rubric.groups):
        total = total + _by_count(F.size(f"_g{i}"), group.possible, group_points)
    clamped = F.greatest(F.lit(Decimal(0)), F.least(F.lit(Decimal(100)), total))
    df = df.withColumn(value, F.round(clamped, 1).cast("double"))

    if reasons is not None:
        items = []
        for i, group in enumerate(rubric.groups):
            n = F.size(f"_g{i}")
            items.append(
                reason(
                    group.code,
                    group.label,
                    F.when(n > 0, "positive").otherwise("neutral"),
                    _by_count(n, group.possible, shown_points),
                    F.lit(group.possible),
                    F.slice(f"_g{i}", 1, 5),
                    F.when(n > 0, "Terms of this group occur in the posting.").otherwise(
                        "No term of this group occurs."
                    ),
                )
            )
        hit = F.size("_gt") > 0
        items.append(
            reason(
                "role_title",
                "Title terms",
                F.when(hit, "positive").otherwise("neutral"),
                F.when(hit, rubric.title_points).otherwise(0),
                F.lit(rubric.title_points),
                F.slice("_gt", 1, 3),
                F.when(
                    hit,
                    "A wanted term occurs in the title.",
                ).otherwise("No wanted term occurs in the title."),
            )
        )
        negative = reason(
            "unrelated_assistance",
            "Unrelated role",
            F.lit("negative"),
            F.lit(-rubric.penalty),
            F.lit(0),
            F.col("_gf"),
            F.lit("Only terms of unrelated roles occur."),
        )
        items.append(F.when(unrelated, negative))
        df = df.withColumn(reasons, F.filter(F.array(*items), lambda r: r.isNotNull()))
    helper = ["_title", "_body", "_gt", "_gf", *[f"_g{i}" for i in range(len(rubric.groups))]]
    return df.drop(*helper)


# --- fit score ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Profile:
    """What a posting is compared with: confirmed skills and preferences."""

    skills: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    contract_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    onsite_weight: float | None = 1.0
    hybrid_weight: float | None = 0.55
    remote_weight: float | None = 0.2
    commute_penalty_minutes: int = 60
    max_commute_minutes: int = 75
    min_salary: int | None = None
    target_salary: int | None = None
    industries: tuple[str, ...] = ()
    company_sizes: tuple[str, ...] = ()
    max_travel_percent: int | None = None
    role_terms: tuple[str, ...] = ()
    has_preferences: bool = True
    version: int = 1
    preference_version: int = 1


@dataclass(frozen=True)
class Dimension:
    """One part of the fit score: points out of possible, null possible when data is missing."""

    code: str
    label: str
    points: Column
    possible: Column
    effect: Column
    evidence: Column
    explanation: Column
    silent: bool = False


def _set(values: Sequence[str]) -> list[str]:
    return sorted({py_normalize(v) for v in values} - {""})


def _normal_set(values: Column) -> Column:
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_text)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda v: v != "")))


def _mutual(value: Column, wanted: Sequence[str]) -> Column:
    """One text contains the other, for any wanted text."""
    result = F.lit(False)
    for w in wanted:
        result = result | F.contains(value, F.lit(w)) | F.contains(F.lit(w), value)
    return result


def _mutual_with(wanted: Sequence[str]) -> Callable[[Column], Column]:
    return lambda value: _mutual(value, wanted)


def _choice(
    code: str, label: str, known: Column, matched: Column, weight: int, evidence: Column,
    good: str, bad: str,
) -> Dimension:
    return Dimension(
        code,
        label,
        F.when(matched, weight).otherwise(0).cast("double"),
        F.when(known, F.lit(float(weight))),
        F.when(matched, "positive").otherwise("negative"),
        evidence,
        F.when(matched, good).otherwise(bad),
        silent=True,
    )


def fit_dimensions(columns: Mapping[str, Column], profile: Profile) -> list[Dimension]:
    """The ten built-in dimensions over posting columns.

    ``columns`` names: employment_type, contract_type, language, remote_type,
    required_skills, industries, company_sizes (arrays of normalized text), commute_minutes,
    salary, travel_percent (numbers). A missing entry behaves like a column of nulls.
    """

    def col(name: str, kind: str = "string") -> Column:
        return columns.get(name, F.lit(None).cast(kind))

    dims: list[Dimension] = []
    none = F.array().cast("array<string>")

    required = F.coalesce(col("required_skills", "array<string>"), none)
    own = _set(profile.skills)
    owned = F.array(*[F.lit(s) for s in own]) if own else none
    overlap = F.array_sort(F.array_intersect(required, owned))
    known = (F.size(required) > 0) & F.lit(bool(own))
    dims.append(
        Dimension(
            "skills",
            "Skills in common",
            35 * F.try_divide(F.size(overlap).cast("double"), F.size(required)),
            F.when(known, F.lit(35.0)),
            F.when(F.size(overlap) > 0, "positive").otherwise("negative"),
            F.slice(overlap, 1, 8),
            F.when(
                known,
                F.concat(
                    F.size(overlap).cast("string"),
                    F.lit(" of "),
                    F.size(required).cast("string"),
                    F.lit(" required skills are in the profile."),
                ),
            ).otherwise("The posting or the profile names no skills."),
        )
    )

    for name, label, wanted, weight, good, bad in (
        ("employment_type", "Employment type", profile.employment_types, 15,
         "Wanted employment type.", "Other employment type."),
        ("contract_type", "Contract type", profile.contract_types, 10,
         "Wanted contract type.", "Other contract type."),
    ):
        text, choice = normalize_text(col(name)), _set(wanted)
        dims.append(
            _choice(name, label, (text != "") & F.lit(bool(choice)), _mutual(text, choice),
                    weight, F.array(F.coalesce(col(name), F.lit(""))), good, bad)
        )

    spoken, language = _set(profile.languages), normalize_text(col("language"))
    alias = language
    for long, short in fixed.LANGUAGE_ALIASES.items():
        alias = F.when(language == long, F.lit(short)).otherwise(alias)
    fits = language.isin(*spoken) | alias.isin(*spoken) if spoken else F.lit(False)
    dims.append(
        _choice("language", "Language of the posting", (language != "") & F.lit(bool(spoken)), fits, 10,
                F.array(F.coalesce(col("language"), F.lit(""))),
                "A language of the profile.", "Not a language of the profile.")
    )

    has = F.lit(profile.has_preferences)
    mode = normalize_text(F.coalesce(F.nullif(col("remote_type"), F.lit("")), F.lit("onsite")))

    def weight_of(value: float | None, default: float) -> float:
        return max(0.0, min(1.0, default if value is None else value))

    weight = (
        F.when(mode.isin(*fixed.REMOTE_MODES), F.lit(weight_of(profile.remote_weight, 0.2)))
        .when(mode == "hybrid", F.lit(weight_of(profile.hybrid_weight, 0.55)))
        .otherwise(F.lit(weight_of(profile.onsite_weight, 1.0)))
    )
    dims.append(
        Dimension(
            "work_mode",
            "Workplace",
            20 * weight,
            F.when(has, F.lit(20.0)),
            F.when(weight >= 0.75, "positive").when(weight < 0.4, "negative").otherwise("neutral"),
            F.array(F.coalesce(F.nullif(col("remote_type"), F.lit("")), F.lit("Präsenz"))),
            F.lit("Points by the profile's weight of this workplace."),
            silent=True,
        )
    )

    start = profile.commute_penalty_minutes or 60
    limit = max(start, profile.max_commute_minutes or 75)
    minutes = col("commute_minutes", "bigint").cast("bigint")
    commutes = has & minutes.isNotNull() & ~mode.isin(*fixed.REMOTE_MODES)
    dims.append(
        Dimension(
            "commute",
            "Commute, one way",
            F.when(minutes <= start, F.lit(10.0))
            .when(minutes >= limit, F.lit(0.0))
            .otherwise((limit - minutes) * 10.0 / max(1, limit - start)),
            F.when(commutes, F.lit(10.0)),
            F.when(minutes <= start, "positive").when(minutes >= limit, "negative")
            .otherwise("neutral"),
            F.array(F.concat(minutes.cast("string"), F.lit(" min"))),
            F.when(commutes, "Full points up to the first limit, none from the second.").otherwise(
                "No commute known; not counted."
            ),
        )
    )

    salary = col("salary", "bigint").cast("bigint")
    low = profile.min_salary
    goal = profile.target_salary or low or 0
    paid = has & salary.isNotNull() & F.lit(low is not None)
    dims.append(
        Dimension(
            "salary",
            "Salary",
            F.when(salary >= goal, F.lit(10.0))
            .when(salary >= (low or 0), 5 + (salary - (low or 0)) * 5.0 / max(1, goal - (low or 0)))
            .otherwise(F.lit(0.0)),
            F.when(paid, F.lit(10.0)),
            F.when(salary >= goal, "positive").when(salary >= (low or 0), "neutral")
            .otherwise("negative"),
            F.array(
                F.concat(F.translate(F.format_number(salary, 0), ",", "."), F.lit(" EUR a year"))
            ),
            F.when(paid, "Points between the profile's minimum and target.").otherwise(
                "No salary known; not counted."
            ),
        )
    )

    for code, name, label, wanted, points, good, bad in (
        ("industry", "industries", "Industry", profile.industries, 10,
         "Wanted industry.",
         "Other industry."),
        ("company_size", "company_sizes", "Company size", profile.company_sizes, 5,
         "Wanted company size.",
         "Other company size."),
    ):
        values, choice = F.coalesce(col(name, "array<string>"), none), _set(wanted)
        hit = F.exists(values, _mutual_with(choice))
        dims.append(
            _choice(code, label, (F.size(values) > 0) & F.lit(bool(choice)), hit, points, values,
                    good, bad)
        )

    travel = col("travel_percent", "int").cast("int")
    cap = profile.max_travel_percent
    dims.append(
        _choice("travel", "Travel", travel.isNotNull() & F.lit(cap is not None),
                travel <= (cap or 0), 5, F.array(F.concat(travel.cast("string"), F.lit(" %"))),
                "Travel within the limit.",
                "Travel above the limit.")
    )
    return dims


def fit_score(
    df: DataFrame,
    columns: Mapping[str, Column],
    profile: Profile,
    structured: str | None = None,
    extra: Sequence[Callable[[Mapping[str, Column]], Dimension]] = (),
    value: str = "fit",
    reasons: str | None = "fit_reasons",
) -> DataFrame:
    """Add the fit value: earned over possible points of the dimensions with enough data.

    ``structured`` names a JSON column whose details add to ``columns``; it is read once.
    ``extra`` registers further dimensions. With no usable dimension the value is 50.
    Inputs are computed in a projection of their own, so each is evaluated once per row.
    """
    if structured is not None:
        df = df.withColumn("_details", F.from_json(structured, "map<string,string>"))
        columns = {**structured_columns(F.col("_details")), **columns}
    inputs = {n: f"_in_{n}" for n in columns}
    df = df.select(
        "*",
        *[
            (_normal_set(c) if n in LIST_INPUTS else c).alias(inputs[n])
            for n, c in columns.items()
        ],
    )
    columns = {n: F.col(alias) for n, alias in inputs.items()}
    dims = [*fit_dimensions(columns, profile), *(make(columns) for make in extra)]
    names = [f"_d{i}" for i in range(len(dims))]
    df = df.select(
        "*",
        *[
            F.struct(
                F.when(d.possible.isNotNull(), d.points).otherwise(0.0).alias("p"),
                F.coalesce(d.possible, F.lit(0.0)).alias("o"),
            ).alias(n)
            for d, n in zip(dims, names)
        ],
    )
    earned, possible = F.lit(0.0), F.lit(0.0)
    for n in names:
        earned, possible = earned + F.col(n)["p"], possible + F.col(n)["o"]
    score = F.when(possible == 0, F.lit(50.0)).otherwise(100 * earned / possible)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    df = df.withColumn(value, F.round(score.cast("decimal(12,6)"), 1).cast("double"))
    if reasons is not None:
        items = []
        for d, n in zip(dims, names):
            known = F.col(n)["o"] > 0
            shown = reason(
                d.code, d.label, F.when(known, d.effect).otherwise("neutral"),
                F.round(F.col(n)["p"], 1), F.col(n)["o"],
                F.when(known, d.evidence).otherwise(F.array().cast("array<string>")),
                d.explanation,
            )
            items.append(F.when(known, shown) if d.silent else shown)
        empty = reason(
            "insufficient_profile_data", "Profile too empty", F.lit("neutral"),
            F.lit(0), F.lit(0), F.array(),
            F.lit("The start value stands until the profile has more."),
        )
        items.append(F.when(possible == 0, empty))
        df = df.withColumn(reasons, F.filter(F.array(*items), lambda r: r.isNotNull()))
    return df.drop(*names, *inputs.values(), "_details")


LIST_INPUTS = ("required_skills", "industries", "company_sizes")


def structured_columns(details: Column) -> dict[str, Column]:
    """Fit inputs read from a posting's details, a map of JSON values."""

    def value(name: str) -> Column:
        return F.try_element_at(details, F.lit(name))

    def text(*names: str) -> Column:
        return F.coalesce(
            *[F.nullif(F.nullif(value(n), F.lit("")), F.lit("[]")) for n in names]
        )

    travel = F.coalesce(value("travel_percent"), value("travel_required"))
    percent = (
        F.when(travel == "true", 100)
        .when(travel == "false", 0)
        .otherwise(F.regexp_replace(F.trim(travel), "%$", "").try_cast("int"))
    )
    return {
        "required_skills": coerce_list(text("required_skills", "skills")),
        "industries": coerce_list(text("industry", "branche", "industries")),
        "company_sizes": coerce_list(
            text("company_size", "unternehmensgroesse", "company_sizes")
        ),
        "commute_minutes": value("commute_minutes").try_cast("double").cast("bigint"),
        "salary": first_number(*[value(n) for n in ("salary_yearly", "salary_max", "salary_min")]),
        "travel_percent": percent,
    }


def evaluate(
    df: DataFrame, title: str, body: str, columns: Mapping[str, Column], profile: Profile,
    structured: str | None = None, rubric: Rubric = DEFAULT_RUBRIC, reasons: bool = True,
) -> DataFrame:
    """Relevance and fit in one pass; the profile's role terms extend the title terms."""
    scored = rubric_score(
        df, title, body, rubric, profile.role_terms if profile.has_preferences else (),
        reasons="relevance_reasons" if reasons else None,
    )
    return fit_score(
        scored, columns, profile, structured, reasons="fit_reasons" if reasons else None
    )


def half_up(value: float, digits: int = 1) -> float:
    """The rounding rule of the engine for driver-side constants."""
    return float(Decimal(str(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
