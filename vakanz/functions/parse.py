"""Parsers for times, places, money and preference values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.text import (
    blank_to_null,
    collapse,
    contains_any,
    fold,
    letter_key,
    lookup,
)


def parse_timestamp(c: Column) -> Column:
    """ISO text, Unix seconds or milliseconds (by magnitude), German dates, RFC 822; UTC.

    A value without a zone counts as UTC, anything unreadable is null.
    """
    text = blank_to_null(c)
    number = F.when(text.rlike(r"^\d{1,15}$"), text).try_cast("double")
    seconds = F.when(number >= 100_000_000_000, number / 1000).otherwise(number)
    epoch = F.timestamp_seconds(seconds)
    zoned = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}"),
        F.regexp_replace(
            F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), text).otherwise(
                F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
                .otherwise(F.concat(text, F.lit("Z")))
            ),
            r"([+-]\d{2})(\d{2})$",
            "$1:$2",
        ),
    ).try_cast("timestamp")
    german = F.try_to_timestamp(
        F.when(
            text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.concat(text, F.lit(" +00:00"))
        ),
        F.lit("d.M.yyyy XXX"),
    )
    rfc822 = F.try_to_timestamp(
        F.when(
            text.rlike(r"^(?:[A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} "),
            F.regexp_replace(
                F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC|UT)$", "+0000"
            ),
        ),
        F.lit("d MMM yyyy HH:mm:ss xx"),
    )
    return F.coalesce(epoch, zoned, german, rfc822)


def country_code(c: Column) -> Column:
    key = F.replace(F.trim(fold(c)), F.lit("."), F.lit(""))
    return (
        F.when(blank_to_null(c).isNull(), "DE")
        .when(lookup(key, fixed.COUNTRY_CODES).isNotNull(), lookup(key, fixed.COUNTRY_CODES))
        .when(key.rlike(r"^(?U)\p{L}{2}$"), F.upper(key))
        .otherwise("ZZ")
    )


def location_parts(
    locations: Column, postcode: Column | None = None, city: Column | None = None,
    state: Column | None = None,
) -> tuple[Column, Column, Column]:
    """Postcode, city and state from the first location text; given metadata wins."""
    first = F.trim(F.coalesce(F.try_element_at(locations, F.lit(1)), F.lit("")))
    code = F.nullif(F.regexp_extract(first, r"\b([0-9]{5})\b", 1), F.lit(""))
    place = F.substring_index(F.regexp_replace(first, r"\b[0-9]{5}\b", ""), ",", 1)
    place = F.regexp_replace(
        place, r"(?i)\b(remote|homeoffice|home-office|deutschland|germany)\b", ""
    )
    place = blank_to_null(collapse(F.regexp_replace(place, r"^[ /|\-]+|[ /|\-]+$", "")))
    joined = F.replace(
        F.replace(fold(F.array_join(locations, " ")), F.lit("ü"), F.lit("ue")),
        F.lit("-"),
        F.lit(" "),
    )
    region = F.when(F.contains(joined, F.lit("baden wuerttemberg")), "Baden-Württemberg")

    def prefer(given: Column | None, found: Column) -> Column:
        return found if given is None else F.coalesce(blank_to_null(given), found)

    return prefer(postcode, code), prefer(city, place), prefer(state, region)


def remote_type(explicit: Column, remote: Column, locations: Column) -> Column:
    """Workplace of a posting: explicit text, then the flag; remote with a place is hybrid."""
    text = fold(F.coalesce(F.trim(explicit), F.lit("")))
    place = F.regexp_replace(
        fold(F.coalesce(F.array_join(locations, " "), F.lit(""))),
        r"(?i)\b(remote|homeoffice|home-office|deutschland|germany|bundesweit)\b",
        "",
    )
    return (
        F.when(F.contains(text, F.lit("hybrid")), "hybrid")
        .when(text.isin("remote", "fully remote", "full remote", "100% remote"), "remote")
        .when(contains_any(text, ("onsite", "on-site", "praesenz")), "onsite")
        .when(~remote, "onsite")
        .when(remote, F.when(place.rlike("[a-zA-ZäöüÄÖÜ]{3,}"), "hybrid").otherwise("remote"))
    )


def remote_signal(location_type: Column, explicit: Column, locations: Column, text: Column) -> Column:
    """True when a page says remote somewhere, else the explicit flag, else null."""
    kind = fold(F.coalesce(location_type, F.lit("")))
    given = fold(F.coalesce(explicit, F.lit("")))
    joined = fold(F.concat_ws(" ", F.array_join(locations, " "), text))
    return (
        F.when(contains_any(kind, ("telecommute", "remote")), True)
        .when(given.isin("true", "false"), given == "true")
        .when(contains_any(given, ("remote", "homeoffice")), True)
        .when(contains_any(joined, ("remote", "homeoffice", "home-office")), True)
    )


def remote_basis(location_type: Column, explicit: Column) -> Column:
    kind = fold(F.coalesce(location_type, F.lit("")))
    given = F.trim(F.regexp_replace(fold(F.coalesce(explicit, F.lit(""))), r"(?U)[\s_-]+", " "))
    return F.when(F.contains(kind, F.lit("telecommute")), "json_ld_telecommute").when(
        given.isin("remote", "fully remote", "full remote", "100% remote"),
        "structured_metadata_remote",
    )


def geo_eligible(c: Column) -> Column:
    """Whether a remote-location restriction permits work from Germany."""
    text = collapse(fold(c))
    us_only = text.rlike(r"\b(?:us|usa|united states)(?:\s+only)?\b")
    return (
        F.when(blank_to_null(c).isNull(), True)
        .when(text.rlike(r"\b(?:de|eu)\b"), True)
        .when(F.contains(text, F.lit("anywhere")) & us_only, False)
        .when(contains_any(text, fixed.ELIGIBLE_PHRASES), True)
        .otherwise(text.isin("remote", "fully remote"))
    )


def salary_range(
    minimum: Column, maximum: Column, currency: Column, unit: Column, dash: str = "-"
) -> Column:
    """``min-max CURRENCY UNIT`` from whichever parts exist."""
    amount = F.concat_ws(dash, F.nullif(minimum, F.lit("")), F.nullif(maximum, F.lit("")))
    return F.nullif(
        F.concat_ws(
            " ",
            F.nullif(amount, F.lit("")),
            blank_to_null(currency),
            blank_to_null(unit),
        ),
        F.lit(""),
    )


def euro_range(minimum: Column, maximum: Column) -> Column:
    """``€55.000 - €65.000`` with dots between thousands."""

    def euro(c: Column) -> Column:
        whole = c.try_cast("double").cast("bigint")
        return F.concat(F.lit("€"), F.translate(F.format_number(whole, 0), ",", "."))

    return F.nullif(F.concat_ws(" - ", euro(minimum), euro(maximum)), F.lit(""))


def first_number(*columns: Column) -> Column:
    """First value readable as a number, cut to a whole number."""
    return F.coalesce(*[c.try_cast("double") for c in columns]).cast("bigint")


def coerce_list(c: Column) -> Column:
    """JSON or plain text to ``array<string>``: scalar, list, list of objects, flag object."""
    text = F.trim(c)
    variant = F.try_parse_json(text)
    items = F.try_variant_get(variant, "$", "array<variant>")
    listed = F.filter(F.transform(items, variant_text), lambda x: x.isNotNull())
    flags = F.try_variant_get(variant, "$", "map<string,variant>")
    enabled = F.map_keys(
        F.map_filter(
            flags,
            lambda k, v: ~F.coalesce(v.cast("string"), F.lit("")).isin("", "false", "0", "null"),
        )
    )
    scalar = F.coalesce(F.try_variant_get(variant, "$", "string"), text)
    return (
        F.when(text.isNull() | (text == "null"), F.array().cast("array<string>"))
        .when(text.startswith("["), listed)
        .when(text.startswith("{"), enabled)
        .otherwise(F.array(scalar))
    )


def variant_text(v: Column) -> Column:
    """Text of a variant element; an object gives its name, location or text."""
    raw = v.cast("string")
    named = F.coalesce(
        *[
            blank_to_null(F.try_variant_get(v, f"$.{k}", "string"))
            for k in ("name", "label", "location", "text")
        ]
    )
    return F.when(raw.startswith("{"), named).otherwise(blank_to_null(raw))


def parse_boolean(c: Column) -> Column:
    key = letter_key(c)
    return F.when(key.isin(*fixed.TRUE_VALUES), True).when(key.isin(*fixed.FALSE_VALUES), False)


def parse_salary(c: Column) -> tuple[Column, Column]:
    """Value and validity of a salary text; ``not specified`` is valid and null."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    amount = digits.try_cast("bigint")
    unset = letter_key(c).isin(*fixed.NOT_SPECIFIED)
    good = F.coalesce(amount.between(1, 2_000_000), F.lit(False))
    return F.when(~unset & good, amount), unset | good


def parse_percentage(c: Column) -> tuple[Column, Column]:
    amount = F.regexp_extract(c, r"\b([0-9]{1,3})\s*%?", 1).try_cast("int")
    unset = letter_key(c).isin(*fixed.NOT_SPECIFIED)
    good = F.coalesce(amount.between(0, 100), F.lit(False))
    return F.when(~unset & good, amount), unset | good


def state_alias(c: Column) -> Column:
    return lookup(letter_key(c), fixed.STATE_ALIASES)


def title_location(title: Column) -> Column:
    found = [
        blank_to_null(
            F.regexp_replace(F.regexp_extract(F.trim(title), p, 1), r"^[ \-|]+|[ \-|]+$", "")
        )
        for p in fixed.LOCATION_TITLE_PATTERNS
    ]
    return F.coalesce(*found)


def render_locations(addresses: Column) -> Column:
    """``array<struct<postcode,city,region,country>>`` to distinct location texts."""

    def render(a: Column) -> Column:
        place = F.concat_ws(" ", blank_to_null(a["postcode"]), blank_to_null(a["city"]))
        return F.concat_ws(
            ", ",
            F.nullif(place, F.lit("")),
            blank_to_null(a["region"]),
            blank_to_null(a["country"]),
        )

    return F.array_distinct(F.filter(F.transform(addresses, render), lambda x: x != ""))


def age_bucket(published: Column, now: Column) -> Column:
    """Age class of a posting: today, yesterday, days, date, unknown."""
    days = F.greatest(F.lit(0), F.datediff(now, published))
    return (
        F.when(published.isNull(), "unknown")
        .when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 14, "days")
        .otherwise("date")
    )


def completeness(*columns: Column) -> Column:
    """Share of filled fields in percent."""
    filled = F.lit(0)
    for c in columns:
        filled = filled + F.when(blank_to_null(c.cast("string")).isNotNull(), 1).otherwise(0)
    return F.round(filled * 100.0 / len(columns), 0).cast("int")
