"""Text rules as column expressions. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanz import fixed

TAG = r"<[/!a-zA-Z?][^>]*>"
BLOCKS = "address|article|br|div|h[1-6]|p|section|table|tr"


def fold(c: Column) -> Column:
    """Case folding: Spark's ``lower`` keeps the sharp s, which folds to ``ss``."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def py_fold(value: str) -> str:
    """``fold`` for a literal on the driver."""
    return value.lower().replace("ß", "ss")


def collapse(c: Column) -> Column:
    """Runs of any Unicode white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    return collapse(fold(F.coalesce(c, F.lit(""))))


def py_normalize(value: str | None) -> str:
    return re.sub(r"\s+", " ", py_fold(value or "")).strip()


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """True when any term occurs in ``c``; a chain of JVM substring searches, no regex."""
    result = F.lit(False)
    for term in terms:
        result = result | F.contains(c, F.lit(term))
    return result


def matching_terms(c: Column, terms: Sequence[str]) -> Column:
    """Array of the terms that occur in ``c``, in the order of ``terms``."""
    if not terms:
        return F.array().cast("array<string>")
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.filter(wanted, lambda t: F.contains(c, t))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used several times inside conditions is otherwise evaluated at each use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# all names of the HTML standard, as the standard library lists them
ALL_ENTITIES = "\x01".join(
    f"{name[:-1]}\x02{value}" for name, value in html5.items() if name.endswith(";") and "\x01" not in value
)
# characters that the HTML standard reads into the codes 128 to 159
_WINDOWS = {code: bytes([code]).decode("cp1252", "replace") for code in range(128, 160)}


def _number(name: Column) -> Column:
    """Code of ``#8364`` or ``#x20ac``; too long ones are out of range."""
    decimal = F.regexp_extract(name, r"^#0*([0-9]{1,9})$", 1)
    hexa = F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]{1,7})$", 1)
    return (
        F.when(decimal != "", decimal.try_cast("bigint"))
        .when(hexa != "", F.conv(hexa, 16, 10).try_cast("bigint"))
        .otherwise(F.lit(0x110000).cast("bigint"))
    )


def _character(code: Column) -> Column:
    """Character of a code; what no character has becomes the replacement character."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    old = F.create_map(*[F.lit(x) for item in _WINDOWS.items() for x in item])
    return F.when(code.between(128, 159), F.try_element_at(old, code.cast("int"))).when(valid, plain).otherwise("\ufffd")


def _entity(name: Column, table: Mapping[str, str]) -> Column:
    """Character of one entity name such as ``amp``, ``#8364`` or ``#x20ac``; null if unknown."""
    return F.when(name.startswith("#"), _character(_number(name))).otherwise(
        F.coalesce(lookup(name, table), F.try_element_at(F.str_to_map(F.lit(ALL_ENTITIES), F.lit("\x01"), F.lit("\x02")), name))
    )


def _decode_entities(text: Column, table: Mapping[str, str]) -> Column:
    """Cut at ``&`` and decode the head of every later piece: one pass, whatever the table."""

    def piece(part: Column, index: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", 1)
        value = F.when(name != "", _entity(name, table))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        decoded = F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), part))
        return F.when(index == 0, part).otherwise(decoded)

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def unescape(c: Column) -> Column:
    """HTML entities to characters, one level."""
    return let(
        c,
        lambda t: F.when(F.contains(t, F.lit("&")), _decode_entities(t, fixed.ENTITIES)).otherwise(t),
    )


def tidy_lines(c: Column) -> Column:
    """One blank between words, no blanks at line ends, at most one empty line."""
    c = F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.trim(c, F.lit(" \n"))


def strip_markup(c: Column) -> Column:
    """HTML to text with heading and list marks; hidden elements and comments dropped."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    c = F.regexp_replace(c, r"(?i)<h[1-6](?=[\s>/])[^>]*>", "\n\n## ")
    c = F.regexp_replace(c, rf"(?i)</?(?:{BLOCKS})(?=[\s>/])[^>]*>|</li\s*>", "\n")
    c = F.regexp_replace(c, r"(?i)<(?!li[\s>/])[/!a-zA-Z?][^>]*>", "")
    c = F.regexp_replace(c, r"(?i)(?<=\n)<li[^>]*>", "- ")
    return F.regexp_replace(c, r"(?i)<li[^>]*>", "\n- ")


def visible_text(c: Column, text_format: Column | None = None) -> Column:
    """Readable text of a description; markup is recognised by format or by a tag in it."""
    is_html = c.rlike(r"<[/!a-zA-Z][^>]*>")
    if text_format is not None:
        declared = F.lower(F.coalesce(text_format, F.lit(""))).isin("html", "text/html")
        is_html = is_html | declared
    text = F.when(is_html, unescape(strip_markup(c))).otherwise(c)
    return F.when(c.isNull(), F.lit("")).otherwise(tidy_lines(unescape(text)))


def key_part(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^a-z0-9äöüß]+", " "))


def canonical_key(title: Column, employer: Column, location: Column) -> Column:
    """Hash that is equal for the same posting seen at several sources."""
    return F.sha2(F.concat_ws("|", key_part(title), key_part(employer), key_part(location)), 256)


def content_hash(columns: Sequence[Column]) -> Column:
    """Hash over the given values; a null and an empty text hash differently."""
    parts = [
        F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))
        for c in columns
    ]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def envelope(description: Column, text_format: Column, metadata: Column, raw: Column) -> Column:
    """Canonical JSON of the original record: keys in order, nulls kept, no blanks."""
    return F.to_json(
        F.struct(
            description.alias("description"),
            text_format.alias("description_format"),
            metadata.alias("metadata"),
            raw.alias("raw"),
        ),
        {"ignoreNullFields": "false"},
    )


def excerpt(c: Column, maximum: int = 280) -> Column:
    """At most ``maximum`` characters, cut at a word, with an ellipsis when cut."""
    text = collapse(F.coalesce(c, F.lit("")))
    head = F.substring(text, 1, maximum - 1)
    head = F.regexp_replace(F.regexp_replace(head, r" [^ ]*$", ""), r"[ ,.;:\-]+$", "")
    return F.when(F.length(text) <= maximum, text).otherwise(F.concat(head, F.lit("…")))


def text_chunks(c: Column, maximum: int = 520) -> Column:
    """Sentences packed greedily into chunks of at most ``maximum`` characters.

    A longer sentence is first cut into pieces at its last blanks by one regular expression,
    then a left fold over the pieces packs them. Pieces of a cut sentence start a new chunk.
    """
    sentences = F.split(c, r"(?<=[.!?])\s+(?=[A-ZÄÖÜ0-9])")
    cut = rf"(?s)(\S.{{0,{maximum - 1}}}(?=\s|$)|\S{{{maximum}}})"
    pieces = F.flatten(
        F.transform(
            sentences,
            lambda s: F.transform(
                F.regexp_extract_all(F.trim(s), F.lit(cut), 1),
                lambda p, i: F.struct(
                    F.trim(p).alias("text"),
                    (F.length(F.trim(s)) > maximum).alias("cut"),
                ),
            ),
        )
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open")
    )

    def pack(state: Column, piece: Column) -> Column:
        joined = F.trim(F.concat_ws(" ", state["open"], piece["text"]))
        full = (state["open"] != "") & ((F.length(joined) > maximum) | piece["cut"])
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"]))
            .otherwise(state["done"])
            .alias("done"),
            F.when(full, piece["text"]).otherwise(joined).alias("open"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(
            F.array_append(state["done"], state["open"])
        )

    return F.aggregate(pieces, start, pack, finish)


def error_text(c: Column, maximum: int = 1000) -> Column:
    return F.substring(collapse(c), 1, maximum)


def redact(text: Column, values: Column) -> Column:
    """Remove every value of the array from the text, longest first, and drop empty lines."""
    cleaned = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    ordered = F.array_sort(
        F.array_distinct(cleaned),
        lambda a, b: F.when(F.length(a) > F.length(b), -1)
        .when(F.length(a) < F.length(b), 1)
        .otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)),
    )
    escaped = F.transform(
        ordered, lambda v: F.regexp_replace(v, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    )
    pattern = F.concat(F.lit("(?iu)"), F.array_join(escaped, "|"))
    bare = F.when(F.size(ordered) > 0, F.regexp_replace(text, pattern, "")).otherwise(text)
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, r"^[ \t|·]+|[ \t|·]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def emails(c: Column) -> Column:
    pattern = r"(?U)(?<![\w.+-])([\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), F.lower)


PHONE = r"(?U)(?<!\w)((?:(?:\+|00)[0-9]{1,3}[\s./()-]*)?(?:[0-9][\s./()-]*){7,15})"


def phones(line: Column, pattern: str = PHONE) -> Column:
    """Phone-like numbers of one line, the first group of ``pattern``; a line with a birth date gives none."""
    found = F.transform(
        F.regexp_extract_all(line, F.lit(pattern), 1),
        lambda p: F.regexp_replace(p, r"^[ .,/()\-]+|[ .,/()\-]+$", ""),
    )
    birth = line.rlike(r"\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b") & line.rlike(
        "(?i)geb|birth"
    )
    valid = F.filter(
        found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15)
    )
    return F.when(birth, F.array().cast("array<string>")).otherwise(valid)


def letter_key(c: Column) -> Column:
    """Key without accents (the Latin letters in use), for alias lookups."""
    plain = F.translate(
        F.lower(F.trim(c)), "äöüáàâãåéèêëíìîïóòôõúùûñçýÿ", "aouaaaaaeeeeiiiioooouuuncyy"
    )
    return F.replace(plain, F.lit("ß"), F.lit("ss"))


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table, null when the key is unknown."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def ordered_distinct(values: Column) -> Column:
    """First spelling of every value that differs after folding; blanks dropped, order kept.

    Sorted by (key, place), so the first of equal keys is next to its repeats: n log n per array.
    """
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    keyed = F.sort_array(F.transform(trimmed, lambda v, i: F.struct(fold(v).alias("key"), i.alias("at"), v.alias("v"))))
    first = let(keyed, lambda all_: F.filter(
        all_, lambda v, i: (i == 0) | (F.get(all_, i - 1)["key"] != v["key"])))
    by_place = F.sort_array(F.transform(first, lambda v: F.struct(v["at"].alias("at"), v["v"].alias("v"))))
    return F.transform(by_place, lambda v: v["v"])


def language_guess(title: Column, text: Column, explicit: Column | None = None) -> Column:
    """Stop-word counts decide between German and English; an explicit value wins."""

    def hits(body: Column, words: Iterable[str]) -> Column:
        total = F.lit(0)
        for word in words:
            w = py_fold(word)
            total = total + (
                F.length(body) - F.length(F.replace(body, F.lit(w), F.lit("")))
            ) / F.lit(len(w))
        return total

    def decide(counts: Column) -> Column:
        german, english = counts["de"], counts["en"]
        return F.when((german == 0) & (english == 0), None).when(german >= english, "de").otherwise("en")

    def count(body: Column) -> Column:
        return F.struct(
            hits(body, fixed.GERMAN_WORDS).alias("de"), hits(body, fixed.ENGLISH_WORDS).alias("en")
        )

    guess = let(let(fold(F.concat_ws(" ", title, text)), count), decide)
    return guess if explicit is None else F.coalesce(blank_to_null(explicit), guess)
