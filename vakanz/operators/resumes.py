"""Profile facts from résumé texts: work experience over several lines, and suggested fields.

Lines of one text are ordered with windows on (key, position), so a task holds the lines of one text
at a time and texts are spread over tasks. Nothing is cut: every entry, duty, skill and line of a
section is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.text import (
    blank_to_null, collapse, contains_any, emails, fold, let, lookup, ordered_distinct, phones, py_fold,
)
from vakanz.operators.common import dedupe_first, open_array
from vakanz.operators.profiles import (
    COMPANY_PATTERN, PERIOD, ROLE_PATTERN, YEAR, period_interval, role_employer,
)

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"  # all but the usual one
BULLET = r"^[✓✔►▸▪●○\-–—]+\s*"
_EDGES = r"^[\s|,;:–—\-]+|[\s|,;:–—\-]+$"
_MAIL = r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
_PHONE = r"(?U)(?<!\w)(?:(?:\+|00)[0-9]{1,3}[\s./()-]*)?(?:[0-9][\s./()-]*){7,15}"
_DIGITS = r"(?U)[0-9](?:[\s./()-]*[0-9]){6}"  # part of every phone number
# Unicode white space, as (?U)\s
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def heading_key(c: Column) -> Column:
    return collapse(F.regexp_replace(F.trim(F.lower(c)), r"(?U)^[#•·\-\s]+|[:#•·\-\s]+$", ""))


def _one_of(words: Iterable[str]) -> str:
    """Pattern of the words, branching at the first letter: most places in a text are ruled out by it alone."""
    rests = {first: sorted({w[1:] for w in words if w[:1] == first}) for first in sorted({w[:1] for w in words})}
    return "|".join(f"{re.escape(first)}(?:{'|'.join(map(re.escape, rest))})" for first, rest in rests.items())


def heading_of(line: Column, headings: Mapping[str, Sequence[str]] = fixed.SECTION_HEADINGS) -> Column:
    """``struct<section, rest>`` of a heading line, null for others; ``rest`` follows a colon on the same line."""
    names = {py_fold(h) if "ß" in h else h: section for section, hs in headings.items() for h in hs}
    found = lambda section, rest: F.when(section.isNotNull(), F.struct(section.alias("section"), rest.alias("rest")))
    rest = blank_to_null(F.regexp_replace(line, r"^[^:]*:", ""))
    label = F.when(F.contains(line, F.lit(":")), lookup(heading_key(F.substring_index(line, ":", 1)), names))
    whole = let(lookup(heading_key(line), names), lambda section: found(section, F.lit(None).cast("string")))
    # the first word rules most lines out before the others are tried
    starts = _one_of({re.split(r"\s", n)[0] for n in names})
    return F.when(line.rlike(rf"(?iU)^[#•·\-\s]*+(?:{starts})"),
                  F.coalesce(whole, let(label, lambda section: found(section, rest))))


def is_identity(line: Column) -> Column:
    """A line that can name a role or an employer."""
    short = ~(line == "") & (F.length(line) <= 180) & ~line.rlike(r"[.;]$")
    role = let(F.lower(line), lambda t: contains_any(t, fixed.ROLE_WORDS))
    names = F.contains(line, F.lit("|")) | role | line.rlike(COMPANY_PATTERN) | line.rlike(r"(?i)\s+(?:bei|at)\s+")
    return short & names & ~_has_mail(line) & ~line.rlike(_PHONE)


def _has_mail(line: Column) -> Column:
    return F.contains(line, F.lit("@")) & line.rlike(_MAIL)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: the trimmed lines that are not blank."""
    trimmed = F.transform(F.split(F.col(text), LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return open_array(df, [key], trimmed, "line", "pos").filter("line <> ''")


def work_experience(
    df: DataFrame, key: str, text: str, now_month: Column,
    headings: Mapping[str, Sequence[str]] = fixed.SECTION_HEADINGS,
) -> DataFrame:
    """Entries of every text, newest first: position, period, role, employer, start and end month, duties, source_text.

    A line with a period opens an entry. What stands beside the period names role and employer; if
    nothing does, up to two lines after it, else up to two before it. The lines that follow are its
    duties, up to the next period, heading or identity line. Lines come from the experience section;
    texts without one are read whole, and then an entry needs a role word. An entry that repeats
    period, role and employer is returned once.
    """
    whole = Window.partitionBy(key)
    order = whole.orderBy("pos")
    lines = text_lines(df, key, text).withColumn("_heading", heading_of(F.col("line"), headings))
    section = F.last(F.col("_heading")["section"], ignorenulls=True).over(order)
    own = F.when(F.col("_heading").isNotNull(), F.col("_heading")["rest"]).otherwise(F.col("line"))
    lines = lines.withColumn("_own", F.when(section == "experience", own))
    lines = lines.withColumn("_in_section", F.max(F.col("_own").isNotNull()).over(whole))
    lines = lines.withColumn("_line", F.when(F.col("_in_section"), F.col("_own")).otherwise(F.col("line")))
    lines = lines.filter(F.col("_line").isNotNull())
    line, headed = F.col("_line"), F.col("_heading").isNotNull()
    # every period holds a year; what stands beside it counts on its own line only
    period = F.when(line.rlike(YEAR), F.nullif(F.regexp_extract(line, PERIOD, 1), F.lit("")))
    lines = lines.select(
        key, "pos", "_line", "_in_section", F.row_number().over(order).alias("_at"), period.alias("_period"),
        is_identity(line).alias("_identity"),
        F.when(F.col("_in_section") & headed, heading_of(line, headings).isNotNull()).otherwise(headed).alias("_is_heading"),
    )
    stops = F.col("_period").isNotNull() | F.col("_identity") | F.col("_is_heading")
    names = F.when(F.col("_identity") & F.col("_period").isNull(), F.col("_line"))
    lines = lines.withColumns({"_stops": stops, "_names": names})
    lines = lines.withColumns({
        "_after": F.array(F.lead("_names", 1).over(order), F.lead("_names", 2).over(order)),
        "_before": F.array(F.lag("_names", 2).over(order), F.lag("_names", 1).over(order)),
        "_island": F.max(F.when(F.col("_stops"), F.col("_at"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    # lines that open no entry and are no duty have done their part
    lines = lines.filter(F.col("_period").isNotNull() | ~F.col("_stops"))
    bare = F.regexp_replace(F.regexp_replace("_line", PERIOD, ""), _EDGES, "")
    lines = lines.withColumn("_beside", F.when(F.col("_period").isNotNull(), bare))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    nothing = F.array().cast("array<string>")
    after = F.when(F.col("_after")[0].isNotNull(), some("_after")).otherwise(nothing)
    before = F.when(F.col("_before")[1].isNotNull(), some("_before")).otherwise(nothing)
    lines = lines.withColumn("_after", F.when(F.col("_beside") == "", after).otherwise(nothing))
    lines = lines.withColumn("_named_by", F.when(F.col("_beside") != "", nothing).when(
        F.size("_after") > 0, F.col("_after")).otherwise(before))
    context = F.when(F.col("_beside") != "", F.col("_beside")).otherwise(F.array_join("_named_by", " | "))
    lines = lines.withColumn("_context", F.when(F.col("_period").isNotNull(), context))
    opens = (F.col("_context") != "") & (F.col("_in_section") | F.lower("_context").rlike(ROLE_PATTERN))
    lines = lines.withColumn("_who", F.when(opens, role_employer(F.col("_context"))))
    entry = F.when(F.col("_who")["role"].isNotNull() | F.col("_who")["employer"].isNotNull(), F.struct(
        F.col("_at").alias("at"), F.trim("_period").alias("period"), F.col("_who")["role"].alias("role"),
        F.col("_who")["employer"].alias("employer"), F.concat(F.array("_line"), "_named_by").alias("source")))
    tidy = lambda bare: collapse(F.regexp_replace(bare, r"^[ •·|,;:\-]+|[ •·|,;:\-]+$", ""))
    duty = F.when(~F.col("_stops"), let(F.trim(F.regexp_replace("_line", BULLET, "")), lambda bare: F.when(
        (bare != "") & ~_has_mail(bare), F.struct(F.col("_at").alias("at"), tidy(bare).alias("text")))))
    rows = lines.select(key, entry.alias("_entry"), duty.alias("_duty"), F.when(
        F.col("_stops"), F.col("_at") + F.size("_after")).otherwise(F.col("_island")).alias("_group"))
    # an entry closes its own group; the lines up to the next stop carry its number
    grouped = rows.withColumn("_duties", F.collect_list("_duty").over(Window.partitionBy(key, "_group")))
    grouped = grouped.filter("_entry is not null").withColumn("_duties", F.sort_array("_duties"))
    grouped = grouped.select(key, "_entry.*", ordered_distinct(F.col("_duties.text")).alias("responsibilities"))
    same = [key, fold(F.col("period")), fold(F.coalesce("role", F.lit(""))), fold(F.coalesce("employer", F.lit("")))]
    found = dedupe_first(grouped, same, [F.col("at")])
    found = found.withColumn("_span", period_interval(F.col("period"), now_month))
    newest = whole.orderBy(F.col("_span.start").desc_nulls_last(), "at")
    said = F.concat("source", F.slice("responsibilities", 1, 3))
    return found.select(
        key, F.row_number().over(newest).alias("position"), "period", "role", "employer",
        F.col("_span.start").alias("start_month"), F.col("_span.end").alias("end_month"), "responsibilities",
        F.array_join(F.array_distinct(said), " | ").alias("source_text"),
    )


# --- suggested fields -------------------------------------------------------------------------

def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def looks_like_name(value: Column) -> Column:
    """Two to five capitalised words of letters, hyphens and apostrophes, none of them a role."""
    word = r"\p{Lu}\p{L}*(?:[-']\p{Lu}\p{L}*)*"
    return value.rlike(rf"^{word}(?:\s+{word}){{1,4}}$") & (F.length(value) <= 100) & ~F.lower(value).rlike(ROLE_PATTERN)


def has_contact(line: Column) -> Column:
    return F.contains(line, F.lit("@")) | (line.rlike(_DIGITS) & line.rlike(_PHONE))


def _has_period(line: Column) -> Column:
    return line.rlike(YEAR) & line.rlike(PERIOD)


def suggested_name(lines: Column, headings: Mapping[str, Sequence[str]] = fixed.SECTION_HEADINGS) -> Column:
    """``struct<value, source>``: a labelled name of the first 20 lines, else the first of 15 that looks like one."""
    label = r"(?iU)^(?:name|full\s+name|vor-?\s*und\s*nachname)\s*:\s*(.+)$"
    one = lambda value, line: F.struct(F.trim(value).alias("value"), line.alias("source"))
    labelled = F.transform(F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(label)),
                           lambda x: one(F.regexp_extract(x, label, 1), x))
    other = F.transform(F.slice(lines, 1, 15), lambda x: one(F.regexp_replace(x, r"^[ ,;|]+|[ ,;|]+$", ""), x))
    headed = [*fixed.RESUME_TITLES, *(h for hs in headings.values() for h in hs)]
    named = lambda found: F.filter(found, lambda n: looks_like_name(n["value"]))
    other = F.filter(named(other), lambda n: ~heading_key(n["value"]).isin(headed) & ~has_contact(n["value"]))
    return _first(F.concat(named(labelled), other))


def suggested_title(lines: Column, name_source: Column, headings=fixed.SECTION_HEADINGS) -> Column:
    """``struct<value, source>``: a labelled title of the first 30 lines, else the first of 20 lines that holds a role."""
    label = (r"(?iU)^(?:aktuelle\s+tätigkeit|aktuelle\s+position|berufsbezeichnung|current\s+role|current\s+position"
             r"|job\s+title|title)\s*:\s*(.+)$")
    labelled = F.transform(F.filter(F.slice(lines, 1, 30), lambda x: x.rlike(label)), lambda x: F.struct(
        F.trim(F.regexp_extract(x, label, 1)).alias("value"), x.alias("source")))
    role = lambda x: let(F.lower(x), lambda t: contains_any(t, fixed.ROLE_WORDS))
    plain = F.filter(F.slice(lines, 1, 20), lambda x: (F.length(x) <= 150) & role(x) & ~x.eqNullSafe(name_source) & (
        ~has_contact(x)) & ~_has_period(x) & heading_of(x, headings).isNull())
    plain = F.transform(plain, lambda x: F.struct(
        F.regexp_replace(x, r"^[ |,;:\-]+|[ |,;:\-]+$", "").alias("value"), x.alias("source")))
    return _first(F.concat(labelled, plain))


def notable_lines(lines: Column, terms: Iterable[str]) -> Column:
    """Array of ``struct<at, line>``: all lines that hold one of the terms as whole words, and few others.

    Every term is known by its longest word. The text is cut into words once, so the many words that it does not
    hold cost nothing a line.
    """
    terms = [py_fold(t) for t in terms]
    letters = "".join(sorted({c for t in terms for c in t if c.isalpha() or c.isdecimal()}))
    found = [re.findall(f"[{letters}]+", t) if letters else [] for t in terms]
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    if not found or not all(found):  # a term of marks only can be anywhere
        return numbered
    marks = F.array(*[F.lit(w) for w in sorted({max(ws, key=len) for ws in found})])

    def choose(folded: Column) -> Column:
        words = F.array_intersect(F.split(F.array_join(folded, "\n"), f"[^{letters}]+"), marks)
        return let(words, lambda ws: F.filter(
            numbered, lambda n: F.exists(ws, lambda w: F.contains(F.get(folded, n["at"]), w))))

    return let(F.transform(lines, fold), choose)


def sections(
    lines: Column, headings: Mapping[str, Sequence[str]] = fixed.SECTION_HEADINGS, notable: Column | None = None,
) -> Column:
    """Array of ``struct<section, lines>`` in reading order; lines before the first heading are left out.

    A section runs from its heading to the next one: linear in the text, within its own row. ``notable`` are the
    lines that can be headings, if they are known.
    """
    control = ("\u0001", "\u0002")
    blanked = lambda x: F.replace(F.replace(x, F.lit(control[0]), F.lit(" ")), F.lit(control[1]), F.lit(" "))
    clean = let(lines, lambda all_: F.when(
        let(F.array_join(all_, ""), lambda whole: contains_any(whole, control)), F.transform(all_, blanked)).otherwise(all_))
    if notable is None:
        notable = notable_lines(lines, (h for hs in headings.values() for h in hs))
    heads = F.transform(notable, lambda n: F.struct(n["at"].alias("at"), heading_of(blanked(n["line"]), headings).alias("head")))

    def cut(s: Column) -> Column:
        return F.transform(s["heads"], lambda h, i: F.struct(
            h["head"]["section"].alias("section"),
            F.filter(F.concat(F.array(h["head"]["rest"]), until(s["lines"], h["at"], F.coalesce(
                F.get(s["heads"], i + 1)["at"], F.size(s["lines"])))), lambda x: x != "").alias("lines")))

    def until(all_: Column, head: Column, end: Column) -> Column:
        return F.slice(all_, head + 2, end - head - 1)

    return let(F.struct(clean.alias("lines"), F.filter(heads, lambda h: h["head"].isNotNull()).alias("heads")), cut)


def section_lines(found: Column, *names: str) -> Column:
    return F.flatten(F.transform(F.filter(found, lambda s: s["section"].isin(*names)), lambda s: s["lines"]))


def _tidy(value: Column) -> Column:
    return F.regexp_replace(collapse(value), r"^[ •·|,;:\-]+|[ •·|,;:\-]+$", "")


def listed_entries(lines: Column) -> Column:
    """Distinct lines of a section without bullets."""
    return ordered_distinct(F.transform(lines, lambda x: _tidy(F.regexp_replace(x, BULLET, ""))))


def spoken_languages(lines: Column, terms: Mapping[str, Sequence[str]] = fixed.LANGUAGE_TERMS) -> Column:
    from vakanz.operators.profiles import term_mentions

    spellings = [py_fold(s) for names in terms.values() for s in names]
    nothing = F.array().cast("array<string>")
    return let(lines, lambda all_: F.when(
        let(fold(F.array_join(all_, "\n")), lambda whole: contains_any(whole, spellings)),
        F.array_distinct(F.flatten(F.transform(all_, lambda x: term_mentions(x, terms))))).otherwise(nothing))


def listed_skills(lines: Column) -> Column:
    """Skills of list lines: cut at separators, without bullets, levels, periods and addresses."""
    items = F.flatten(F.transform(lines, lambda x: F.split(x, r"\s*(?:[|•·;,]|\t)\s*")))
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(x, BULLET, "")))
    fine = F.filter(bare, lambda x: (F.length(x) <= 120) & (F.size(F.split(x, r"\s+")) <= 12) & ~_has_period(x)
                    & ~_has_mail(x) & x.rlike("[A-Za-zÄÖÜäöüß]") & ~fold(x).isin(*fixed.NO_SKILLS))
    return ordered_distinct(F.transform(fine, _tidy))


def mentioned_skills(lines: Column, listed: Column, terms: Mapping[str, Sequence[str]] = fixed.SKILL_TERMS) -> Column:
    """Names of known skills that a line mentions, without those that a listed skill already spells out.

    The spelling that counts is the first one, in the order of the table, of the first line with any.
    A name found earlier counts as listed for the ones after it.
    """
    def known(text: Column, all_: Column) -> Column:
        said = F.array(*[F.struct(F.lit(name).alias("name"), _spelled(text, [py_fold(t) for t in spellings]).alias("said"))
                         for name, spellings in terms.items()])
        return F.aggregate(F.filter(said, lambda s: s["said"].isNotNull()), all_, lambda found, s: F.when(
            F.exists(found, lambda v: F.contains(fold(v), s["said"])), found).otherwise(F.array_append(found, s["name"])))

    def mentioned(text: Column) -> Column:
        return let(F.struct(known(text, text["listed"]).alias("all"), F.transform(text["listed"], fold).alias("keys")),
                   lambda s: F.filter(s["all"], lambda v: ~F.array_contains(s["keys"], fold(v))))

    folded = F.struct(F.transform(lines, fold).alias("lines"), listed.alias("listed"))
    return let(let(folded, lambda s: F.struct(
        s["lines"].alias("lines"), s["listed"].alias("listed"), F.array_join(s["lines"], "\n").alias("whole"))), mentioned)


def _spelled(text: Column, spellings: Sequence[str]) -> Column:
    """The spelling that counts, null if no line says one; ``text``: struct of the folded lines and their whole."""
    def word(t: str) -> str:
        return rf"(?U)(?<!\w){re.escape(t)}(?!\w)"

    any_of = "|".join(word(t) for t in spellings)
    said = _first(F.filter(text["lines"], lambda x: contains_any(x, spellings) & x.rlike(any_of)))
    return F.when(contains_any(text["whole"], spellings), let(
        said, lambda line: F.coalesce(*[F.when(line.rlike(word(t)), F.lit(t)) for t in spellings])))


def profile_suggestions(
    df: DataFrame, key: str, text: str, headings: Mapping[str, Sequence[str]] = fixed.SECTION_HEADINGS,
) -> DataFrame:
    """One row per text: full_name, current_title, email, phone, summary, languages, skills, education, certifications.

    All fields of a text come from its own row; no text moves. ``current_title`` is null where no line
    gives one; :func:`with_experience` fills it from the newest entry.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    raw = F.when(contains_any(whole, _BREAKS), F.split(whole, LINE_BREAK)).otherwise(F.split(whole, "\n"))
    lines = F.filter(F.transform(raw, lambda x: F.trim(x, F.lit(_SPACE))), lambda x: x != "")
    # lines without a word of any heading or term are not looked at again for them
    words = [w for table in (headings, fixed.LANGUAGE_TERMS, fixed.SKILL_TERMS) for ws in table.values() for w in ws]
    rows = df.select(key, lines.alias("_lines"))
    rows = rows.select(key, "_lines", notable_lines(F.col("_lines"), words).alias("_notable"),
                       suggested_name(F.col("_lines"), headings).alias("_name"))
    rows = rows.withColumn("_sections", sections(F.col("_lines"), headings, F.col("_notable")))
    label = r"(?i)\b(?:tel|telefon|mobil|mobile|phone)\b"
    # plain tests choose the few lines that can give a number or an address
    numbers = F.transform(F.filter("_lines", lambda x: x.rlike(_DIGITS)), lambda x: F.struct(
        x.rlike(label).alias("labelled"), phones(x).alias("found")))
    rows = rows.select(
        key, "_name", numbers.alias("_numbers"), F.filter("_lines", lambda x: F.contains(x, F.lit("@"))).alias("_at"),
        F.col("_notable.line").alias("_telling"),
        suggested_title(F.col("_lines"), F.col("_name.source"), headings).alias("_title"),
        section_lines(F.col("_sections"), "summary").alias("_summary"),
        section_lines(F.col("_sections"), "languages").alias("_languages"),
        F.concat(section_lines(F.col("_sections"), "skills"), section_lines(F.col("_sections"), "tools")).alias("_skills"),
        section_lines(F.col("_sections"), "education").alias("_education"),
        section_lines(F.col("_sections"), "certifications").alias("_certifications"),
    )
    rows = rows.withColumn("_listed", listed_skills(F.col("_skills")))
    mails = F.flatten(F.transform("_at", emails))
    phone = lambda wanted: _first(F.flatten(F.transform(
        F.filter("_numbers", lambda n: n["labelled"] == wanted), lambda n: n["found"])))
    summary = F.array_join(F.transform("_summary", lambda x: F.trim(F.regexp_replace(x, BULLET, ""))), " ")
    spoken = F.when(F.size("_languages") > 0, F.col("_languages")).otherwise(F.col("_telling"))
    return rows.select(
        key, F.col("_name.value").alias("full_name"), F.col("_title.value").alias("current_title"),
        _first(mails).alias("email"), F.coalesce(phone(True), phone(False)).alias("phone"),
        blank_to_null(summary).alias("summary"), spoken_languages(spoken).alias("languages"),
        F.concat("_listed", mentioned_skills(F.col("_telling"), F.col("_listed"))).alias("skills"),
        listed_entries(F.col("_education")).alias("education"),
        listed_entries(F.col("_certifications")).alias("certifications"),
    )


def with_experience(suggested: DataFrame, experience: DataFrame, key: str) -> DataFrame:
    """``experience_years`` of the union of all entries, and the newest role where no line gave a title."""
    from vakanz.operators.profiles import interval_union

    years = interval_union(experience, key, "start_month", "end_month").select(key, F.col("years").alias("experience_years"))
    role = experience.filter("role is not null").groupBy(key).agg(
        F.min(F.struct("position", "role")).alias("_newest")).select(key, F.col("_newest.role").alias("_role"))
    joined = suggested.join(years, key, "left").join(role, key, "left")
    return joined.withColumn("current_title", F.coalesce("current_title", "_role")).drop("_role")
