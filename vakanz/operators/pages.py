"""Crawled pages: targets by host, evidence, postings, and further pages to fetch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.parse import (
    coerce_list,
    parse_timestamp,
    remote_basis,
    remote_signal,
    render_locations,
    salary_range,
    title_location,
)
from vakanz.functions.text import blank_to_null, collapse, contains_any, fold, let, unescape
from vakanz.functions.urls import (
    bare_host,
    canonical_url,
    host_of,
    host_suffixes,
    job_like,
    page_links,
    path_of,
    resolve,
)
from vakanz.operators.common import dedupe_first, open_array

JSON_LD = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"
SCHEMA_TYPE = r"(?i)^(?:.*[/#])?jobposting$"


def match_targets(
    pages: DataFrame, targets: DataFrame, *, page_key: str = "page_key", url: str = "url"
) -> DataFrame:
    """First target whose host is the page's host or a parent of it.

    Every distinct host is opened into its suffixes once and meets the first target of each bare host
    by an equi join; pages then look their host up. Only keys, hosts and target columns move, never a
    page's text. ``targets``: target_pos, target_url and any further columns.
    """
    hosted = pages.select(page_key, bare_host(F.col(url)).alias("_host"))
    named = targets.withColumn("_suffix", bare_host(F.col("target_url")))
    order = [F.col("target_pos"), F.col("target_url")]
    first = dedupe_first(named, ["_suffix"], order)
    hosts = hosted.select("_host").distinct()
    opened = open_array(hosts, ["_host"], host_suffixes(F.col("_host")), "_suffix")
    best = dedupe_first(opened.join(first, "_suffix"), ["_host"], order).drop("_suffix")
    return hosted.join(best, "_host").drop("_host")


# marks a string that starts with a bracket, so that text of a value is never taken for a nested one
_STRING_MARK = "\ue000"
_NODES = "array<struct<path: array<int>, json: string>>"


def json_ld_posting(html: Column) -> Column:
    """First JobPosting object of the page's JSON-LD blocks as JSON text, null when none.

    Objects and lists are opened level by level to any depth, each node with the path of its place, so the
    least path is the first object in reading order. A level costs what it holds; a page without the
    word JobPosting in a block is not opened.
    """
    cleaned = F.transform(
        F.regexp_extract_all(html, F.lit(JSON_LD), 1),
        lambda b: F.trim(F.regexp_replace(F.trim(b), r"^<!--|-->$", "")),
    )
    blocks = F.filter(cleaned, lambda b: b.rlike("(?i)jobposting") & F.try_parse_json(b).isNotNull())
    marked = F.transform(blocks, lambda b: F.regexp_replace(b, r'"(\s*[{\[])', f'"{_STRING_MARK}$1'))
    start = F.struct(
        F.array().cast(_NODES).alias("found"),
        F.transform(marked, lambda b, i: F.struct(F.array(i).alias("path"), b.alias("json"))).cast(_NODES).alias("open"),
    )

    def is_posting(node: Column) -> Column:
        own = F.from_json(node["json"], "map<string,string>")
        kinds = coerce_list(F.replace(F.try_element_at(own, F.lit("@type")), F.lit(_STRING_MARK), F.lit("")))
        return node["json"].startswith("{") & F.coalesce(F.exists(kinds, lambda k: k.rlike(SCHEMA_TYPE)), F.lit(False))

    def children(node: Column) -> Column:
        inner = F.when(node["json"].startswith("{"), F.map_values(F.from_json(node["json"], "map<string,string>"))).otherwise(
            F.from_json(node["json"], "array<string>"))
        placed = F.transform(inner, lambda v, i: F.struct(
            F.concat(node["path"], F.array(i)).alias("path"), v.alias("json")))
        return F.coalesce(F.filter(placed, lambda c: c["json"].rlike(r"^[{\[]")), F.array().cast(_NODES))

    def level(state: Column, _: Column) -> Column:
        return F.struct(
            F.concat(state["found"], F.filter(state["open"], is_posting)).cast(_NODES).alias("found"),
            F.flatten(F.transform(state["open"], children)).cast(_NODES).alias("open"),
        )

    text = F.array_join(marked, "")
    depth = F.length(text) - F.length(F.translate(text, "{[", "")) + 1  # more levels than brackets can't be
    walked = F.aggregate(F.sequence(F.lit(1), depth), start, level, lambda s: F.array_sort(s["found"]))
    first = F.replace(F.try_element_at(walked, F.lit(1))["json"], F.lit(_STRING_MARK), F.lit(""))
    return F.when(html.rlike("(?i)ld\\+json") & html.rlike("(?i)jobposting"), first)


def signal_flags(text: Column, groups: Sequence[Sequence[str]] = fixed.SIGNAL_GROUPS) -> Column:
    """Which content groups of a posting occur in the text, as ``array<boolean>``."""
    return let(fold(text), lambda folded: F.array(*[contains_any(folded, terms) for terms in groups]))


def signal_count(text: Column, groups: Sequence[Sequence[str]] = fixed.SIGNAL_GROUPS) -> Column:
    """How many content groups of a posting occur in the text."""
    return F.size(F.filter(signal_flags(text, groups), lambda x: x))


def generic_title(title: Column, titles: Sequence[str] = fixed.GENERIC_TITLES) -> Column:
    text = F.regexp_replace(
        F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"(?U)\s+", " "), r"^[ \-|]+|[ \-|]+$", ""
    )
    return text.isin(*titles)


def heading_title(markdown: Column) -> Column:
    return blank_to_null(collapse(F.regexp_extract(markdown, r"(?m)^\s*#\s+(.+?)\s*$", 1)))


def title_from_url(url: Column) -> Column:
    tail = F.regexp_extract(F.regexp_replace(path_of(url), "/+$", ""), "([^/]*)$", 1)
    words = F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(tail), tail), "[-_]+", " "))
    return blank_to_null(F.initcap(words))


def html_title(html: Column) -> Column:
    """``title`` element of a page, as the crawl service reports it in its metadata."""
    return blank_to_null(
        collapse(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    )


def page_facts(
    pages: DataFrame,
    *,
    html: str = "html",
    markdown: str | None = None,
    signal_groups: Sequence[Sequence[str]] = fixed.SIGNAL_GROUPS,
) -> DataFrame:
    """What a decision needs of a page's text, read where the page is stored.

    Adds ``_ld``, ``_html_title``, ``_flags`` and ``_head``, the start of the text that a term beginning
    in the title can reach into. Compute it before pages meet their targets: a plan that doesn't select
    the text afterwards then never moves it.
    """
    body = F.concat_ws(" ", F.col(markdown) if markdown else F.lit(""), F.coalesce(html, F.lit("")))
    reach = max((len(t) for terms in signal_groups for t in terms), default=1) - 1
    return pages.withColumns({
        "_ld": json_ld_posting(F.col(html)), "_html_title": html_title(F.col(html)),
        "_flags": signal_flags(body, signal_groups),
        "_head": fold(F.substring(body, 1, reach)),
    })


def page_to_posting(
    pages: DataFrame,
    *,
    url: str = "url",
    html: str = "html",
    markdown: str | None = None,
    metadata: str | None = None,
    job_paths: Sequence[str] = fixed.JOB_PATHS,
    signal_groups: Sequence[Sequence[str]] = fixed.SIGNAL_GROUPS,
) -> DataFrame:
    """Decide for every page whether it is a posting, and read the posting's fields.

    Input columns besides the page: target_url, target_kind, target_label and optionally
    target_company, target_location, accept_all_pages (see ``match_targets``). ``metadata`` is
    a ``map<string,string>`` column with lower-case keys. Output adds accepted, evidence,
    confidence, external_id, title, company, locations, remote, salary and dates. No shuffle.
    Pages may come with the columns of ``page_facts``; else they are read here.
    """
    nothing = F.lit(None).cast("string")

    def meta(*names: str) -> Column:
        if metadata is None:
            return nothing
        m = F.col(metadata)
        return F.coalesce(
            *[blank_to_null(collapse(F.try_element_at(m, F.lit(n.lower())))) for n in names]
        )

    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in pages.columns else default

    def ld(path: str) -> Column:
        return blank_to_null(F.get_json_object("_ld", path))

    marked = F.col(markdown) if markdown else F.lit("")
    df = pages if "_ld" in pages.columns else page_facts(
        pages, html=html, markdown=markdown, signal_groups=signal_groups)
    own = F.coalesce(blank_to_null(F.col(url)), meta("sourceURL", "url", "canonicalUrl", "ogUrl"),
                     F.col("target_url"))
    df = df.withColumn(
        "canonical_url", canonical_url(resolve(own, F.coalesce(ld("$.url"), own)))
    )
    df = df.withColumn(
        "title",
        F.coalesce(
            collapse(ld("$.title")),
            meta("jobTitle", "title", "ogTitle"),
            F.col("_html_title") if metadata is None else nothing,
            heading_title(marked),
            title_from_url(F.col("canonical_url")),
        ),
    )
    named_text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "_head")
    flags = F.zip_with("_flags", signal_flags(named_text, signal_groups), lambda x, y: x | y)
    df = df.withColumn("_signals", F.size(F.filter(flags, lambda x: x)))

    has_ld = F.col("_ld").isNotNull()
    like = F.coalesce(job_like(F.col("canonical_url"), job_paths), F.lit(False))
    structured = F.coalesce(
        meta("jobTitle", "company", "location", "employmentType").isNotNull(), F.lit(False)
    )
    searched = F.coalesce(meta("firecrawlSearchResult") == "true", F.lit(False))
    portal = F.col("target_kind") == "job_portal"
    take_all = optional("accept_all_pages", F.lit(False))
    listing = portal & ~take_all & ~has_ld & (
        F.col("canonical_url") == canonical_url(F.col("target_url"))
    )
    portal_ok = (meta("jobTitle").isNotNull() & meta("company", "companyName").isNotNull()) | (
        searched & like & (F.col("_signals") >= 2)
    )
    site_ok = like | (F.col("_signals") >= 2) | structured
    named = F.col("title").isNotNull() & ~generic_title(F.col("title"))
    by_rule = has_ld | (named & F.when(portal, portal_ok).otherwise(site_ok))
    by_target = take_all & named & (by_rule | (F.col("_signals") >= 1) | structured)
    accepted = ~listing & (by_rule | by_target) & F.col("title").isNotNull()
    evidence = F.filter(
        F.array(
            F.when(has_ld, "json_ld_jobposting"),
            F.when(like, "job_like_url"),
            F.when(
                F.col("_signals") > 0,
                F.concat(F.lit("content_signals:"), F.col("_signals").cast("string")),
            ),
            F.when(structured, "structured_metadata"),
            F.when(searched, "firecrawl_search"),
            F.when(by_target, "target_accept_all_pages"),
        ),
        lambda e: e.isNotNull(),
    )
    df = df.withColumn("accepted", F.coalesce(accepted, F.lit(False))).withColumn("evidence", evidence)

    address = F.from_json(
        F.get_json_object("_ld", "$.jobLocation"),
        "array<struct<address:struct<postalCode:string,addressLocality:string,"
        "addressRegion:string,addressCountry:string>>>",
    )
    rendered = render_locations(
        F.transform(
            address,
            lambda a: F.struct(
                a["address"]["postalCode"].alias("postcode"),
                a["address"]["addressLocality"].alias("city"),
                a["address"]["addressRegion"].alias("region"),
                F.coalesce(
                    F.get_json_object(a["address"]["addressCountry"], "$.name"),
                    a["address"]["addressCountry"],
                ).alias("country"),
            ),
        )
    )
    fallback = F.coalesce(
        meta("jobLocation", "location", "address"),
        title_location(meta("jobTitle", "title")) if metadata else nothing,
        optional("target_location", nothing),
    )
    empty = F.array().cast("array<string>")
    locations = F.when(F.size(rendered) > 0, rendered).when(
        fallback.isNotNull(), F.array(fallback)
    ).otherwise(empty)
    regions = F.transform(
        coerce_list(F.get_json_object("_ld", "$.applicantLocationRequirements")),
        lambda r: F.concat(r, F.lit(" (Remote)")),
    )
    df = df.withColumn("locations", F.array_distinct(F.concat(locations, F.coalesce(regions, empty))))

    kind = ld("$.jobLocationType")
    flag = meta("remote", "isRemote", "workplaceType", "remote_type")
    company = F.coalesce(
        ld("$.hiringOrganization.name"),
        ld("$.hiringOrganization.legalName"),
        meta("company", "companyName"),
        optional("target_company", nothing),
        meta("ogSiteName"),
    )
    exact = F.coalesce(ld("$.baseSalary.value.value"), ld("$.baseSalary.value.minValue"),
                       ld("$.baseSalary.value.maxValue"))
    both = ld("$.baseSalary.value.minValue").isNotNull() & ld("$.baseSalary.value.maxValue").isNotNull()
    salary = salary_range(
        F.when(both, ld("$.baseSalary.value.minValue")).otherwise(exact),
        F.when(both, ld("$.baseSalary.value.maxValue")),
        ld("$.baseSalary.currency"),
        F.coalesce(ld("$.baseSalary.unitText"), ld("$.baseSalary.value.unitText")),
    )
    return df.select(
        *[c for c in df.columns if not c.startswith("_") and c not in ("title", "company")],
        F.trim(unescape(F.col("title"))).alias("title"),
        collapse(company).alias("company"),
        F.when(F.col("accepted"), posting_id(F.col("canonical_url"))).alias("external_id"),
        F.when(has_ld, "high").when(F.size("evidence") >= 2, "medium").otherwise("low").alias("confidence"),
        F.coalesce(ld("$.identifier.value"), ld("$.identifier.name"),
                   F.when(~ld("$.identifier").startswith("{"), ld("$.identifier"))).alias("provider_identifier"),
        remote_signal(kind, flag, F.col("locations"), F.concat_ws(" ", "title", marked)).alias("remote"),
        remote_basis(kind, meta("workplaceType", "remote_type")).alias("remote_basis"),
        coerce_list(
            F.coalesce(ld("$.employmentType"), meta("employmentType", "employment_types", "jobType"))
        ).alias("employment_types"),
        salary.alias("salary"),
        F.coalesce(ld("$.description"), blank_to_null(marked), F.col(html)).alias("description"),
        F.when(ld("$.description").isNotNull(), "html").when(blank_to_null(marked).isNotNull(), "markdown")
        .otherwise("html").alias("description_format"),
        parse_timestamp(F.coalesce(ld("$.datePosted"), meta("datePosted", "publishedTime"))).alias("published_at"),
        parse_timestamp(
            F.coalesce(ld("$.dateModified"), meta("modifiedTime", "updatedAt", "lastModified"))
        ).alias("updated_at"),
    )


def posting_id(url: Column) -> Column:
    return F.concat(F.lit("firecrawl:"), F.substring(F.sha2(url, 256), 1, 40))


def target_run_results(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters and status of one target in one run from its page outcomes.

    ``outcome`` is emitted, rejected, duplicate, filtered or error; a row with a null outcome
    stands for a target that was started and saw no page.
    """

    def n(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    counted = outcomes.groupBy(*keys).agg(
        F.count("outcome").alias("documents_seen"),
        n("emitted").alias("records_emitted"),
        n("rejected").alias("pages_rejected"),
        n("duplicate").alias("duplicates_skipped"),
        n("filtered").alias("query_filtered"),
        n("error").alias("page_error_count"),
    )
    emitted, failed = F.col("records_emitted") > 0, F.col("page_error_count") > 0
    status = (
        F.when(failed & emitted, "partial")
        .when(failed, "failed")
        .when(emitted, "completed")
        .when(F.col("documents_seen") > 0, "insufficient")
        .otherwise("empty")
    )
    return counted.withColumn("status", status)


def discovered_domains(pages: DataFrame, url: str = "url") -> DataFrame:
    return (
        pages.select(host_of(F.col(url)).alias("host"))
        .filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("pages"))
    )


def discover_details(
    listings: DataFrame,
    seen: DataFrame,
    *,
    url: str = "url",
    html: str = "html",
    strong_paths: Sequence[str] = fixed.STRONG_JOB_PATHS,
) -> DataFrame:
    """Pages worth fetching next: a strong posting address itself, else its same-site links.

    Links are opened per page, reduced to canonical form, made distinct, and those in ``seen``
    (column ``canonical_url``) are dropped by an anti join.
    """
    direct = F.coalesce(job_like(F.col(url), strong_paths), F.lit(False))
    links = F.when(direct, F.array(F.col(url))).otherwise(page_links(F.col(url), F.col(html)))
    opened = open_array(listings, [bare_host(F.col(url)).alias("_site")], links, "_link")
    found = opened.select(
        canonical_url(F.col("_link")).alias("canonical_url"),
        (bare_host(F.col("_link")) == F.col("_site")).alias("_same"),
        job_like(F.col("_link"), strong_paths).alias("_strong"),
    ).filter(F.col("_same") & F.col("_strong") & F.col("canonical_url").isNotNull())
    return found.select("canonical_url").distinct().join(seen, "canonical_url", "left_anti")
