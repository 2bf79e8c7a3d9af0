"""URL rules as column expressions.

Parts are cut by the generic URI pattern instead of ``parse_url``, which gives null for
addresses a browser accepts (blanks, bars, unencoded letters).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanz import fixed
from vakanz.functions.text import blank_to_null, let, lookup, unescape

URI = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), URI, group)


def parts_of(url: Column) -> Column:
    """``struct<scheme,authority,path,query>``; bind it with ``let`` where several parts are used."""
    return F.struct(F.lower(_part(url, 1)).alias("scheme"), _part(url, 2).alias("authority"),
                    _part(url, 3).alias("path"), _part(url, 4).alias("query"))


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority_of(url: Column) -> Column:
    return _part(url, 2)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return _part(url, 4)


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(authority_of(url), "^.*@", ""), r":\d*$", "")
    return blank_to_null(F.regexp_replace(F.lower(host), r"\.+$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """Decoded ``array<struct<key,value>>`` of the query string."""
    return _pairs(query_of(url))


def _pairs(query: Column) -> Column:
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("key"),
            F.when(
                F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))
            ).otherwise("").alias("value"),
        ),
    )


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no fragment or tracking keys, sorted query, no final slash."""
    return let(parts_of(url), _canonical)


def _canonical(parts: Column) -> Column:
    pairs = F.array_sort(
        F.filter(
            _pairs(parts["query"]),
            lambda p: ~F.lower(p["key"]).startswith("utm_")
            & ~F.lower(p["key"]).isin(*fixed.TRACKING_KEYS),
        )
    )
    query = F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))),
        "&",
    )
    path = F.regexp_replace(parts["path"], "/+$", "")
    path = F.when(parts["path"].isin("", "/"), F.lit("/")).otherwise(path)
    built = F.concat(
        parts["scheme"],
        F.lit("://"),
        F.lower(parts["authority"]),
        path,
        let(query, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))),
    )
    absolute = parts["scheme"].isin("http", "https") & (parts["authority"] != "")
    return F.when(absolute, built)


def safe_url(url: Column) -> Column:
    """The link when it is absolute http(s) without credentials or control characters."""
    ok = (
        ~url.rlike(r"[\x00-\x1f]")
        & scheme_of(url).isin("http", "https")
        & host_of(url).isNotNull()
        & ~F.contains(authority_of(url), F.lit("@"))
    )
    return F.when(ok, F.trim(url))


def job_like(
    url: Column,
    paths: Sequence[str] = fixed.JOB_PATHS,
    query_keys: Sequence[str] = fixed.JOB_QUERY_KEYS,
) -> Column:
    def judged(parts: Column) -> Column:
        path = F.regexp_replace(F.lower(parts["path"]), "/+$", "")
        by_path = path.rlike("|".join(f"(?:{p})" for p in paths))
        by_key = F.exists(_pairs(parts["query"]), lambda p: F.lower(p["key"]).isin(*query_keys))
        return by_path | by_key

    return let(parts_of(url), judged)


def strong_job_like(url: Column, paths: Sequence[str] = fixed.STRONG_JOB_PATHS) -> Column:
    return job_like(url, paths)


def without_dots(url: Column) -> Column:
    """Remove ``.`` and ``..`` segments from the path of an address."""
    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .when(part == ".", done)
            .otherwise(F.array_append(done, part))
        )

    def clean(path: Column) -> Column:
        parts = F.split(path, "/")
        kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
        closed = F.when(path.rlike(r"/\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
        return F.array_join(closed, "/")

    def piece(n: int) -> Column:
        return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)([^?#]*)((?s:.*))$", n)

    return F.when(
        url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*[^?#]*/\.\.?(?:[/?#]|$)"),
        F.concat(piece(1), clean(piece(2)), piece(3)),
    ).otherwise(url)


def resolve(base: Column, link: Column) -> Column:
    """Join a link to the address of its page and remove dot segments."""
    found = let(F.struct(base.alias("url"), parts_of(base).alias("parts"), link.alias("link")),
                lambda x: _joined(x["url"], x["parts"], x["link"]))
    return let(found, without_dots)


def _joined(base: Column, parts: Column, link: Column) -> Column:
    origin = F.concat(parts["scheme"], F.lit("://"), parts["authority"])
    folder = F.regexp_replace(parts["path"], "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(parts["scheme"], F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", base)
        .when(
            link.startswith("?") | link.startswith("#"),
            F.concat(origin, parts["path"], link),
        )
        .otherwise(F.concat(origin, folder, link))
    )


def page_links(url: Column, html: Column, markdown: Column | None = None) -> Column:
    """Distinct absolute links of a page in reading order: markdown links first, then hrefs.

    The hrefs are decoded, joined and cleaned in three passes, so each step is computed once a link.
    """
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    decoded = F.transform(found, unescape)
    joined = let(F.struct(url.alias("url"), parts_of(url).alias("parts"), decoded.alias("links")), lambda x: F.transform(
        x["links"], lambda link: _joined(x["url"], x["parts"], link)))
    links = F.coalesce(F.transform(joined, without_dots), F.array().cast("array<string>"))
    if markdown is not None:
        marked = F.regexp_extract_all(markdown, F.lit(r"\]\(\s*<?(https?://[^)\s>]+)"), 1)
        links = F.concat(F.coalesce(marked, F.array().cast("array<string>")), links)
    return F.array_distinct(F.filter(links, lambda x: x.rlike("(?i)^https?:")))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` to ``[a.b.c, b.c, c]``: turns a suffix match into an equality join."""
    labels = F.split(host, r"\.")
    return F.transform(
        labels,
        lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."),
    )


def by_host_suffix(host: Column, table: Mapping[str, str]) -> Column:
    """Value of the first suffix of the host found in a small fixed table."""
    found = F.filter(
        F.transform(host_suffixes(host), lambda s: lookup(s, table)), lambda v: v.isNotNull()
    )
    return F.try_element_at(found, F.lit(1))


def portal_name(url: Column) -> Column:
    return by_host_suffix(host_of(url), fixed.KNOWN_PORTALS)


def portal_kind(url: Column) -> Column:
    return F.when(portal_name(url).isNotNull(), "job_portal").otherwise("company_site")


def board_provider(url: Column, hosts: Mapping[str, Sequence[str]] = fixed.BOARD_HOSTS) -> Column:
    return by_host_suffix(host_of(url), {h: p for p, hs in hosts.items() for h in hs})


def public_host(url: Column) -> Column:
    """Host of a web address that is open to all: a name with a dot or a public IPv4 address, port 80 or 443."""
    port = F.regexp_extract(authority_of(url), r":(\d+)$", 1)
    host = host_of(url)
    inside = host.rlike(r"^(?:0|10|127)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|\.(?:local|internal|localhost)$")
    ok = F.contains(host, F.lit(".")) & ~inside & port.isin("", "80", "443") & ~F.contains(authority_of(url), F.lit("@"))
    return F.when(ok, host)


def board_identifier(
    url: Column,
    provider: Column,
    hosts: Mapping[str, Sequence[str]] = fixed.BOARD_HOSTS,
    subdomain_rule: Sequence[str] = fixed.SUBDOMAIN_PROVIDERS,
    url_rule: Sequence[str] = fixed.URL_PROVIDERS,
) -> Column:
    """Tenant of a board: a plain identifier, or one from the subdomain, a path part or a query key.

    Providers that run under their customers' names have the whole secure address as identifier.
    """
    return let(F.struct(F.trim(url).alias("raw"), F.lower(F.trim(provider)).alias("provider"), parts_of(url).alias("parts"),
                        host_of(url).alias("host"), public_host(url).alias("open")),
               lambda b: _board(b, hosts, subdomain_rule, url_rule))


def _board(b: Column, hosts, subdomain_rule, url_rule) -> Column:
    provider, host = b["provider"], b["host"]
    places = F.filter(F.split(b["parts"]["path"], "/"), lambda p: p != "")
    first = _decode(F.try_element_at(places, F.lit(1)))
    second = _decode(F.try_element_at(places, F.lit(2)))
    wanted = F.try_element_at(
        F.filter(_pairs(b["parts"]["query"]), lambda p: (p["key"] == "for") & (p["value"] != "")), F.lit(1)
    )["value"]
    tenant = F.when(provider == "join", F.when(F.lower(first) == "companies", second)).when(
        provider == "greenhouse", F.coalesce(wanted, first)
    )
    for name in subdomain_rule:
        suffix = f".{hosts[name][0]}"
        cut = F.substring(host, F.lit(1), F.length(host) - len(suffix))
        tenant = tenant.when(provider == name, F.when(host.endswith(suffix), cut))
    known, listed = F.lit(False), [p for p in hosts if p not in url_rule]
    for name, allowed in hosts.items():
        for h in allowed:
            known = known | ((provider == name) & ((host == h) | host.endswith(f".{h}")))
    career = (host == fixed.PHENOM_HOST) | host.endswith(f".{fixed.PHENOM_HOST}") | F.substring_index(
        host, ".", 1).isin(*fixed.CAREER_LABELS)
    fits = F.when(provider == "phenom", career).when(provider.isin(*hosts), known).otherwise(True)
    whole = F.when((b["parts"]["scheme"] == "https") & b["open"].isNotNull() & fits, F.regexp_replace(b["raw"], "/+$", ""))
    is_url = (b["parts"]["scheme"] != "") | (b["parts"]["authority"] != "")
    reads = b["parts"]["scheme"].isin("http", "https") & ~F.contains(b["parts"]["authority"], F.lit("@")) & known
    cut = F.when(~is_url, b["raw"]).when(reads, tenant.otherwise(first))
    cut = F.regexp_replace(F.trim(cut), "^/+|/+$", "")
    plain = F.when(cut.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"), F.when(provider == "personio", F.lower(cut)).otherwise(cut))
    return F.when(provider.isin(*url_rule) & is_url, whole).when(provider.isin(*listed, *url_rule), plain)
