"""From landed provider payloads to canonical posting records.

A provider is a ``Spec``: where its items are and, per canonical field, a rule over one item.
The payload is parsed once into a variant; every rule reads that. Rules compile to plain
columns, so a provider is one ``select`` without UDFs or shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.parse import parse_timestamp, variant_text
from vakanz.functions.text import blank_to_null, fold
from vakanz.operators.common import dedupe_first, open_array

Rule = Callable[[Column], Column]

CANONICAL = (
    "source_job_id", "title", "company", "locations", "description", "description_format",
    "canonical_url", "apply_url", "published_at", "updated_at", "employment_types", "remote",
    "salary", "metadata",
)
EMPTY = "array<string>"


def no_list() -> Column:
    return F.array().cast(EMPTY)


# --- rules ----------------------------------------------------------------------------------


def get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path if path.startswith("$") else f"$.{path}", kind)


def text(*paths: str) -> Rule:
    """First non-blank scalar of the paths."""

    def rule(item: Column) -> Column:
        found = [get(item, p) for p in paths]
        return F.coalesce(*[F.when(~t.rlike(r"^[\[{]"), blank_to_null(t)) for t in found])

    return rule


def strings(*paths: str) -> Rule:
    """First non-empty path as distinct texts: a scalar, a list, or a list of named objects."""

    def one(item: Column, path: str) -> Column:
        listed = F.transform(get(item, path, "array<variant>"), variant_text)
        single = F.array(variant_text(get(item, path, "variant")))
        values = F.filter(F.coalesce(listed, single), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.array_distinct(values))

    def rule(item: Column) -> Column:
        return F.coalesce(*[one(item, p) for p in paths], no_list())

    return rule


def union(*rules: Rule) -> Rule:
    """Distinct texts of several list rules, order kept."""
    return lambda item: F.array_distinct(F.concat(*[r(item) for r in rules]))


def as_list(rule: Rule) -> Rule:
    return lambda item: F.filter(F.array(rule(item)), lambda v: v.isNotNull())


def first(*rules: Rule) -> Rule:
    return lambda item: F.coalesce(*[r(item) for r in rules])


def const(value: str | bool | None) -> Rule:
    return lambda item: F.lit(value)


def param(name: str) -> Rule:
    """A value of the target (company, base address, tenant), joined to the payload row."""
    return lambda item: blank_to_null(F.col(f"target.{name}"))


def joined(separator: str, *rules: Rule) -> Rule:
    return lambda item: F.nullif(F.concat_ws(separator, *[r(item) for r in rules]), F.lit(""))


def when_present(rule: Rule, value: str) -> Rule:
    return lambda item: F.when(rule(item).isNotNull(), F.lit(value))


def flag(*paths: str) -> Rule:
    """First real boolean of the paths."""

    def rule(item: Column) -> Column:
        return F.coalesce(
            *[
                F.when(get(item, p).isin("true", "false"), get(item, p, "boolean"))
                for p in paths
            ]
        )

    return rule


def time(*paths: str) -> Rule:
    return lambda item: parse_timestamp(text(*paths)(item))


def workplace(rule: Rule, yes: Sequence[str], no: Sequence[str] = (), part: bool = False) -> Rule:
    """Tri-state remote flag from a workplace text, by equality or by containment."""

    def hit(t: Column, words: Sequence[str]) -> Column:
        if not part:
            return t.isin(*words)
        result = F.lit(False)
        for w in words:
            result = result | F.contains(t, F.lit(w))
        return result

    def compiled(item: Column) -> Column:
        t = fold(rule(item))
        out = F.when(hit(t, yes), True)
        return out.when(hit(t, no), False) if no else out

    return compiled


def any_contains(rule: Rule, words: Sequence[str]) -> Rule:
    """True when any text of a list contains a word, else null."""

    def compiled(item: Column) -> Column:
        def test(v: Column) -> Column:
            result = F.lit(False)
            for w in words:
                result = result | F.contains(fold(v), F.lit(w))
            return result

        return F.when(F.exists(rule(item), test), True)

    return compiled


def last_segment(rule: Rule) -> Rule:
    def compiled(item: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(rule(item), r"[?#].*$", ""), "/+$", "")
        return blank_to_null(F.regexp_extract(path, "([^/]*)$", 1))

    return compiled


def template(pattern: str, **rules: Rule) -> Rule:
    """``https://host/{slug}`` filled from rules; null when any part is missing."""

    def compiled(item: Column) -> Column:
        pieces, rest = [], pattern
        while "{" in rest:
            head, tail = rest.split("{", 1)
            name, rest = tail.split("}", 1)
            pieces += [F.lit(head), rules[name](item)]
        return F.concat(*pieces, F.lit(rest))

    return compiled


def same_host(rule: Rule, base: Rule) -> Rule:
    """The address resolved against a base, kept only when https and on the base's host."""
    from vakanz.functions.urls import authority_of, host_of, resolve, scheme_of

    def compiled(item: Column) -> Column:
        root = base(item)
        url = resolve(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")), rule(item))
        fine = (
            (scheme_of(url) == "https")
            & (host_of(url) == host_of(root))
            & ~F.contains(authority_of(url), F.lit("@"))
        )
        return F.when(fine, url)

    return compiled


def html_or_text(rule: Rule) -> Rule:
    return lambda item: F.when(rule(item).isNull(), None).otherwise(
        F.when(F.contains(rule(item), F.lit("<")), "html").otherwise("text")
    )


def sections(path: str, heading: str = "title", body: str = "text") -> Rule:
    """Map of named sections rendered as headed blocks."""

    def compiled(item: Column) -> Column:
        blocks = F.transform(
            F.map_values(get(item, path, "map<string,variant>")),
            lambda s: F.concat(
                F.coalesce(
                    F.concat(
                        F.lit("<h2>"), blank_to_null(F.try_variant_get(s, f"$.{heading}", "string")),
                        F.lit("</h2>"),
                    ),
                    F.lit(""),
                ),
                blank_to_null(F.try_variant_get(s, f"$.{body}", "string")),
            ),
        )
        return F.nullif(
            F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n"), F.lit("")
        )

    return compiled


def named_value(path: str, words: Sequence[str]) -> Rule:
    """Value list of the first ``{name, value}`` entry whose name contains a word."""

    def compiled(item: Column) -> Column:
        def wanted(e: Column) -> Column:
            name = fold(F.coalesce(F.try_variant_get(e, "$.name", "string"), F.lit("")))
            result = F.lit(False)
            for w in words:
                result = result | F.contains(name, F.lit(w))
            return result

        entry = F.try_element_at(F.filter(get(item, path, "array<variant>"), wanted), F.lit(1))
        listed = F.transform(F.try_variant_get(entry, "$.value", "array<variant>"), variant_text)
        single = F.array(variant_text(F.try_variant_get(entry, "$.value", "variant")))
        return F.coalesce(
            F.filter(F.coalesce(listed, single), lambda v: v.isNotNull()), no_list()
        )

    return compiled


def flag_labels(flags: Sequence[tuple[str, str]], *roots: str) -> Rule:
    """Labels of the true flags, first root that has the flag wins."""

    def compiled(item: Column) -> Column:
        labels = [
            F.when(
                F.lower(F.coalesce(*[get(item, f"$.{r}.{key}") for r in roots])) == "true",
                F.lit(label),
            )
            for key, label in flags
        ]
        return F.array_distinct(F.filter(F.array(*labels), lambda v: v.isNotNull()))

    return compiled


def meta(**rules: Rule) -> Rule:
    """Metadata map of the entries that have a value."""

    def compiled(item: Column) -> Column:
        pairs = [x for k, r in rules.items() for x in (F.lit(k), r(item).cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    return compiled


# --- specs ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """One provider: item lists to look at in order, and a rule per canonical field."""

    provider: str
    items: tuple[str, ...]
    fields: Mapping[str, Rule]
    unwrap: str | None = None
    keep: Rule | None = None
    payload: str = "json"
    xml_items: str = ""
    cards: str = ""
    parts: Mapping[str, str] = field(default_factory=dict)
    escaped: bool = False


SPECS: dict[str, Spec] = {}


def register(spec: Spec) -> Spec:
    """Add a provider by name; a registered provider is data, not an operator."""
    SPECS[spec.provider] = spec
    return spec


def explode_items(df: DataFrame, spec: Spec, payload: str = "payload") -> DataFrame:
    """One row per posting object: the first list found under the spec's paths."""
    parsed = df.withColumn("_payload", F.try_parse_json(payload))
    lists = [F.try_variant_get("_payload", p, "array<variant>") for p in spec.items]
    kept = [c for c in df.columns if c != payload]
    rows = open_array(parsed, kept, F.coalesce(*lists), "item", "item_pos")
    if spec.unwrap:
        inner = F.try_variant_get("item", spec.unwrap, "variant")
        rows = rows.withColumn("item", F.coalesce(inner, F.col("item")))
    return rows


def normalize_items(rows: DataFrame, spec: Spec) -> DataFrame:
    """Canonical columns of exploded items; ``target`` is a struct of target values."""
    item = F.col("item")
    kinds = {
        "locations": EMPTY, "employment_types": EMPTY, "published_at": "timestamp",
        "updated_at": "timestamp", "remote": "boolean", "metadata": "map<string,string>",
    }
    if spec.keep is not None:
        rows = rows.filter(spec.keep(item))
    columns = []
    for name in CANONICAL:
        rule = spec.fields.get(name)
        kind = kinds.get(name, "string")
        if rule is not None:
            column = rule(item).cast(kind)
        elif kind == EMPTY:
            column = no_list()
        else:
            column = F.lit(None).cast(kind)
        columns.append(column.alias(name))
    kept = [c for c in rows.columns if c not in ("item", "target")]
    return rows.select(
        *kept, F.lit(spec.provider).alias("source"), *columns, F.to_json(item).alias("raw")
    )


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with an id and a title, and the rest."""
    good = (
        blank_to_null(F.col("source_job_id")).isNotNull()
        & blank_to_null(F.col("title")).isNotNull()
        & blank_to_null(F.col("source")).isNotNull()
    )
    good = F.coalesce(good, F.lit(False))
    return records.filter(good), records.filter(~good)


def normalize_payload(
    df: DataFrame, spec: Spec, payload: str = "payload"
) -> tuple[DataFrame, DataFrame]:
    """Landed payloads to (valid, rejected) canonical records."""
    if "target" not in df.columns:
        df = df.withColumn(
            "target",
            F.struct(*[F.lit(None).cast("string").alias(n) for n in TARGET_FIELDS]),
        )
    opener = {"xml": explode_xml, "html": explode_cards}.get(spec.payload, explode_items)
    rows = opener(df, spec, payload)
    return split_valid(normalize_items(rows, spec))


def quarantine(df: DataFrame, spec: Spec, payload: str = "payload") -> DataFrame:
    """Payloads that give no record, with a ``reason``, and records that the spec filters out.

    Together with the two frames of :func:`normalize_payload` every payload and record is
    accounted for: ``unreadable`` (null or malformed), ``no list`` (readable, none of the spec's
    lists, items or cards in it), ``cut off`` (XML whose items are not all closed; the closed ones are
    records), ``filtered`` (one row per record that ``spec.keep`` leaves out, with its position).
    ``raw`` holds the payload, or the record that was filtered.
    """
    kept = [c for c in df.columns if c != payload]
    if spec.payload in ("xml", "html"):
        blank = blank_to_null(F.col(payload)).isNull()
        if spec.payload == "xml":
            body = F.regexp_replace(payload, NAME_SPACE, "<$1")
            opened = F.regexp_count(body, F.lit(rf"<{spec.xml_items}(?=[\s>])"))
            closed = F.regexp_count(body, F.lit(f"</{spec.xml_items}>"))
            reason = F.when(opened > closed, "cut off").when(closed == 0, "no list")
            opener = explode_xml
        else:
            reason = F.when(F.regexp_count(card_body(spec, payload), F.lit(spec.cards)) == 0, "no list")
            opener = explode_cards
        unread = df.withColumn("reason", F.when(blank, "unreadable").otherwise(reason))
    else:
        parsed = df.withColumn("_payload", F.try_parse_json(payload))
        lists = F.coalesce(*[F.try_variant_get("_payload", p, "array<variant>") for p in spec.items])
        unread = parsed.withColumn(
            "reason", F.when(F.col("_payload").isNull(), "unreadable").when(lists.isNull(), "no list"))
        opener = explode_items
    unread = unread.filter("reason IS NOT NULL").select(
        *kept, "reason", F.lit(None).cast("int").alias("item_pos"), F.col(payload).alias("raw"))
    if spec.keep is None:
        return unread
    rows = opener(df, spec, payload).filter(~F.coalesce(spec.keep(F.col("item")), F.lit(False)))
    return unread.unionByName(rows.select(
        *kept, F.lit("filtered").alias("reason"), F.col("item_pos").cast("int"), F.to_json("item").alias("raw")))


def left_out(df: DataFrame, spec: Spec, payload: str = "payload") -> DataFrame:
    """Everything landed that becomes no posting, with ``reason`` (of :func:`quarantine`, or ``invalid``),
    ``item_pos`` and ``raw``; ``landed`` is the rest of the landed row as JSON."""
    rest = [c for c in df.columns if c != payload]
    df = df.withColumn("landed", F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string"))
    shape = ["landed", "reason", "item_pos", "raw"]
    if spec.payload not in ("xml", "html"):
        return _items_left_out(df, spec, payload).select(*shape)
    _, rejected = normalize_payload(df, spec, payload)
    invalid = rejected.select(
        "landed", F.lit("invalid").alias("reason"), F.col("item_pos").cast("int").alias("item_pos"), "raw")
    return quarantine(df, spec, payload).select(*shape).unionByName(invalid)


def _items_left_out(df: DataFrame, spec: Spec, payload: str) -> DataFrame:
    """:func:`left_out` of JSON payloads, each opened once."""
    if "target" not in df.columns:
        df = df.withColumn("target", F.struct(*[F.lit(None).cast("string").alias(n) for n in TARGET_FIELDS]))
    lists = F.coalesce(*[F.try_variant_get("_payload", p, "array<variant>") for p in spec.items])
    opened = df.withColumn("_payload", F.try_parse_json(payload)).withColumn("_list", lists)
    unread = F.when(F.col("_payload").isNull(), "unreadable").when(F.col("_list").isNull(), "no list")
    kept = [c for c in df.columns if c != payload]
    rows = opened.select(*kept, payload, unread.alias("_unread"), "_list").select(
        *kept, "_unread", F.when(F.col("_unread").isNotNull(), F.col(payload)).alias("_whole"),
        F.posexplode_outer("_list").alias("item_pos", "item"))
    rows = rows.filter(F.col("item").isNotNull() | F.col("_unread").isNotNull())
    if spec.unwrap:
        rows = rows.withColumn("item", F.coalesce(F.try_variant_get("item", spec.unwrap, "variant"), F.col("item")))
    item = F.col("item")
    named = [blank_to_null(spec.fields[name](item).cast("string")).isNotNull() if name in spec.fields else F.lit(False)
             for name in ("source_job_id", "title")]
    good = named[0] & named[1] & blank_to_null(F.lit(spec.provider)).isNotNull()
    reason = F.when(F.col("_unread").isNotNull(), F.col("_unread"))
    if spec.keep is not None:
        reason = reason.when(~F.coalesce(spec.keep(item), F.lit(False)), "filtered")
    reason = reason.when(~F.coalesce(good, F.lit(False)), "invalid")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        "landed", "reason", F.col("item_pos").cast("int").alias("item_pos"),
        F.when(F.col("_unread").isNotNull(), F.col("_whole")).otherwise(F.to_json("item")).alias("raw"))


TARGET_FIELDS = ("company", "base_url", "tenant", "language")
NAME_SPACE = r"<(/?)[A-Za-z_][\w.-]*:"


def explode_xml(df: DataFrame, spec: Spec, payload: str = "payload") -> DataFrame:
    """XML feeds to the same item variant: cut at the item element, children by local name.

    Name-space prefixes are dropped, character data is unwrapped, repeated elements become
    lists. Each child of an item is read as ``name -> [texts]``.
    """
    tag = spec.xml_items
    body = F.regexp_replace(payload, NAME_SPACE, "<$1")
    items = F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    rows = open_array(df, [c for c in df.columns if c != payload], items, "_xml", "item_pos")
    names = spec.items
    values = [xml_texts(F.col("_xml"), n) for n in names]
    as_map = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    return rows.withColumn("item", F.try_parse_json(F.to_json(as_map))).drop("_xml")


def xml_texts(xml: Column, name: str) -> Column:
    """Texts of all elements called ``name``; ``a/b`` reads ``b`` inside every ``a``."""
    from vakanz.functions.text import unescape

    outer, _, inner = name.partition("/")
    found = F.regexp_extract_all(
        xml, F.lit(rf"(?s)<{outer}(?:\s[^>]*)?>(.*?)</{outer}>"), 1
    )
    if inner:
        found = F.flatten(F.transform(found, lambda x: xml_texts(x, inner)))
    is_data = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    plain = F.transform(
        found,
        lambda x: F.when(x.rlike(is_data), F.regexp_extract(x, is_data, 1)).otherwise(unescape(x)),
    )
    return F.filter(F.transform(plain, lambda x: F.trim(x)), lambda x: x != "")


def card_body(spec: Spec, payload: str) -> Column:
    """The text in which the cards of a page are looked for."""
    from vakanz.functions.text import unescape

    body = F.regexp_replace(payload, r"<!\[CDATA\[|\]\]>", "")
    return unescape(body) if spec.escaped else body


def explode_cards(df: DataFrame, spec: Spec, payload: str = "payload") -> DataFrame:
    """Result cards of a landed HTML page: one pattern per card, one per field of a card.

    A field is the first match inside its card, without tags and with entities decoded.
    """
    from vakanz.functions.text import collapse, unescape

    cards = F.regexp_extract_all(card_body(spec, payload), F.lit(spec.cards), 0)
    rows = open_array(df, [c for c in df.columns if c != payload], cards, "_card", "item_pos")
    texts = [
        blank_to_null(
            collapse(unescape(F.regexp_replace(F.regexp_extract("_card", p, 1), "<[^>]*>", " ")))
        )
        for p in spec.parts.values()
    ]
    as_map = F.map_from_arrays(F.array(*[F.lit(n) for n in spec.parts]), F.array(*texts))
    return rows.withColumn("item", F.try_parse_json(F.to_json(as_map))).drop("_card")


# --- record-level landing operators ----------------------------------------------------------


def namespaced_id(board: Column, job_id: Column, maximum: int = 300) -> Column:
    """``board:id``; a longer one keeps 200 characters of the board and hashes the whole."""
    full = F.concat_ws(":", board, job_id)
    short = F.concat(F.substring(board, 1, 200), F.lit(":"), F.sha2(full, 256))
    return F.when(F.length(full) > maximum, short).otherwise(full)


def board_counters(records: DataFrame, board: str = "board") -> DataFrame:
    """Emitted and failed records per board of a multi-board source."""
    return records.groupBy(board).agg(
        F.count_if(F.col("error").isNull()).alias("records_emitted"),
        F.count_if(F.col("error").isNotNull()).alias("target_errors"),
    )


def parse_boards(sources: DataFrame, key: str, config: str) -> DataFrame:
    """Configured boards: a text or an object, first of four id keys, first spelling kept."""
    listed = F.from_json(F.col(config), "array<string>")
    items = open_array(sources, [key], listed, "_item", "pos")

    def part(*names: str) -> Column:
        return F.coalesce(*[blank_to_null(F.get_json_object("_item", f"$.{n}")) for n in names])

    plain = ~F.trim("_item").startswith("{")
    identifier = F.when(plain, blank_to_null(F.col("_item"))).otherwise(
        part("identifier", "id", "board", "company_identifier")
    )
    rows = items.select(
        key, "pos", identifier.alias("identifier"), F.when(~plain, part("company")).alias("company")
    ).filter(F.col("identifier").isNotNull())
    unique = dedupe_first(
        rows.withColumn("_fold", fold(F.col("identifier"))), [key, "_fold"], [F.col("pos")]
    )
    return unique.drop("_fold")


def dedupe_targets(
    targets: DataFrame, key: str, url: str, mode: str, pos: str, *, address: Column | None = None
) -> DataFrame:
    """Crawl targets with the same address and mode, first one kept.

    ``address`` says what counts as the same; the canonical address, which keeps the query, if not given.
    """
    from vakanz.functions.urls import canonical_url

    named = targets.withColumn("_url", canonical_url(F.col(url)) if address is None else address).withColumn(
        "_mode", fold(F.trim(F.coalesce(mode, F.lit("crawl"))))
    )
    return dedupe_first(named, [key, "_url", "_mode"], [F.col(pos)]).drop("_url", "_mode")


def incremental(
    records: DataFrame, sources: DataFrame, *, key: str = "source_id", at: str = "published_at",
    overlap: str = "24 HOURS",
) -> DataFrame:
    """Rows newer than the source's last success minus an overlap; rows without a time stay."""
    last = sources.select(key, "last_success_at")
    fresh = (
        F.col(at).isNull()
        | F.col("last_success_at").isNull()
        | (F.col(at) >= F.col("last_success_at") - F.expr(f"INTERVAL {overlap}"))
    )
    return records.join(last, key, "left").filter(fresh).drop("last_success_at")


def summary_detail_merge(
    summaries: DataFrame, details: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Detail wins over summary field by field; a summary without detail stays."""
    detail = details.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = summaries.join(detail, key, "left")
    return joined.select(
        key, *[F.coalesce(blank_to_null(F.col(f"_d_{f}")), F.col(f)).alias(f) for f in fields]
    )


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All sources in one frame; a column a source lacks is null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def to_posting(records: DataFrame) -> DataFrame:
    """Canonical record to the stored posting columns.

    Values are stored whole, so ``canonical_key`` and the content hash see every change;
    :func:`display_view` cuts them where a page has room for less.
    """
    from vakanz.functions.parse import country_code, location_parts, remote_type
    from vakanz.functions.text import canonical_key, collapse, envelope, language_guess, visible_text

    def m(*names: str) -> Column:
        return F.coalesce(
            *[blank_to_null(F.try_element_at("metadata", F.lit(n))) for n in names]
        )

    df = records.withColumn(
        "description_text", visible_text(F.col("description"), F.col("description_format"))
    )
    raw = envelope(
        F.col("description"), F.col("description_format"), F.to_json("metadata"), F.col("raw")
    )
    df = df.withColumn("raw_envelope", raw)
    places = F.filter(F.transform("locations", lambda x: F.trim(x)), lambda x: x != "")
    postcode, city, state = location_parts(
        F.col("locations"), m("postcode", "postal_code", "plz"), m("city", "ort"),
        m("state", "region", "bundesland"),
    )
    structured = F.to_json(
        F.struct(
            F.col("apply_url"),
            F.col("salary"),
            F.col("updated_at").alias("provider_updated_at"),
            F.col("source").alias("source_key"),
            F.col("metadata").alias("source_metadata"),
            F.sha2("raw_envelope", 256).alias("raw_payload_hash"),
        )
    )
    kept = [c for c in ("source_id",) if c in records.columns]
    posting = df.select(
        *kept,
        F.col("source"),
        F.trim("source_job_id").alias("external_id"),
        F.coalesce("canonical_url", "apply_url").alias("canonical_url"),
        F.trim("title").alias("title"),
        blank_to_null(collapse(F.col("company"))).alias("employer"),
        "description_text",
        F.nullif(F.array_join(places, " | "), F.lit("")).alias("location_text"),
        postcode.alias("postcode"),
        city.alias("city"),
        state.alias("state"),
        country_code(m("country", "land")).alias("country"),
        remote_type(
            m("remote_type", "workplace_type", "workplaceType", "arbeitsmodell"),
            F.col("remote"),
            F.col("locations"),
        ).alias("remote_type"),
        F.nullif(F.array_join("employment_types", ", "), F.lit("")).alias("employment_type"),
        m("contract_type", "contractType", "befristung").alias("contract_type"),
        language_guess(F.col("title"), F.col("description_text"), m("language", "sprache")).alias("language"),
        "published_at",
        F.lit(True).alias("is_active"),
        F.lit("active").alias("availability_status"),
        F.lit("source_sync").alias("availability_check_method"),
        F.lit("present_in_source").alias("availability_reason"),
        F.lit(0).alias("availability_failures"),
        structured.alias("structured_data"),
        "raw_envelope",
    )
    return posting.withColumn(
        "canonical_key",
        canonical_key(F.col("title"), F.col("employer"), F.col("location_text")),
    )


# characters a page has room for
DISPLAY_LENGTHS = {
    "canonical_url": 2000, "title": 500, "employer": 500, "location_text": 1000, "postcode": 20, "city": 200,
    "state": 200, "employment_type": 100, "contract_type": 100, "language": 20,
}


def display_view(postings: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """Postings with long texts cut for display; keys and hashes stay those of the whole values."""
    wanted = DISPLAY_LENGTHS if lengths is None else lengths
    return postings.withColumns({c: F.substring(c, 1, n) for c, n in wanted.items() if c in postings.columns})
