"""Landing, mapping, work lists and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz.plans.registry import query
from vakanz.plans.views import POSTINGS, ctes, postings, table
from vakanz.sources import catalogue, landing
from vakanz.sources import specs  # noqa: F401  (registers the providers)


def payloads(spark, d):
    """Every document as one landed page of two items, the second without a title for some."""
    docs = table(spark, d, "documents")
    items = F.array(
        F.struct(
            F.col("doc_id").alias("id"),
            F.concat(F.lit(" Title "), F.col("doc_id").cast("string")).alias("text"),
            F.col("text").alias("descriptionPlain"),
            F.struct(
                F.array("source", "lang", "source").alias("allLocations"),
                F.lit("Full-time").alias("commitment"),
            ).alias("categories"),
            F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id").cast("string")).alias("hostedUrl"),
            (F.lit(1704067200000) + F.col("doc_id") * 1000).alias("createdAt"),
            F.when(F.col("doc_id") % 3 == 0, "remote").when(F.col("doc_id") % 3 == 1, "on-site").alias("workplaceType"),
            F.when(
                F.col("doc_id") % 2 == 0,
                F.struct(F.col("n_chars").alias("min"), (F.col("n_chars") + 5).alias("max"), F.lit("EUR").alias("currency")),
            ).alias("salaryRange"),
        ),
        F.struct(
            (-F.col("doc_id") - 1).alias("id"),
            F.when(F.col("doc_id") % 4 != 0, "second").alias("text"),
            F.lit(None).cast("string").alias("descriptionPlain"),
            F.lit(None).cast("struct<allLocations:array<string>,commitment:string>").alias("categories"),
            F.lit(None).cast("string").alias("hostedUrl"),
            F.lit(None).cast("bigint").alias("createdAt"),
            F.lit(None).cast("string").alias("workplaceType"),
            F.lit(None).cast("struct<min:bigint,max:bigint,currency:string>").alias("salaryRange"),
        ),
    )
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(items)).otherwise(
        F.concat(F.lit('{"data":'), F.to_json(items), F.lit("}"))
    )
    return docs.select("doc_id", payload.alias("payload"))


@query(
    "landing_explode",
    "SELECT doc_id, 0 AS item_pos, CAST(doc_id AS VARCHAR) AS item_id FROM documents UNION ALL SELECT doc_id, 1, CAST(-doc_id - 1 AS VARCHAR) FROM documents",
)
def landing_explode(spark, d):
    rows = landing.explode_items(payloads(spark, d), landing.SPECS["lever"])
    return rows.select("doc_id", "item_pos", landing.get(F.col("item"), "id").alias("item_id"))


@query(
    "normalize_payload",
    """SELECT CAST(doc_id AS VARCHAR) AS source_job_id, concat('Title ', CAST(doc_id AS VARCHAR)) AS title, concat(source, '|', lang) AS locations,
       sha256(trim(text)) AS description_hash, 'text' AS description_format, concat('https://jobs.example.com/', CAST(doc_id AS VARCHAR)) AS apply_url,
       1704067200 + doc_id AS published, 'Full-time' AS employment_types, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS remote,
       CASE WHEN doc_id % 2 = 0 THEN concat(CAST(n_chars AS VARCHAR), '–', CAST(n_chars + 5 AS VARCHAR), ' EUR') END AS salary FROM documents
       UNION ALL SELECT CAST(-doc_id - 1 AS VARCHAR), 'second', '', NULL, 'html', NULL, NULL, '', NULL, NULL FROM documents WHERE doc_id % 4 <> 0""",
)
def normalize_payload(spark, d):
    valid, _ = landing.normalize_payload(payloads(spark, d), landing.SPECS["lever"])
    return valid.select(
        "source_job_id", "title", F.array_join("locations", "|").alias("locations"),
        F.sha2("description", 256).alias("description_hash"), "description_format", "apply_url",
        F.unix_seconds("published_at").alias("published"),
        F.array_join("employment_types", "|").alias("employment_types"), "remote", "salary",
    )


@query("reject_invalid", "SELECT CAST(-doc_id - 1 AS VARCHAR) AS source_job_id FROM documents WHERE doc_id % 4 = 0")
def reject_invalid(spark, d):
    _, rejected = landing.normalize_payload(payloads(spark, d), landing.SPECS["lever"])
    return rejected.select("source_job_id")


@query(
    "ingest_postings",
    """SELECT CAST(doc_id AS VARCHAR) AS external_id, concat('Title ', CAST(doc_id AS VARCHAR)) AS title, concat(source, ' | ', lang) AS location_text,
       source AS city, 'Full-time' AS employment_type, CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' END AS remote_type, 'DE' AS country FROM documents
       UNION ALL SELECT CAST(-doc_id - 1 AS VARCHAR), 'second', NULL, NULL, NULL, NULL, 'DE' FROM documents WHERE doc_id % 4 <> 0""",
)
def ingest_postings(spark, d):
    """Landed payload to stored posting columns in one plan."""
    valid, _ = landing.normalize_payload(payloads(spark, d), landing.SPECS["lever"])
    return landing.to_posting(valid).select(
        "external_id", "title", "location_text", "city", "employment_type", "remote_type", "country"
    )


@query(
    "payload_quarantine",
    """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'no list' ELSE 'unreadable' END AS reason
       FROM documents WHERE doc_id % 5 IN (1, 2, 3)""",
)
def payload_quarantine(spark, d):
    """Cut, foreign and missing payloads are kept with a reason; whole ones give no row."""
    form = F.col("doc_id") % 5
    whole = payloads(spark, d)
    broken = whole.withColumn("payload", F.when(form == 1, F.expr("substring(payload, 1, length(payload) - 3)"))
                              .when(form == 2, F.concat(F.lit('{"error":'), F.to_json(F.struct("doc_id")), F.lit("}")))
                              .when(form != 3, F.col("payload")))
    return landing.quarantine(broken, landing.SPECS["lever"]).select("doc_id", "reason")


@query(
    "namespaced_ids",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat(source, 60) ELSE source END AS board, CASE WHEN doc_id % 2 = 0 THEN repeat(CAST(doc_id AS VARCHAR), 30) ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)
       SELECT doc_id, CASE WHEN length(concat(board, ':', id)) > 300 THEN concat(substring(board, 1, 200), ':', sha256(concat(board, ':', id))) ELSE concat(board, ':', id) END AS namespaced FROM r""",
)
def namespaced_ids(spark, d):
    k = F.col("doc_id")
    board = F.when(k % 3 == 0, F.repeat("source", F.lit(60))).otherwise(F.col("source"))
    ident = k.cast("string")
    ident = F.when(k % 2 == 0, F.repeat(ident, F.lit(30))).otherwise(ident)
    return table(spark, d, "documents").select("doc_id", landing.namespaced_id(board, ident).alias("namespaced"))


@query(
    "board_counters",
    "SELECT source AS board, count(*) FILTER (WHERE doc_id % 9 <> 0) AS records_emitted, count(*) FILTER (WHERE doc_id % 9 = 0) AS target_errors FROM documents GROUP BY source",
)
def board_counters(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("source").alias("board"), F.when(F.col("doc_id") % 9 == 0, "boom").alias("error")
    )
    return landing.board_counters(rows)


@query(
    "target_config_dedupe",
    """SELECT c_custkey, 0 AS pos, c_mktsegment AS identifier, NULL AS company FROM customer
       UNION ALL SELECT c_custkey, 2, concat('b', CAST(c_nationkey AS VARCHAR)), c_name FROM customer""",
)
def target_config_dedupe(spark, d):
    config = F.concat(
        F.lit('["'), "c_mktsegment", F.lit('",{"id":"'), F.lower("c_mktsegment"),
        F.lit('"},{"board":"b'), F.col("c_nationkey").cast("string"), F.lit('","company":"'), "c_name",
        F.lit('"},{"company":"none"}," "]'),
    )
    rows = table(spark, d, "customer").select("c_custkey", config.alias("config"))
    return landing.parse_boards(rows, "c_custkey", "config")


@query(
    "incremental_overlap",
    ctes(POSTINGS)
    + """, s AS (SELECT DISTINCT source_id, CASE WHEN source_id % 4 <> 0 THEN TIMESTAMP '2024-01-10' + to_days(source_id) END AS last_success_at FROM postings),
      r AS (SELECT job_id, source_id, CASE WHEN job_id % 8 <> 0 THEN published_at END AS published_at FROM postings)
      SELECT r.job_id FROM r JOIN s ON s.source_id = r.source_id WHERE published_at IS NULL OR last_success_at IS NULL OR published_at >= last_success_at - INTERVAL 24 HOUR""",
)
def incremental_overlap(spark, d):
    p = postings(spark, d)
    sources = p.select("source_id").distinct()
    base = F.expr("timestampadd(DAY, source_id, TIMESTAMP_NTZ'2024-01-10 00:00:00')")
    sources = sources.withColumn("last_success_at", F.when(F.col("source_id") % 4 != 0, base))
    rows = p.select(
        "job_id", "source_id", F.when(F.col("job_id") % 8 != 0, F.col("published_at")).alias("published_at")
    )
    return landing.incremental(rows, sources).select("job_id")


@query(
    "summary_detail_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'detail' ELSE o_orderstatus END AS title, CASE WHEN o_orderkey % 6 = 0 THEN 'full' ELSE o_orderpriority END AS body FROM orders""",
)
def summary_detail_merge(spark, d):
    o = table(spark, d, "orders")
    summaries = o.select("o_orderkey", F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("body"))
    details = o.filter("o_orderkey % 3 = 0").select(
        "o_orderkey", F.lit("detail").alias("title"),
        F.when(F.col("o_orderkey") % 6 == 0, "full").otherwise(" ").alias("body"),
    )
    return landing.summary_detail_merge(summaries, details, "o_orderkey", ["title", "body"])


@query(
    "union_sources",
    """SELECT 'documents' AS origin, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'pages', page_id, NULL, url FROM pages""",
)
def union_sources(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    pages = table(spark, d, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), "url")
    return landing.union_sources([docs, pages])


@query(
    "catalogue_merge",
    """WITH o AS (SELECT n_name AS slug, n_nationkey AS k FROM nation WHERE n_nationkey % 3 <> 0), n AS (SELECT n_name AS slug, n_nationkey AS k FROM nation WHERE n_nationkey % 4 <> 0)
       SELECT coalesce(o.slug, n.slug) AS slug, CASE WHEN n.slug IS NOT NULL THEN concat('new ', n.k) ELSE concat('old ', o.k) END AS name,
         CASE WHEN o.slug IS NOT NULL AND o.k % 2 = 0 THEN 'https://own' WHEN n.slug IS NOT NULL THEN 'https://default' END AS base_url,
         CASE WHEN o.slug IS NOT NULL THEN o.k % 5 = 0 ELSE true END AS enabled,
         concat_ws('|', CASE WHEN o.slug IS NOT NULL THEN 'user=1' END, CASE WHEN n.slug IS NOT NULL THEN 'v=2' ELSE 'v=1' END) AS metadata,
         CASE WHEN o.slug IS NULL THEN 'inserted' WHEN n.slug IS NULL THEN 'kept' ELSE 'refreshed' END AS action
       FROM o FULL OUTER JOIN n ON n.slug = o.slug""",
)
def catalogue_merge(spark, d):
    nation, k = table(spark, d, "nation"), F.col("n_nationkey")

    def rows(df, prefix, base, enabled, *pairs):
        return df.select(
            F.col("n_name").alias("slug"),
            F.concat(F.lit(prefix), k.cast("string")).alias("name"),
            F.lit("api").alias("kind"), F.lit(True).alias("is_official"), F.lit(True).alias("free_api"),
            base.alias("base_url"), enabled.alias("enabled"),
            F.create_map(*[F.lit(x) for x in pairs]).alias("metadata"),
        )

    stored = rows(nation.filter("n_nationkey % 3 <> 0"), "old ", F.when(k % 2 == 0, "https://own"),
                  k % 5 == 0, "user", "1", "v", "1")
    defaults = rows(nation.filter("n_nationkey % 4 <> 0"), "new ", F.lit("https://default"), F.lit(True), "v", "2")
    merged = catalogue.catalogue_merge(stored, defaults)
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"
    )
    return merged.select("slug", "name", "base_url", "enabled", shown.alias("metadata"), "action")


@query(
    "query_plan",
    """WITH t AS (SELECT c_custkey, 0 AS term_pos, c_mktsegment AS text FROM customer UNION ALL SELECT c_custkey, 1, 'Referent' FROM customer),
       l AS (SELECT c_custkey, 0 AS location_pos, CASE WHEN c_custkey % 2 = 0 THEN 'Bayern' ELSE 'Baden-Württemberg' END AS location, false AS remote_query FROM customer
         UNION ALL SELECT c_custkey, 1, 'Berlin', false FROM customer WHERE c_custkey % 2 = 0
         UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END, 'Deutschland', true FROM customer WHERE c_custkey % 3 = 0)
       SELECT t.c_custkey, term_pos, text, location_pos, location, remote_query FROM t JOIN l ON l.c_custkey = t.c_custkey""",
)
def query_plan(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.array("c_mktsegment", F.lower("c_mktsegment")).alias("primary_role_terms"),
        F.array(F.lit("Referent"), F.lit(" ")).alias("additional_role_terms"),
        F.when(k % 2 == 0, F.array(F.lit("Bayern "), F.lit("Berlin"), F.lit("Bayern")))
        .otherwise(F.array().cast("array<string>")).alias("preferred_states"),
        (k % 3 == 0).alias("include_germany_remote"),
    )
    return catalogue.query_plan(rows, "c_custkey")


@query(
    "query_packs",
    """SELECT c_custkey, 0 AS term_pos, concat('"', c_mktsegment, '" OR "T1" OR "T2"') AS text FROM customer UNION ALL SELECT c_custkey, 1, '"T3" OR "T4"' FROM customer""",
)
def query_packs(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.array("c_mktsegment").alias("primary_role_terms"),
        F.array(*[F.lit(f"T{i}") for i in (1, 2, 3, 4)]).alias("additional_role_terms"),
        F.array(F.lit("Bayern")).alias("preferred_states"), F.lit(False).alias("include_germany_remote"),
    )
    packed = catalogue.query_plan(rows, "c_custkey", terms_per_query=3)
    return packed.select("c_custkey", "term_pos", "text")


