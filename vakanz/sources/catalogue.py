"""Source catalogue registration and the work list of the fetch job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.text import ordered_distinct
from vakanz.operators.common import global_row_number, open_array

STATIC = ("name", "kind", "is_official", "free_api")


def merge_maps(left: Column, right: Column) -> Column:
    """Right-wins merge of two maps, independent of the session's duplicate-key policy."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def catalogue_merge(stored: DataFrame, defaults: DataFrame, key: str = "slug") -> DataFrame:
    """Register missing sources and refresh static columns of known ones.

    The user's ``enabled`` flag and ``base_url`` are kept; metadata is merged, defaults win.
    A stored source that is not in the catalogue stays as it is.
    """
    columns = [*STATIC, "base_url", "enabled", "metadata"]
    old = stored.select(key, F.struct(*columns).alias("o"))
    new = defaults.select(key, F.struct(*columns).alias("d"))
    joined = old.join(new, key, "full_outer")
    return joined.select(
        key,
        *[F.coalesce(f"d.{c}", f"o.{c}").alias(c) for c in STATIC],
        F.coalesce("o.base_url", "d.base_url").alias("base_url"),
        F.coalesce("o.enabled", "d.enabled").alias("enabled"),
        merge_maps(F.col("o.metadata"), F.col("d.metadata")).alias("metadata"),
        F.when(F.col("o").isNull(), "inserted")
        .when(F.col("d").isNull(), "kept")
        .otherwise("refreshed")
        .alias("action"),
    )


def query_plan(
    preferences: DataFrame,
    key: str,
    *,
    primary: str = "primary_role_terms",
    additional: str = "additional_role_terms",
    locations: str = "preferred_states",
    remote: str = "include_germany_remote",
    default_location: str = "Baden-Württemberg",
    remote_location: str = "Deutschland",
    terms_per_query: int | None = None,
) -> DataFrame:
    """Search work list of each preference row: terms by locations, plus a remote query.

    ``terms_per_query`` packs that many quoted terms into one query joined with OR. The lists
    of one row are opened inside the row; no rows are paired across the table.
    """
    terms = ordered_distinct(F.concat(F.col(primary), F.col(additional)))
    if terms_per_query:
        n = terms_per_query
        quoted = F.transform(
            terms, lambda t: F.concat(F.lit('"'), F.trim(F.translate(t, '"', " ")), F.lit('"'))
        )
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(quoted)), F.lit(n))
        terms = F.transform(starts, lambda s: F.array_join(F.slice(quoted, s, n), " OR "))
    places = F.array_distinct(
        F.filter(F.transform(locations, lambda x: F.trim(x)), lambda x: x != "")
    )
    places = F.when(F.size(places) > 0, places).otherwise(F.array(F.lit(default_location)))
    wanted = F.transform(places, lambda p: F.struct(p.alias("location"), F.lit(False).alias("remote_query")))
    far = F.array(F.struct(F.lit(remote_location).alias("location"), F.lit(True).alias("remote_query")))
    wanted = F.when(F.col(remote), F.concat(wanted, far)).otherwise(wanted)
    opened = open_array(preferences, [key, wanted.alias("_wanted")], terms, "text", "term_pos")
    return open_array(
        opened, [key, "term_pos", "text"], F.col("_wanted"), "_w", "location_pos"
    ).select(key, "term_pos", "text", "location_pos", "_w.location", "_w.remote_query")


def batch_assign(
    pending: DataFrame, order: Sequence[Column], size: int = 20, limit: int | None = 50
) -> DataFrame:
    """Number the pending rows in parallel and cut them into batches of ``size``.

    ``limit`` is the size of a cycle: rows numbered beyond it wait for the next one.
    """
    numbered = global_row_number(pending, order, "row_no")
    if limit is not None:
        numbered = numbered.filter(F.col("row_no") < limit)
    return numbered.withColumn("batch_no", F.floor(F.col("row_no") / size).cast("int"))


def enrich(df: DataFrame, fn, schema: str, batch_size: int = 20) -> DataFrame:
    """Send rows in batches of ``batch_size`` to an external function (pandas in, pandas out)."""

    def run(frames):
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                yield fn(frame.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)
