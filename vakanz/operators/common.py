"""Building blocks shared by the operators: first/last/latest row, lag, numbering, nesting.

``row_number() = 1`` is planned with a group limit before the shuffle, so a key that holds a
third of all rows still sends only one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz.session import ensure_checkpoint_dir


def open_array(
    df: DataFrame, columns: Sequence[str | Column], array: Column, value: str, pos: str | None = None
) -> DataFrame:
    """One row per non-null element of a computed array, with its 0-based position if named.

    A plain ``explode`` makes the planner add a filter on the array's size, which computes the
    whole array expression a second time below; the outer form with a filter on its result
    computes it once.
    """
    opened = F.posexplode_outer(array).alias(pos, value) if pos else F.explode_outer(array).alias(value)
    return df.select(*columns, opened).filter(F.col(value).isNotNull())


def _top_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def dedupe_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key in the given order."""
    return _top_per_key(df, keys, order, 1).drop("_rank")


def dedupe_last(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """Keep the last row of every key in the given order."""
    return dedupe_first(df, keys, [F.col(c).desc() for c in order])


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Newest row per key; ties fall to the highest value of the last ``newest`` column."""
    return dedupe_first(df, keys, [F.col(c).desc_nulls_last() for c in newest])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of every key with their 1-based ``position``."""
    return _top_per_key(df, keys, order, n).withColumnRenamed("_rank", "position")


# Width of the time buckets that split a long key: narrow enough that one key's bucket fits a
# task, wide enough that most keys have few buckets.
BUCKET = "hour"


def time_bucket(at: str) -> Column:
    return F.date_trunc(BUCKET, F.col(at))


def lag_by_bucket(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, str]
) -> DataFrame:
    """Previous value per key without sorting a whole key in one task.

    Rows are windowed within (key, bucket), where the bucket is a coarse function of the first
    order column such as its hour. The last value of every bucket comes from a partial
    aggregate, and a second window over those few rows hands it to the bucket that follows.
    ``values`` maps a column to the name of its lagged copy.
    """
    spot = F.struct(*order)
    buckets = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = buckets.withColumn("_position", F.row_number().over(inside))
    for column, alias in values.items():
        rows = rows.withColumn(alias, F.lag(column).over(inside))
    carried = F.max_by(F.struct(*values.keys()), spot)
    tails = buckets.groupBy(*keys, "_bucket").agg(carried.alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    tails = tails.select(*keys, "_bucket", F.lag("_tail").over(across).alias("_before"))
    joined = rows.join(tails, [*keys, "_bucket"])
    for column, alias in values.items():
        joined = joined.withColumn(
            alias,
            F.when(F.col("_position") == 1, F.col("_before")[column]).otherwise(F.col(alias)),
        )
    first = (F.col("_position") == 1) & F.col("_before").isNull()
    return joined.withColumn("is_first", first).drop("_bucket", "_position", "_before")


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """0-based position in a total order, computed in parallel.

    A range-partitioned sort is written to the checkpoint folder once, so that a lost executor
    cannot change it; each partition is then numbered on its own and shifted by the number of
    rows before it. Only one count per partition is held together.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranked = df.orderBy(*order).withColumn("_spot", F.monotonically_increasing_id())
    ranked = ranked.checkpoint()
    part = F.shiftright("_spot", 33)
    counts = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_spot", "_part", "_offset")
    )

