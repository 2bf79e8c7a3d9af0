"""Labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def labelled_rows(labels: DataFrame, id_col: str, label_col: str, kind: int, most: int) -> DataFrame:
    """doc_id of at most ``most`` rows with the label ``kind``, lowest hash first.

    Ids with a null label or with contradicting labels are left out. The limit is taken per task
    before it is taken of all, so no task holds more than ``most`` rows.
    """
    one = labels.groupBy(F.col(id_col).alias("doc_id")).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("high"), F.count_if(F.col(label_col).isNull()).alias("gaps"))
    fine = one.filter((F.col("low") == kind) & (F.col("high") == kind) & (F.col("gaps") == 0) & F.col("doc_id").isNotNull())
    return fine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
