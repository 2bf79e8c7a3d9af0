"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.session import ensure_checkpoint_dir

# white space as the contracts of this package define it
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage: what follows never repeats the work before it, and a lost executor costs
    nothing but its own tasks. The folder goes when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    place.getFileSystem(conf).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text in order; an empty array for null and for texts without a word."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(pieces, lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null; only the outer pieces of the split can be empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE)
    empty = (F.element_at(pieces, 1) == "").cast("long")
    last = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("long")
    return F.size(pieces).cast("long") - empty - last


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
