"""Mixing sources to target weights by a low-discrepancy schedule.

Words are the unit. Every source gets a target: the corpus size shared by the sources' weights, no
source above ``max_passes`` times its own size, what it can't take reshared by weight. The mix is a
sequence of slots of ``block_words`` words. Slot j has the point frac((j + 1/2) * golden ratio); the
points fall into the sources' shares of [0, 1), so every stretch of the mix holds each source in
proportion. The slots of a source are ranked; rank k takes block k of the source, whose documents
stand in a pseudo-random order and are cut into blocks of equal size. Past the last block a source
starts again, until its target is reached, so no word is taken more than ``max_passes`` times.

Everything is in columns. No task holds a source: documents are numbered in
``buckets`` hash buckets per source and slots in chunks, and only bucket and chunk sums are added up
per source.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of
its own, after all others; an empty table gives an empty mix; rows repeated in the input are
separate documents; other columns are not read. A document's place depends on its id and its text,
so rows that share an id or have none are spread like all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz.llm.common import n_words, stage

CHUNK = 1 << 16  # slots ranked together
CELLS = 1 << 12  # cells of [0, 1) by which a point finds its source


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, buckets: int) -> DataFrame:
    """doc_id, source, size and the place ``start`` of every document in its source's order."""
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit("mix"), F.col(id_col), F.xxhash64(text_col)).alias("spot")))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("spot", 40) % buckets).withColumn(
        "row_no", F.monotonically_increasing_id())
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "size", "row_no").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(offsets.withColumnRenamed("source", "s"), (F.col("source").eqNullSafe(F.col("s")))
                       & (placed["bucket"] == offsets["bucket"])).select(
        "doc_id", "source", "size", (F.col("offset") + F.col("inner")).alias("start"))


def targets(sizes: DataFrame, weights: Sequence[float], max_passes: float, total: float = 1.0) -> DataFrame:
    """source, source_size, weight, target: one row per source of ``source, source_size``.

    Weights repeat in the order of the source names. Sources in the order of cap / weight stop at
    their caps until the rest can share what is left by weight; every row here is one source.
    """
    # UTF-8 bytes order like code points
    names = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(names) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("weight", F.get(w, rank % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    words = F.sum("source_size").over(whole) * F.lit(float(total))
    left = words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # what a unit of weight gets if every source before this one stops at its cap
    level = left / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    free = F.col("cap") > F.col("level") * F.col("weight")
    first = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)
    target = F.least("cap", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def slots(shares: DataFrame, n_slots: int, block_words: int) -> DataFrame:
    """slot, source, source_size, target, rank: the schedule. ``shares`` is :func:`targets`, staged.

    The points give a source its share of the slots but for a few. Slots beyond its target take
    nothing; what it lacks comes in closing slots after the last point, at most a few per source.
    """
    spark = shares.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("target").over(order)
    all_ = F.sum("target").over(Window.partitionBy())
    spans = shares.filter("target > 0").select(
        "source", "source_size", "target", ((upto - F.col("target")) / all_).alias("low"),
        F.when(upto == all_, F.lit(1.0)).otherwise(upto / all_).alias("high"))
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    ratio = F.lit((5**0.5 - 1) / 2)
    points = spark.range(n_slots).withColumnRenamed("id", "slot")
    points = points.withColumn("point", (F.col("slot") + 0.5) * ratio)
    points = points.withColumn("point", F.col("point") - F.floor("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    hit = points.join(spans, "cell").filter("point >= low AND point < high")
    hit = hit.select("slot", "source", "source_size", "target", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("inner", inside)
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select(
        "slot", "source", "source_size", "target", (F.col("offset") + F.col("inner")).alias("rank"))
    had = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("had"))
    short = shares.join(had, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0)))
    needed = F.ceil(F.round("target") / block_words)
    short = short.filter(needed > F.col("had")).select(
        "source", "source_size", "target", F.explode(F.sequence(F.col("had"), needed - 1)).alias("rank"))
    last = F.row_number().over(Window.orderBy("rank", F.col("source").asc_nulls_last())) - 1  # a few rows per source
    closing = short.select((F.lit(n_slots) + last).cast("long").alias("slot"), "source", "source_size", "target", "rank")
    return ranked.unionByName(closing)


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), max_passes: int = 3, block_words: int = 256, buckets: int = 1024,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The schedule joined with the documents: ``(parts, documents, targets)``.

    ``parts`` has slot, doc_id, source, start, from_word, n_words: the words of a document that a
    slot takes. ``documents`` has doc_id, source, size, start for every row; ``targets`` a row per source.
    """
    placed = stage(sized(docs, id_col, text_col, source_col, buckets))
    goal = stage(targets(
        placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_passes))
    wanted = goal.agg(F.sum("target")).first()[0] or 0.0
    n_slots = -(-int(wanted) // block_words)
    plan = slots(goal, n_slots, block_words)
    # a rank is a stretch of the source's endless repetition; it may run past the end of the source
    begin, end = F.col("rank") * block_words, F.round("target").cast("long")
    plan = plan.filter(begin < end).withColumn("at", begin).withColumn("to", F.least(end, begin + block_words))
    passes = F.sequence(F.floor(F.col("at") / F.col("source_size")), F.floor((F.col("to") - 1) / F.col("source_size")))
    plan = plan.withColumn("pass", F.explode(passes))
    shift = F.col("pass") * F.col("source_size")
    plan = plan.withColumn("at", F.greatest(F.col("at") - shift, F.lit(0))).withColumn(
        "to", F.least(F.col("to") - shift, F.col("source_size")))
    blocks = F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("to") - 1) / block_words))
    plan = plan.select("slot", F.col("source").alias("s"), "at", "to", F.explode(blocks).alias("b"))
    own = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(own))
    both = pieces.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    low = F.greatest("start", "at", F.col("b") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("to"), (F.col("b") + 1) * block_words)
    parts = both.select("slot", "doc_id", "source", "start", (low - F.col("start")).alias("from_word"),
                        (high - low).alias("n_words")).filter("n_words > 0")
    return parts, placed, goal


def taken_words(parts: DataFrame, placed: DataFrame, goal: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, start: one row per document row."""
    got = parts.groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("n_words").alias("taken"))
    full = placed.filter("size > 0").join(
        got, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")), "left")
    rows = full.select("doc_id", "source", "size", "start", "taken").unionByName(
        placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    named = goal.select(F.col("source").alias("g"), "source_size", "target")
    return rows.join(named, F.col("source").eqNullSafe(F.col("g"))).select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "start")


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options,
) -> DataFrame:
    """The mix as rows of ``docs``: a document once per pass that takes it, always whole.

    Where a source's target ends inside a document, that pass takes it if the source then is nearer to
    its target than without it, so a source misses its target by half a document at most. Rows of
    size 0 are in no mix. Rows that agree in id, source and size get their passes in the order of
    their texts' hashes; rows that agree in the text as well can't be told apart.
    """
    parts, placed, goal = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken_words(parts, placed, goal).filter("taken > 0")
    passes = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    taken = taken.select("doc_id", "source", "size", "start", passes.alias("passes"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("start")
    every = placed.filter("size > 0").select("doc_id", "source", "size", "start")
    copies = every.withColumn("copy", F.row_number().over(same)).alias("c")
    taken = stage(copies.join(taken.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")) & (
        F.col("c.start") == F.col("t.start")), "left").select("c.doc_id", "c.source", "c.size", "copy", "passes"))
    repeated = not taken.filter("copy > 1").isEmpty()
    taken = taken.filter("passes > 0")
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"),
        n_words(F.col(text_col)).alias("words"))
    key = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("src").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    if repeated:
        again = Window.partitionBy("id", "src", "words").orderBy(F.xxhash64(f"row.{text_col}"))
        rows = rows.withColumn("nth", F.row_number().over(again))
        key = key & (F.col("nth") == F.col("copy"))
    got = rows.join(taken, key).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    return got.select("row.*")
