"""Merkle manifest of a grouped table: lag and lead windows hash one level at a time.

Every row is a leaf. In a group (a source) leaves stand in a fixed order; while several nodes remain,
runs of ``fan`` consecutive ones become the hash of their run, the last run may be shorter. What
remains is the group's subroot, and the subroots, in the order of their groups, are joined likewise
to the root. One level is one window: fixed-offset ``lag`` and ``lead`` columns, masked by a node's
slot in its run and by the length of the run, are its siblings; rows in slot 0 hash their parent.
The proof of a row is the list of its siblings from its leaf up to the root, handed down from each
level to the one below.

Rows are numbered by a range sort, and a window covers ``WINDOW_RUNS`` runs
of a group, so a group with a third of all rows is spread over many tasks. Levels shrink
by ``fan``; each is written once and read again.

Defined results: a null field is hashed as ``-``, other fields with their length, so a null and an
empty text differ; null groups are one group and come first, as do null order keys within a group;
rows that agree in their order keys stand in the order of their hashes, so equal rows can't be told
apart and each gets the proof of its own place; a group of one row has its leaf as subroot, a
table of one group its subroot as root; an empty table gives an empty result. Other columns, also
with the names used here, only travel inside ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz.llm.common import stage
from vakanz.operators.common import global_row_number

FAN = 16
WINDOW_RUNS = 32  # runs of a window
SALTS = 32
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """``left`` and ``right``: the other nodes of the run, before and after this one."""
    window = Window.partitionBy("group", F.expr(f"idx div {fan * WINDOW_RUNS}")).orderBy("idx")
    slot = F.col("idx") % fan
    run = F.least(F.lit(fan), F.col("size") - F.col("idx") + slot)
    before = [F.when(slot >= k, F.lag("hash", k).over(window)) for k in range(fan - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("hash", k).over(window)) for k in range(1, fan)]
    # concat_ws leaves out what is masked
    return nodes.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def levels_of(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """group, idx, size, hash of every level; a group ends with the level where one node remains."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 1
    while most > 1:
        rows = with_siblings(levels[-1].select("group", "idx", "size", "hash").filter("size > 1"), fan)
        levels.append(stage(rows.filter(F.col("idx") % fan == 0).select(
            "group", F.expr(f"idx div {fan}").alias("idx"), F.expr(f"(size + {fan - 1}) div {fan}").alias("size"),
            digest(F.col("hash"), F.col("right")).alias("hash"))))
        most = -(-most // fan)
    return levels


def tops_of(levels: list[DataFrame]) -> DataFrame:
    """group, hash of the node that remains in each group."""
    out = None
    for nodes in levels:
        top = nodes.filter("size = 1").select("group", "hash")
        out = top if out is None else out.unionByName(top)
    return out


def with_paths(levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The lowest level with ``path``, its siblings up to the root, and the other columns of ``tops``.

    ``tops`` holds per group the path above its last node.
    """
    extra = [c for c in tops.columns if c not in ("group", "path")]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        found = nodes.filter("size = 1").join(tops, "group")
        if above is not None:
            up = above.select("group", F.col("idx").alias("up"), F.col("path").alias("up_path"), *extra)
            own = F.array(F.struct("left", "right"))
            inner = with_siblings(nodes.filter("size > 1"), fan).withColumn("up", F.expr(f"idx div {fan}")).join(
                up, ["group", "up"]).withColumn("path", F.concat(own, "up_path").cast(PATH))
            found = found.unionByName(inner.select(*found.columns))
        above = found if depth == 0 else stage(found.select("group", "idx", "path", *extra))
    return above


def manifest(
    docs: DataFrame, leaf: Column, group: Column, order: Sequence[Column], row: Column, *, fan: int = FAN
) -> DataFrame:
    """row, leaf, path, subroot, root of every row of ``docs``.

    ``leaf`` hashes a row, ``row`` is the struct that travels with it, ``group`` a string that names
    its subtree, ``order`` the keys of its place there.
    """
    keys = [F.col(f"k{i}").asc_nulls_first() for i in range(len(order))]
    rows = stage(docs.select(row.alias("row"), leaf.alias("hash"), group.cast("string").alias("source"),
                             *[o.alias(f"k{i}") for i, o in enumerate(order)]))
    numbered = global_row_number(rows, [F.col("source").asc_nulls_first(), *keys, F.col("hash")], "spot")
    numbered = numbered.select("row", "hash", "source", field(F.col("source")).alias("group"), "spot")
    groups = stage(numbered.groupBy("group", "source").agg(F.min("spot").alias("first"), F.count("*").alias("size")))
    # a group's size meets its rows by salt: the rows of a large group go to many tasks
    sizes = groups.select("group", "first", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    leaves = stage(numbered.withColumn("salt", (F.col("spot") % SALTS).cast("int")).join(sizes, ["group", "salt"]).select(
        "row", "hash", "group", (F.col("spot") - F.col("first")).alias("idx"), "size"))
    levels = levels_of(leaves, fan)
    subroots = stage(tops_of(levels).join(groups.select("group", "source"), "group"))
    upper = global_row_number(subroots, [F.col("source").asc_nulls_first()], "idx").select(
        F.lit("").alias("group"), "idx", F.lit(subroots.count()).alias("size"), "hash", F.col("group").alias("of"))
    upper = stage(upper)
    upper_levels = levels_of(upper, fan)
    roots = stage(tops_of(upper_levels).select("group", F.array().cast(PATH).alias("path"), F.col("hash").alias("root")))
    tops = with_paths(upper_levels, roots, fan).select(
        F.col("of").alias("group"), "path", F.col("hash").alias("subroot"), "root")
    return with_paths(levels, stage(tops), fan).select("row", F.col("hash").alias("leaf"), "path", "subroot", "root")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered(text: Column, doc_id: Column, every: int = 5) -> Column:
    """``text`` with A-Z in lower case where ``every`` divides the CRC-32 of the id."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(doc_id.cast("string")) % every == 0, low).otherwise(text)
