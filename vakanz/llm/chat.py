r"""Chat formatting in budgeted windows with a loss mask.

A turn costs its words plus one. Prefix sums of the costs over a conversation choose the spans: a
turn belongs to span floor(cost before it / (budget / 2)), so spans hold whole turns, follow each
other without gap or overlap, and cost less than half the budget plus their last turn. A window is a
span behind the conversation's first system turn and the latest turns before the span that cost at
most ``history``. Repeated turns stand in the text but never under the mask: every assistant text is
a target once.

A turn is written ``<|turn:ROLE|>TEXT<|end|>\n``. Inside texts backslashes are doubled and a
backslash is put behind the first character of every control string, so no text can close a turn or
open one, and :func:`unescape` gives the text back.

Prefix sums are taken within (conversation, ``BUCKET`` turn numbers) and shifted by bucket sums; a
window is the largest group that is collected, and the budget bounds it but for one turn.

Defined results: null texts and roles count as empty; turns are ordered by turn number (null last),
role and text, and repeated rows are turns of their own; rows with a null conversation id form one
conversation; an empty table gives no window; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz.llm.common import n_words

# Control strings that must not appear in a formatted text as themselves.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUCKET = 64
AFTER_ANGLE = r"\||s>|/s>|<SYS>>|</SYS>>"
AFTER_SQUARE = r"INST\]|/INST\]"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"<(?={AFTER_ANGLE})|\[(?={AFTER_SQUARE})", r"$0\\")


def unescape(text: Column) -> Column:
    plain = F.regexp_replace(text, rf"(?<=<)\\(?={AFTER_ANGLE})|(?<=\[)\\(?={AFTER_SQUARE})", "")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def placed_turns(rows: DataFrame) -> DataFrame:
    """conv, role, text, pos (0-based place), cost, before (cost of the turns before)."""
    rows = rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    inside = Window.partitionBy("conv", "bucket").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner_pos", F.row_number().over(inside) - 1).withColumn(
        "inner_cost", F.coalesce(F.sum("cost").over(earlier), F.lit(0)))
    sums = rows.groupBy("conv", "bucket").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    across = Window.partitionBy("conv").orderBy(F.col("bucket").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sums.select(
        F.col("conv").alias("sc"), F.col("bucket").alias("sb"),
        F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n"), F.coalesce(F.sum("c").over(across), F.lit(0)).alias("c"))
    same = F.col("conv").eqNullSafe(F.col("sc")) & F.col("bucket").eqNullSafe(F.col("sb"))
    return rows.join(shift, same).select(
        "conv", "role", "text", "cost", (F.col("inner_pos") + F.col("n")).alias("pos"),
        (F.col("inner_cost") + F.col("c")).alias("before"))


def format_windows(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", budget: int = 512, history: int = 64,
) -> DataFrame:
    """conv_id, window, n_turns, n_repeated, cost, text, loss_mask (array of start and length in
    code points of ``text``), one row per window."""
    step = budget // 2
    if not 0 <= history <= step:
        raise ValueError("history must fit into half the budget")
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"), (n_words(F.col(text_col)) + 1).alias("cost"))
    turns = placed_turns(rows).withColumn("span", F.floor(F.col("before") / step))
    spans = turns.groupBy("conv", "span").agg(F.min("before").alias("start"), F.min("pos").alias("first"))
    later = F.sequence(F.col("span"), F.greatest("span", F.floor((F.col("before") + history) / step)))
    held = turns.withColumn("window", F.explode(later))
    named = spans.select(F.col("conv").alias("sc"), F.col("span").alias("ss"), "start", "first")
    same = F.col("conv").eqNullSafe(F.col("sc")) & (F.col("window") == F.col("ss"))
    held = held.join(named, same).filter(
        (F.col("span") == F.col("window")) | (F.col("start") - F.col("before") <= history))
    turn = F.struct("pos", "role", "text", "cost", (F.col("span") < F.col("window")).alias("again"))
    windows = held.groupBy("conv", "window").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))  # at most a window
    system = turns.filter("role = 'system'").groupBy(F.col("conv").alias("sc")).agg(
        F.min(F.struct("pos", "role", "text", "cost")).alias("system"))
    windows = windows.join(system, F.col("conv").eqNullSafe(F.col("sc")), "left")
    lead = F.struct(*[F.col(f"system.{c}").alias(c) for c in ("pos", "role", "text", "cost")], F.lit(True).alias("again"))
    apart = F.col("system").isNotNull() & (F.col("system.pos") < F.get("turns", F.lit(0))["pos"])
    windows = windows.withColumn("turns", F.when(apart, F.concat(F.array(lead), "turns")).otherwise(F.col("turns")))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<|turn:"), F.url_encode(t["role"]), F.lit("|>")).alias("head"),
        escape(t["text"]).alias("body"), ((t["role"] == "assistant") & ~t["again"]).alias("target")))
    windows = windows.withColumn("pieces", pieces)
    tail = "<|end|>\n"
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def add(state: Column, p: Column) -> Column:
        head, body = F.length(p["head"]), F.length(p["body"])
        span = F.struct((state["at"] + head).cast("long").alias("start"), body.cast("long").alias("length"))
        return F.struct(
            (state["at"] + head + body + len(tail)).cast("long").alias("at"),
            F.when(p["target"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return windows.select(
        F.col("conv").alias("conv_id"), "window", F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["cost"]).alias("cost"),
        whole.alias("text"), F.aggregate("pieces", first, add)["spans"].alias("loss_mask"))


def read_turns(text: Column, n_repeated: Column) -> Column:
    """Turns of a formatted window that it does not repeat: array of role and text."""
    parts = F.split(text, r"<\|turn:")
    own = F.slice(parts, n_repeated + 2, F.size(parts))
    return F.transform(own, lambda p: F.struct(
        F.url_decode(F.substring_index(p, "|>", 1)).alias("role"),
        unescape(F.substring_index(F.substring(p, F.locate("|>", p) + F.lit(2), F.length(p)), "<|end|>", 1)).alias("text")))


def read_targets(text: Column, loss_mask: Column) -> Column:
    """Texts under the mask, unescaped."""
    return F.transform(loss_mask, lambda m: unescape(F.substring(text, m["start"] + 1, m["length"])))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the windows.

    The hash of a conversation needs its turns together; nothing else here does.
    """
    read = windows.select(
        "conv_id", "window", F.length("text").alias("chars"), read_turns(F.col("text"), F.col("n_repeated")).alias("turns"),
        F.array_join(read_targets(F.col("text"), F.col("loss_mask")), "").alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", written.alias("all"), "loss").alias("part"))
    grouped = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return grouped.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("all"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
