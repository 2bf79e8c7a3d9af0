"""Quality rules: base counts per text and an n-gram log-likelihood ratio.

Uni- and bigrams of lower-case words are hashed into ``n_cells`` cells. Two multinomials over the
cells are estimated: one of the raw corpus (every document, add-one smoothing), one of the trusted
target (smoothed towards the raw one, so that a small target says little). A document's ratio is the mean of
log(target / raw) over its n-grams, so it does not grow with its length, and every document is kept or
rejected by one threshold. With ``shrink`` the logarithms are bounded per n-gram, so that rare cells
can't decide.

The threshold is made by a rule: a quarter of the trusted documents, by hash, is held out from the target,
and the threshold is the ``clean_loss`` quantile of their ratios (those of at least ``MIN_WORDS`` words).

Corpus counts cover all rows: n-grams are counted per task first, so at most ``n_cells`` rows leave
a task. The table of logarithms has ``n_cells`` entries and is part of the plan.

Trusted documents are given by id, and all of them train the target or set the threshold. Their ids are
broadcast while they are at most ``BROADCAST_IDS``; more of them meet the texts by a shuffle on the id.
Counts of the corpus and verdicts cover every row.

Defined results: null texts and texts without a word have no n-gram, a ratio of 0 and fail the base
rule on words; without any trusted document every ratio is 0; without a held-out one no ratio
rejects a document; an empty table gives an empty result;
repeated rows are judged one by one; other columns are only carried by :func:`keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.text import let
from vakanz.llm.common import SPACE, words_of
from vakanz.operators.common import open_array

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
BROADCAST_IDS = 1_000_000


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hashes(words: Column) -> Column:
    """Hash of every window of WINDOW = 8 words, by doubling: hashes of 2, 4 and 8 words."""

    def doubled(k: int):
        def step(h: Column) -> Column:
            n = F.greatest(F.size(h) - k, F.lit(0))
            return F.zip_with(F.slice(h, 1, n), F.slice(h, k + 1, n), lambda a, b: F.xxhash64(a, b))

        return step

    return let(let(let(F.transform(words, lambda w: F.xxhash64(w)), doubled(1)), doubled(2)), doubled(4))


def covered(hashes: Column, n: int = WINDOW) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Windows sorted by (hash, place) stand next to their equals; the places of those, in order, cover
    n words each less their overlaps.
    """
    spots = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal(spots: Column) -> Column:
        pairs = F.zip_with(spots, F.slice(spots, 2, F.greatest(F.size(spots) - 1, F.lit(0))),
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])

    def spread(equal: Column) -> Column:
        return F.array_sort(F.array_distinct(F.concat(
            F.transform(equal, lambda p: p["a"]["i"]), F.transform(equal, lambda p: p["b"]["i"]))))

    def length(places: Column) -> Column:
        steps = F.zip_with(
            places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(1))),
            lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return let(let(let(spots, equal), spread), length)


def repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more."""
    return let(window_hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measures(text: Column, table: Sequence[float]) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio of a text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
        ratio_of(w, table).alias("ratio")))
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.struct(of_words.alias("w"), symbols.cast("long").alias("n_symbols"),
                    n_dup_lines(text).alias("n_dup_lines"))


def gram_cells(words: Column, n_cells: int) -> Column:
    """Cells of the unigrams and bigrams of lower-case words, in order.

    The array of words is bound once; each word is hashed with the one before it (null before the
    first, and that cell is left out), so no other array is built.
    """
    cell = lambda *w: F.pmod(F.xxhash64(*w), F.lit(n_cells)).cast("int")

    def cells(low: Column) -> Column:
        pairs = F.transform(low, lambda w, i: F.when(i > 0, cell(F.get(low, i - 1), w)))
        return F.concat(F.transform(low, lambda w: cell(w)), F.slice(pairs, 2, F.greatest(F.size(low) - 1, F.lit(0))))

    return let(F.transform(words, F.lower), cells)


def trusted_ids(trusted: DataFrame) -> DataFrame:
    """trusted_id, held_out: every id once; a quarter, by hash, is held out."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("trusted_id")).filter("trusted_id IS NOT NULL").distinct()
    return ids.withColumn("held_out", F.pmod(F.xxhash64(F.lit("held out"), "trusted_id"), F.lit(4)) == 0)


def _joinable(ids: DataFrame, broadcast_ids: int) -> DataFrame:
    return F.broadcast(ids) if ids.limit(broadcast_ids + 1).count() <= broadcast_ids else ids.hint("merge")


def log_ratios(
    docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, n_cells: int, shrink: float, prior_per_cell: float,
) -> list[float]:
    """log(target / raw) of every cell; ``ids`` is the column ``trusted_id`` of the target's documents."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    flagged = texts.join(ids, F.col("id") == F.col("trusted_id"), "left")
    flagged = flagged.select(F.col("trusted_id").isNotNull().alias("good"), words_of(F.col("text")).alias("words"))
    grams = open_array(flagged, ["good"], gram_cells(F.col("words"), n_cells), "cell")
    counts = grams.groupBy("cell").agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
    rows = counts.toArrow()
    raw, good = [0] * n_cells, [0] * n_cells
    for cell, a, b in zip(*(rows[c].to_pylist() for c in ("cell", "raw", "good"))):
        raw[cell], good[cell] = a, b
    all_raw, all_good = sum(raw) + n_cells, sum(good)
    prior = prior_per_cell * n_cells
    share = ((r + 1) / all_raw for r in raw)
    ratio = (math.log((g + prior * p) / ((all_good + prior) * p)) for g, p in zip(good, share))
    return [min(shrink, max(-shrink, x)) for x in ratio]


def ratio_of(words: Column, table: Sequence[float]) -> Column:
    """Mean log ratio of the n-grams of a text; 0 without any."""
    values = F.lit(list(table))
    total = F.aggregate(gram_cells(words, len(table)), F.lit(0.0), lambda s, c: s + F.get(values, c))
    return F.when(F.size(words) > 0, total / F.greatest(F.size(words) * 2 - 1, F.lit(1))).otherwise(F.lit(0.0))


def clean_ratio(docs: DataFrame, ids: DataFrame, table: Sequence[float], quantile: float, *, id_col: str, text_col: str) -> float:
    """The ``quantile`` of the ratios of the documents ``ids``; minus infinity without any."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(ids, F.col("id") == F.col("trusted_id")).select(words_of(F.col("text")).alias("words"))
    held = found.filter(F.size("words") >= MIN_WORDS)
    low = held.select(ratio_of(F.col("words"), table).alias("ratio")).agg(F.percentile_approx("ratio", quantile, 100_000))
    found = low.first()[0]
    return float("-inf") if found is None else found


def judge(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_cells: int = 8192,
    shrink: float = 3.0, prior_per_cell: float = 32.0, clean_loss: float = 0.001, threshold: float | None = None,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """row (the input's columns as a struct), the base counts, ratio and kept, for every row.

    ``threshold`` replaces the one made from the held-out trusted documents.
    """
    ids = trusted_ids(trusted)
    fit, held = (_joinable(ids.filter(part).select("trusted_id"), broadcast_ids) for part in ("NOT held_out", "held_out"))
    table = log_ratios(docs, fit, id_col=id_col, text_col=text_col, n_cells=n_cells, shrink=shrink, prior_per_cell=prior_per_cell)
    if threshold is None:
        threshold = clean_ratio(docs, held, table, clean_loss, id_col=id_col, text_col=text_col)
    found = docs.select(F.struct("*").alias("row"), measures(F.col(text_col), table).alias("m"))
    scored = found.select(
        "row", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.n_dup_lines", "m.w.n_repeat_words", "m.w.ratio")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that pass, with their columns."""
    return judge(docs, trusted, **options).filter("kept").select("row.*")
