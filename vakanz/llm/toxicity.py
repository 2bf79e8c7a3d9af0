"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one for ordinary and one for toxic text. Both begin with the
same content, trained on windows of both kinds, so that what every text holds costs the same behind
either; each ends with its own pieces, the words and beginnings of words that tell its kind. Pieces are
ranked by the signed root of their log-likelihood ratio, so a few wrong labels or quotations lower
a piece's rank and don't strike it out, and a piece that ordinary texts never hold ranks highest. A window is compressed behind both; the bytes
that the toxic dictionary saves are its distance. A document's distances (the two largest, mean of the
upper tenth, of the upper quarter, of all, how many windows reach each of ``THRESHOLDS``, and how many
there are) go through a logistic calibration fitted on labelled documents that trained no dictionary.

Training works on a bounded sample: at most ``max_toxic`` and ``max_ordinary`` labelled texts by hash
of their id, and at most ``max_bytes`` of text of each kind. If the texts of a kind are longer, all
of them stay and the long ones give as many whole windows, from all over the text, as an equal share
allows, so no kind and no source is left out. ``max_windows`` bounds the windows of each kind (drawn at random
from the sample) that the dictionary trainer reads. The labelled texts are written once and read from there. Calibration and scoring read every window of every text.

Defined results: null and empty texts have one empty window and get the score of distance 0; without
labelled texts with words of both kinds every score is 0 and a warning is logged, as is one if no piece tells
toxic texts (every document then has about the same score); repeated rows are scored one by one; labels that
are null or contradict each other are left out; an empty table gives an empty result; only the id
and the text are read.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import stage
from vakanz.llm.labelled import labelled_rows

CELL_BITS = 22
PIECE = (5, 12)  # bytes of a word's beginning, the space before it included
THRESHOLDS = (2, 3, 4, 5)  # bytes
RIDGE = 3.0  # rows that hold a calibration weight at 0; few labels must not fit their noise
LEVEL = 3
LOG = logging.getLogger(__name__)


def plain(text: str | None) -> bytes:
    """Lower case, one space between words and at both ends."""
    words = (text or "").lower().split()
    return f" {' '.join(words)} ".encode() if words else b""


def windows(text: bytes, size: int) -> list[bytes]:
    """Cuts of whole words, each of ``size`` bytes or little more; one empty window without a word."""
    out, at = [], 0
    while at < len(text) - 1:
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end + 1
        out.append(text[at:end])
        at = end
    return out or [b""]


def water_level(sizes: list[int], room: int) -> int:
    """Largest bound for one size so that all sizes under it fit into ``room``."""
    for i, size in enumerate(sorted(sizes)):
        share = room // (len(sizes) - i)
        if size > share:
            return share
        room -= size
    return max(sizes, default=0)


def bounded(text: bytes, room: int, size: int) -> bytes:
    """A text that fits, else whole windows from all over it, in their order; a window that alone is
    larger than ``room`` is passed over."""
    if len(text) <= room:
        return text
    cuts = windows(text, size)
    kept, left = [], room
    for i in np.argsort(np.arange(len(cuts)) * 0.6180339887498949 % 1, kind="stable"):
        if len(cuts[i]) <= left:
            kept.append(i)
            left -= len(cuts[i])
        if left < size:
            break
    return b"".join(cuts[i] for i in sorted(kept))


def pieces(text: bytes) -> set[bytes]:
    """The different words of a text, between spaces, and their beginnings."""
    out = set()
    for word in set(text.split()):
        word = b" " + word + b" "
        out.add(word)
        out.update(word[:n] for n in range(PIECE[0], min(len(word), PIECE[1])))
    return out


def _cell(piece: bytes) -> int:
    return zlib.crc32(piece) & (1 << CELL_BITS) - 1


def _cells(found: set[bytes]) -> np.ndarray:
    return np.fromiter({_cell(g) for g in found}, dtype=np.int64)


def _term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))


def log_odds(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Signed root of the log-likelihood ratio of every cell of pieces between toxic and ordinary documents.

    It is about in standard errors, also where a kind holds a piece in few documents or in none: there the
    error of log-odds, which the rarer count sets, would hold the best pieces under those that a group of near
    copies shares. What the best of so many pieces would reach by chance counts as 0.
    """
    counts = np.zeros((2, 1 << CELL_BITS), dtype=np.float32)
    for kind, texts in enumerate((toxic, ordinary)):
        for text in texts:
            counts[kind][_cells(pieces(text))] += 1
    n, m = len(toxic), len(ordinary)
    known = np.flatnonzero(counts[0] + counts[1] > 1)
    t, o = counts[0, known].astype(float), counts[1, known].astype(float)
    with_it, without = (t + o) / (n + m), (n + m - t - o) / (n + m)
    ratio = _term(t, n * with_it) + _term(o, m * with_it) + _term(n - t, n * without) + _term(m - o, m * without)
    rank = np.sqrt(2 * np.maximum(ratio, 0))
    rank[rank < np.sqrt(2 * np.log(max(1, len(known))))] = 0
    scores = np.zeros(1 << CELL_BITS, dtype=np.float32)
    scores[known] = np.sign(t * m - o * n) * rank
    return scores


def telling_pieces(texts: list[bytes], scores: np.ndarray, least_z: float, size: int) -> list[bytes]:
    """The pieces of highest rank, ``size`` bytes of them at most, the best one first; none is part of one before it.

    Of pieces that share a cell, the one that most texts hold made its rank; the others are none.
    """
    seen = Counter()
    for text in texts:
        for g in pieces(text):
            if scores[_cell(g)] > least_z:
                seen[g] += 1
    held = {}
    for g in seen:
        cell = _cell(g)
        held[cell] = max(held.get(cell, (0, b"")), (seen[g], g))
    ranked = {g: scores[cell] for cell, (_, g) in held.items()}
    kept, joined = [], b""
    for g in sorted(ranked, key=lambda g: (-ranked[g], -len(g), g)):
        if g not in joined and len(joined) + len(g) <= size:
            kept.append(g)
            joined += g
    return kept


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained content; too few samples for the trainer stand for themselves."""
    try:
        return zs.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes):
    shared = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zs.ZstdCompressor(
        level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False).compress


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    window: int
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    def features(self, text: str | None) -> list[float]:
        cuts = windows(plain(text), self.window)
        a, b = self.compressors
        saved = sorted((len(a(w)) - len(b(w)) for w in cuts), reverse=True)
        n = len(saved)
        tenth, quarter = max(1, n // 10), max(1, n // 4)
        reach = [np.log1p(sum(x >= k for x in saved)) for k in THRESHOLDS]
        return [saved[0], saved[min(1, n - 1)], sum(saved[:tenth]) / tenth, sum(saved[:quarter]) / quarter, sum(saved) / n,
                np.log(n), *reach]

    @property
    def compressors(self):
        if not hasattr(self, "_made"):
            self._made = compressor(self.ordinary), compressor(self.toxic)
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        z = np.hstack([(x - self.centre) / self.scale, np.ones((len(x), 1))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """Logistic regression by Newton steps; rows are weighted to ``share`` of toxic ones."""
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - self.centre) / self.scale, np.ones((len(x), 1))])
        w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        beta, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * RIDGE
        ridge[-1, -1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = (z * (w * p * (1 - p))[:, None]).T @ z + ridge
            beta = beta + np.linalg.solve(step, z.T @ (w * (y - p)) - ridge @ beta)
        self.weights = beta


def train(ordinary: list[bytes], toxic: list[bytes], window: int, shared_size: int, own_size: int, least_z: float,
          max_windows: int) -> Model:
    """Dictionaries of plain texts of both kinds."""
    odds = log_odds(toxic, ordinary)
    own = [telling_pieces(texts, z, least_z, own_size) for texts, z in ((ordinary, -odds), (toxic, odds))]
    if not own[1]:
        LOG.warning("no piece tells the %d toxic texts from the %d ordinary ones", len(toxic), len(ordinary))
    order, cuts = np.random.default_rng(7), []
    for texts in (ordinary, toxic):
        found = [w for t in texts for w in windows(t, window)]
        found = [found[i] for i in order.permutation(len(found))[:max_windows]]
        # what tells a kind belongs to its own dictionary alone
        cuts += [w for w in found if not any(g in w for g in own[0] + own[1])]
    shared = train_dictionary(cuts, shared_size)
    # the best piece last, where it costs least; the shared content is equally far from the end of both, so it costs the same
    ends = [b"".join(reversed(found)) for found in own]
    return Model(*[shared + end.rjust(max(map(len, ends)), b"\0") for end in ends], window)


def calibrates(doc_id) -> bool:
    """A quarter of the labelled documents, by hash, trains no dictionary."""
    return zlib.crc32(f"calibrate {doc_id}".encode()) % 4 == 0


def _plain_cuts(rooms, window):
    def cut(batches):
        for batch in batches:
            ids, digests, kinds, texts = batch.columns
            cuts = [bounded(plain(t), rooms[k], window) for t, k in zip(texts.to_pylist(), kinds.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, digests, kinds, pa.array(cuts, pa.binary())], ["doc_id", "digest", "kind", "cut"])

    return cut


def _features(sent):
    def features(batches):
        model = sent.value
        for batch in batches:
            ids, digests, kinds, texts = batch.columns
            x = pa.array([model.features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, digests, kinds, x], ["doc_id", "digest", "kind", "x"])

    return features


def _scores(sent):
    def score(batches):
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                x = np.array([model.features(t) for t in batch.column(1).to_pylist()], dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return score


def _fitted(rows: DataFrame, ids: DataFrame, most: tuple[int, int], max_bytes: int, window: int, share: float,
            **sizes) -> Model:
    """Model of the labelled texts; ``ids`` holds doc_id and kind. Equal rows count once."""
    spark = rows.sparkSession
    id_type = rows.schema["doc_id"].dataType.simpleString()
    key = ["doc_id", "digest", "kind"]
    known = rows.withColumn("digest", F.xxhash64("text")).join(F.broadcast(ids), "doc_id")
    known = stage(known.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")))
    lengths = known.select(*key, F.octet_length("text").alias("size")).distinct()

    def of_kind(kind: int) -> list:
        order = lengths.filter(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
        return order.limit(most[kind]).collect()

    def texts_of(chosen: list, fn, column: str) -> list:
        """One result per chosen text, in a fixed order."""
        wanted = spark.createDataFrame([tuple(r)[:3] for r in chosen], f"doc_id {id_type}, digest long, kind int")
        made = known.join(F.broadcast(wanted), key).select(*key, "text").mapInArrow(
            fn, f"doc_id {id_type}, digest long, kind int, {column}")
        value = column.split()[0]
        return sorted(made.groupBy(key).agg(F.first(value).alias(value)).collect(), key=lambda r: tuple(r)[:3])

    sample = [of_kind(kind) for kind in (0, 1)]
    empty = [name for name, found in zip(("ordinary", "toxic"), sample) if not found]
    if empty:
        LOG.warning("no labelled text of kind %s to learn from: every score is 0", " and ".join(empty))
        return Model(b"", b"", window)
    learn = [[r for r in found if not calibrates(r["doc_id"])] or found for found in sample]
    rooms = [max(window, water_level([r["size"] for r in found], max_bytes)) for found in learn]
    cuts = texts_of(learn[0] + learn[1], _plain_cuts(rooms, window), "cut binary")
    model = train(*[[bytes(r["cut"]) for r in cuts if r["kind"] == kind] for kind in (0, 1)], window, **sizes)
    rest = [[r for r in found if calibrates(r["doc_id"])] for found in sample]
    if not rest[0] or not rest[1]:
        rest = sample
    seen = texts_of(rest[0] + rest[1], _features(spark.sparkContext.broadcast(model)), "x array<double>")
    model.calibrate(np.array([r["x"] for r in seen]), np.array([r["kind"] for r in seen]), share)
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    window: int = 64, shared_size: int = 32_768, own_size: int = 512, least_z: float = 3.0, share: float = 0.3, max_toxic: int = 4_000, max_ordinary: int = 4_000, max_bytes: int = 32 << 20,
    max_windows: int = 40_000,
) -> DataFrame:
    """doc_id and score of every row of ``docs``; ``labels`` holds the rows to learn from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    most = (max_ordinary, max_toxic)
    ids = [labelled_rows(labels, id_col, label_col, kind, most[kind]).withColumn("kind", F.lit(kind)) for kind in (0, 1)]
    model = _fitted(
        rows, ids[0].unionByName(ids[1]), most, max_bytes, window, share, shared_size=shared_size, own_size=own_size,
        least_z=least_z, max_windows=max_windows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scores(sent), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
