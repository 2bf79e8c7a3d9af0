"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every whole text becomes ``FEATURES`` statistics. They are standardised, and cosines of random
projections approximate a Gaussian kernel over them. Each partition of the training rows adds up its
part of the normal equations; the driver adds one matrix of (n_fourier + 1)^2 per partition (their
number is a parameter) and solves for the ridge weights. Rows of one hash fold only calibrate: labels
are counted per bin of the raw score, adjacent bins are pooled until their rates rise (isotonic
regression), and scores in between are interpolated.

Training takes at most ``max_rows`` labelled rows of each kind, by hash of their id. Statistics and
scores cover every row; texts are read once, for the statistics, which are staged.

Defined results: null and empty texts have the statistics of an empty text; without labelled rows of
both kinds every score is 0.5; repeated rows are scored one by one; null or contradicting labels are
left out; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import stage
from vakanz.llm.labelled import labelled_rows

FEATURES = (
    "log_chars", "log_words", "word_size", "word_size_spread", "longest_word", "upper", "digits", "symbols", "marks",
    "stops", "bars", "other_marks", "beyond_ascii", "line_words", "distinct_words", "distinct_pairs", "distinct_lines",
    "symbol_words",
)
BINS = 400  # of the raw score in [LOW, HIGH]
LOW, HIGH = -0.5, 1.5

_CLASS = np.zeros(256, dtype=np.uint8)
for _kind, _chars in enumerate((
        range(65, 91), range(48, 58), b"#*$%&<>", b"!?", b".,;:", b"|", b"\"'()[]{}@+-=_/\\~^`", range(128, 256)), 1):
    _CLASS[list(_chars)] = _kind


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9) / size
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    pairs = len(set(zip(words, words[1:])))
    marked = raw.translate(None, b"#*$%&<>|!?")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        *kinds[1:9], np.log1p(n / max(1, len(lines))), len(set(words)) / n, pairs / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)), (len(raw) - len(marked)) / n,
    ]


def _statistics(batches):
    for batch in batches:
        rows = [np.asarray(statistics(t), dtype=np.float32) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "features"])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), *self.knots)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), len(FEATURES))


def _normal_equations(sent):
    def add(batches):
        model = sent.value
        n = len(model.phases) + 1
        gram, right = np.zeros((n, n)), np.zeros(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = model.fourier(matrix(part.column("features")))
                gram += z.T @ z
                right += z.T @ np.asarray(part.column("label"), dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["gram", "right"])

    return add


def _raw_scores(sent):
    def score(batches):
        for batch in batches:
            if batch.num_rows:
                raw = sent.value.raw(matrix(batch.column("features")))
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw)], ["label", "raw"])

    return score


def _scores(sent):
    def score(batches):
        for batch in batches:
            if batch.num_rows:
                found = sent.value.score(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return score


def pooled(bins: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of (place, rows, positive rows) in order of place, as knots.

    Neighbours whose rates fall are pooled. Half a row of either label is added to the end pools,
    so that no score is exactly 0 or 1.
    """
    pools: list[list[float]] = []
    for place, n, good in bins:
        pools.append([place * n, n, good])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])


def fit(rows: DataFrame, *, n_fourier: int, ridge: float, width: float, partitions: int, seed: int) -> Model:
    """Model of ``doc_id, features, label`` rows."""
    spark = rows.sparkSession
    fold = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(5)) == 0
    spans = [f(F.col("features")[i]).alias(f"{name}{i}") for i in range(len(FEATURES))
             for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = rows.agg(F.count_distinct("label").alias("kinds"), *spans).first()
    rng = np.random.default_rng(seed)
    d = len(FEATURES)
    model = Model(
        np.array([found[f"m{i}"] or 0.0 for i in range(d)]), np.array([(found[f"s{i}"] or 0.0) + 1e-6 for i in range(d)]),
        rng.normal(size=(d, n_fourier)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, n_fourier))
    if found["kinds"] < 2:
        return model
    sent = spark.sparkContext.broadcast(model)
    sums = rows.filter(~fold).repartition(partitions).mapInArrow(
        _normal_equations(sent), "gram binary, right binary").toLocalIterator()
    n = n_fourier + 1
    gram, right = np.eye(n) * ridge, np.zeros(n)
    for row in sums:
        gram += np.frombuffer(row["gram"]).reshape(n, n)
        right += np.frombuffer(row["right"])
    model.weights = np.linalg.solve(gram, right)
    sent = spark.sparkContext.broadcast(model)
    held = rows.filter(fold).mapInArrow(_raw_scores(sent), "label double, raw double")
    spot = F.least(F.greatest(F.floor((F.col("raw") - LOW) / (HIGH - LOW) * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = held.groupBy(spot.alias("bin")).agg(
        F.avg("raw").alias("place"), F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    if bins:
        model.knots = pooled([(r["place"], r["n"], r["good"]) for r in bins])
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    n_fourier: int = 256, ridge: float = 1e-3, width: float = 0.6, max_rows: int = 50_000, partitions: int = 16,
    seed: int = 11,
) -> DataFrame:
    """doc_id and score of every row of ``docs``; ``labels`` holds the rows to learn from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = stage(rows.mapInArrow(_statistics, f"doc_id {kind}, features array<float>"))
    chosen = [labelled_rows(labels, id_col, label_col, k, max_rows).withColumn("label", F.lit(float(k))) for k in (0, 1)]
    model = fit(stage(known.join(chosen[0].unionByName(chosen[1]), "doc_id")), n_fourier=n_fourier, ridge=ridge,
                width=width, partitions=partitions, seed=seed)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return known.mapInArrow(_scores(sent), f"doc_id {kind}, score double")
