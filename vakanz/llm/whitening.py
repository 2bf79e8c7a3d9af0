"""Embedding whitening from a bit-sliced scatter matrix.

Entries become whole numbers. A block of rows is shifted by its minimum per dimension and cut into
bit planes; a plane's bits are packed across the rows into 64-bit words. The cross-product of two
dimensions is the sum over their planes of 2^(p + q) times the population count of the AND of the two
planes, so it is exact. Blocks add the shift back in whole numbers, tasks sum their blocks, and Spark
adds the tasks' sums limb by limb; nothing is rounded before the centred matrix n*C - S*S' is divided
once for the eigen-decomposition.

The driver holds one D x D matrix for D dimensions, whatever the number of rows; the rows themselves
are only read in batches. Whitened rows are written once, and their covariance is measured on what was
written.

Defined results: rows whose vector is null, or holds null or non-finite entries, take no part, nor do
empty vectors and vectors of another length than the commonest one (the longest of equally common
ones); whole numbers beyond +-2^62 stand at that bound; rows with a null or a repeated id are rows
like any other; a component without variance has null ``whitened`` and counts for nothing in
``identity_error``; a deviation that no long holds is null; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK = 1 << 15  # rows of a bit-sliced block
LIMB, LIMBS = 42, 5
BOUND = 1 << 62
FLAT = 1e-14  # a share of the trace below rounding: no variance


def finite_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v: rows whose vector has only finite entries, at least one."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return df.select(F.col(id_col).alias("id"), entries.alias("v")).filter(fine & (F.size("v") > 0))


def whole(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * v), -float(BOUND), float(BOUND)).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def cross_products(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact column sums and the exact matrix x'x of whole numbers, as Python integers."""
    rows, width = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, so no difference overflows
    bits = [max(1, int(top).bit_length()) for top in y.max(axis=0)]
    starts = np.concatenate(([0], np.cumsum(bits)))
    words = -(-rows // 64)
    planes = np.zeros((starts[-1], words * 8), dtype=np.uint8)
    for d, n_bits in enumerate(bits):
        cut = (y[:, d][None, :] >> np.arange(n_bits, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(cut, axis=1)
        planes[starts[d]:starts[d + 1], :packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    counts = np.empty((len(planes), len(planes)), dtype=np.int64)
    for i, plane in enumerate(planes):
        both = np.bitwise_count(planes[i:] & plane).sum(axis=1, dtype=np.int64)
        counts[i, i:] = counts[i:, i] = both
    small = 2 * max(bits) + rows.bit_length() < 62
    power = [1 << p for n_bits in bits for p in range(n_bits)]
    weight = np.array(power, dtype=np.int64 if small else object)
    of = counts if small else counts.astype(object)
    once = np.add.reduceat(of * weight[:, None], starts[:-1], axis=0)
    shifted = np.add.reduceat(once * weight[None, :], starts[:-1], axis=1).astype(object)
    sums = np.array([int(s) for s in np.add.reduceat(np.diag(of) * weight, starts[:-1])], dtype=object)
    shift = np.array([int(m) for m in low], dtype=object)
    # x = y + shift
    cross = shifted + np.outer(shift, sums) + np.outer(sums, shift) + rows * np.outer(shift, shift)
    return list(sums + rows * shift), cross


def _limbs(value: int) -> list[int]:
    """Signed digits to base 2**LIMB; their sums give the sum of the values."""
    sign, size = (-1, -value) if value < 0 else (1, value)
    return [sign * (size >> (LIMB * k) & ((1 << LIMB) - 1)) for k in range(LIMBS)]


def _scatter(width: int):
    names = ["i", "j", *[f"l{k}" for k in range(LIMBS)]]

    def task(batches):
        n, sums, cross = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        held, size = [], 0

        def flush():
            nonlocal n, sums, cross, held, size
            if held:
                s, c = cross_products(np.concatenate(held))
                n, sums, cross = n + size, sums + np.array(s, dtype=object), cross + c
            held, size = [], 0

        for batch in batches:
            x = whole(_matrix(batch.column(0), width))
            for at in range(0, len(x), BLOCK):
                held.append(x[at:at + BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    flush()
        flush()
        if not n:
            return
        rows = [(-1, -1, *_limbs(n))] + [(i, -1, *_limbs(sums[i])) for i in range(width)]
        rows += [(i, j, *_limbs(cross[i, j])) for i in range(width) for j in range(i, width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return task


class Whitening:
    """n, S, the components and their variances."""

    def __init__(self, n: int, sums: list[int], cross: list[list[int]], most: int):
        width = len(sums)
        self.n, self.sums = n, sums
        # centred in whole numbers, rounded once
        cov = np.array([[float(Fraction(n * cross[i][j] - sums[i] * sums[j], n * n)) for j in range(width)]
                        for i in range(width)])
        scale = 2.0 ** (int(np.frexp(np.abs(cov).max() or 1.0)[1]))
        values, vectors = np.linalg.eigh(cov / scale)
        top = np.argsort(-values, kind="stable")[:most]
        trace = float(Fraction(sum(n * cross[i][i] - sums[i] ** 2 for i in range(width)), n * n))
        self.variance = np.maximum(values[top], 0.0) * scale
        self.has_variance = self.variance > FLAT * trace
        self.explained = [float(v / trace) if trace > 0 else None for v in self.variance]
        self.axes = vectors[:, top]

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Exact deviations and whitened coordinates of whole-number rows."""
        reach = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(abs(s) for s in self.sums)
        if reach * reach * x.shape[1] < 1 << 62:
            off = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        else:
            off = x.astype(object) * self.n - np.array(self.sums, dtype=object)
            if max(int(off.max()), -int(off.min())) ** 2 * x.shape[1] < 1 << 62:
                off = off.astype(np.int64)
        deviation = [int(d) if d < 1 << 63 else None for d in (off * off).sum(axis=1).tolist()]
        centred = (off.astype(np.float64) if off.dtype != object else
                   np.array([[float(Fraction(int(c), self.n)) * self.n for c in r] for r in off])) / self.n
        deep = np.sqrt(np.where(self.has_variance, self.variance, 1.0))
        return deviation, np.where(self.has_variance, centred @ self.axes / deep, np.nan)


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Scatter sums of all rows; ``vectors`` has only rows of this width in ``v``."""
    fields = ", ".join(["i long", "j long", *[f"l{k} long" for k in range(LIMBS)]])
    parts = vectors.select("v").mapInArrow(_scatter(width), fields)
    rows = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()  # D(D+3)/2 + 1
    total = {(r.i, r.j): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in rows}
    if not total:
        return None
    cross = [[total[min(i, j), max(i, j)] for j in range(width)] for i in range(width)]
    return Whitening(total[-1, -1], [total[i, -1] for i in range(width)], cross, min(components, width))


def _whiten(model: Whitening, width: int):
    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if not part.num_rows:
                    continue
                deviation, z = model.apply(whole(_matrix(part.column(1), width)))
                cells = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # NaN to null
                ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, cells)],
                    ["id", "deviation", "z"])

    return task


def _squares(n_comp: int):
    def task(batches):
        total, found = np.zeros((n_comp, n_comp + 1)), False
        for batch in batches:
            if batch.num_rows:
                z = np.nan_to_num(_matrix(batch.column(0), n_comp))
                total += np.column_stack((z.T @ z, z.sum(axis=0)))
                found = True
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(n_comp), n_comp + 1)), pa.array(np.tile(np.arange(n_comp + 1), n_comp)),
                 pa.array(total.ravel())], ["i", "j", "s"])

    return task


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the written coordinates minus the identity."""
    k = len(model.variance)
    parts = whitened.select("z").mapInArrow(_squares(k), "i long, j long, s double")
    total = np.zeros((k, k + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k * (k + 1) rows
        total[r.i, r.j] = r.s / model.n
    off = np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k))
    kept = model.has_variance
    return float(off[np.ix_(kept, kept)].max()) if kept.any() else 0.0


def whiten(
    df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> tuple[DataFrame, Whitening | None]:
    """id, deviation, z (whitened coordinates by falling variance) of every row that takes part; the model."""
    found = finite_vectors(df, id_col, vector)
    sizes = found.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "width")).alias("m")).first().m
    width = most.width if most else 1
    rows = found.filter(F.size("v") == width)
    model = fit(rows, width, components) if most else None
    id_type = found.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, deviation long, z array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema), None
    return stage(rows.mapInArrow(_whiten(model, width), schema)), model


def by_component(whitened: DataFrame, model: Whitening | None, id_name: str = "vec_id") -> DataFrame:
    """One row per row and component, numbered from 1."""
    opened = whitened.select(F.col("id").alias(id_name), F.posexplode("z").alias("at", "whitened"), "deviation")
    explained: Column = F.lit(None).cast("double")
    error, n = explained, F.lit(None).cast("long")
    if model:
        explained = F.array(*[F.lit(e).cast("double") for e in model.explained])[F.col("at")]
        error, n = F.lit(identity_error(whitened, model)), F.lit(model.n).cast("long")
    return opened.select(id_name, (F.col("at") + 1).cast("int").alias("component"), n.alias("n"), "deviation",
                         "whitened", explained.alias("explained"), error.alias("identity_error"))
