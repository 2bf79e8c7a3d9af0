import random
from fractions import Fraction

import numpy as np

from vakanz.llm import queries, whitening


def brute(rows, components=32):
    """id, component -> (n, deviation, whitened, explained) in whole numbers and one eigh."""
    kept = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept]
    n, width = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(width)]
    cov = np.array([[float(Fraction(sum((n * r[a] - s[a]) * (n * r[b] - s[b]) for r in x), n ** 3))
                     for b in range(width)] for a in range(width)])
    values, axes = np.linalg.eigh(cov)
    out = {}
    for (i, _), r in zip(kept, x):
        off = [n * c - t for c, t in zip(r, s)]
        for k in range(min(components, width)):
            e, axis = values[-1 - k], axes[:, -1 - k]
            z = sum(o / n * a for o, a in zip(off, axis)) / e ** 0.5 if e > 1e-12 * np.trace(cov) else None
            out[i, k + 1] = (n, sum(o * o for o in off), z, e / np.trace(cov))
    return out


def same(df, want):
    got = {(r.vec_id, r.component): r for r in df.collect()}
    assert set(got) == set(want)
    signs = {}
    for key, (n, deviation, z, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained - explained) < 1e-9
        if z is None:
            assert r.whitened is None
            continue
        if abs(z) > 0.1:
            signs.setdefault(key[1], np.sign(z) * np.sign(r.whitened))
        assert abs(abs(r.whitened) - abs(z)) < 1e-6
        assert abs(z) <= 0.1 or np.sign(z) * np.sign(r.whitened) == signs[key[1]]
        assert r.identity_error < 1e-4


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v int, z int, deviation int")
    return whitening.by_component(*whitening.whiten(df))


def rows_of(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale * (d + 1)) for d in range(width)]) for i in range(n)]


def padded(rows):
    return [(i, v, "x", 1, 2, 3) for i, v in rows]


def test_against_whole_number_arithmetic(spark):
    for rows in (rows_of(1, 90, 5), rows_of(2, 70, 40, 0.05)):
        same(run(spark, padded(rows)), brute(rows))


def test_odd_rows(spark):
    rows = rows_of(3, 40, 3)
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan")] * 3), (93, [1.0, float("inf"), 0.0]), (94, []),
           (95, [1.0, 2.0]), (96, [0.0, -0.0, 0.0]), (97, [3e4, -2e4, 1.0])]
    kept = rows + [(96, [0.0, 0.0, 0.0]), (97, [3e4, -2e4, 1.0])]
    same(run(spark, padded(rows + odd)), brute(kept))
    assert run(spark, padded(odd[:5])).count() == 0
    assert run(spark, []).count() == 0
    one = run(spark, padded([(1, [2.0, 3.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    copies = run(spark, padded([(None, [1.0, 5.0]), (None, [1.0, 5.0]), (7, [2.0, 5.0])])).collect()
    assert len(copies) == 6 and all((r.whitened is None) == (r.component == 2) for r in copies)


def test_huge_entries_stay_exact(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    found = run(spark, padded(rows)).collect()
    assert len(found) == 12 and all(r.deviation is None for r in found)


def test_cross_products_in_bits():
    rng = np.random.default_rng(5)
    for low, high, shape in ((-3, 4, (200, 7)), (0, 1, (65, 2)), (-(1 << 62), 1 << 62, (130, 3)), (5, 6, (1, 1))):
        x = rng.integers(low, high, shape)
        sums, cross = whitening.cross_products(x)
        big = x.astype(object)
        assert sums == list(big.sum(axis=0)) and (cross == big.T @ big).all()


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    values, axes = np.linalg.eigh(off.T.astype(float) @ off / n ** 3)
    z = off / n @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    found = {(r.vec_id, r.component): r for r in queries.op11(spark, sf_dir).collect()}
    assert len(found) == n * 32
    for at, (i, _) in enumerate(kept):
        for k in range(32):
            r = found[i, k + 1]
            assert r.deviation == int((off[at] ** 2).sum()) and abs(abs(r.whitened) - abs(z[at, k])) < 1e-6
            assert abs(r.explained - values[-1 - k] / values.sum()) < 1e-9 and r.identity_error < 1e-6
