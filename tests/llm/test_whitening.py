"""Whitening against numpy's own eigenvectors."""

import numpy as np
import pytest

from haulmark.llm.registry import op13_embedding_whitening
from haulmark.llm.whitening import embedding_whitening, lobpcg

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, components=4):
    kept = [(i, tuple(int(np.floor(256.0 * float(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for k in range(min(components, d)):
        e, u = values[-1 - k], vectors[:, -1 - k]
        if e <= 1e-12 * values.sum():
            break
        out[k + 1] = [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), float((np.array(x, float) - mean) @ u / np.sqrt(e)), e / values.sum()) for i, x in kept]
    return out


def agree(df, rows, close=1e-7):
    assert df.columns == NAMES
    got = {}
    for r in df.collect():
        got.setdefault(r.component, []).append(r)
    want = plain(rows)
    assert set(got) == set(want)
    for k, mine in got.items():
        order = lambda r: (r[0] is None, r[0] or 0, r[-2] if len(r) == 5 else 0)
        a, b = sorted(((r.vec_id, r.n, r.deviation, r.whitened, r.explained) for r in mine), key=order), sorted(want[k], key=order)
        assert [x[:3] for x in a] == [x[:3] for x in b]
        x, y = np.array([r[3] for r in a]), np.array([r[3] for r in b])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < close
        assert all(abs(p[4] / q[4] - 1) < 1e-9 for p, q in zip(a, b, strict=True))
        assert max(r.identity_error for r in mine) < 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    agree(op13_embedding_whitening(spark, "/root/testdata/sf0.001"), rows)


def made(spark, rows):
    rows = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, "a", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double")


def test_dropped_and_repeated_rows(spark):
    g = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in g.normal(size=6) * [5, 4, 3, 2, 1, 1]]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 1, 1, 1, 1]), (102, [float("nan"), 1, 1, 1, 1, 1]), (103, [float("inf"), 1, 1, 1, 1, 1]), (104, [float("-inf")] * 6)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    agree(embedding_whitening(made(spark, rows)), rows)
    odd = [*rows, (300, [1.0, 2.0]), (301, [])]
    assert embedding_whitening(made(spark, odd)).filter("vec_id >= 300").count() == 0


def test_few_dimensions_and_low_rank(spark):
    g = np.random.default_rng(2)
    two = [(i, [float(np.float32(c)) for c in g.normal(size=2)]) for i in range(20)]
    agree(embedding_whitening(made(spark, two)), two)
    line = [(i, [float(i % 7), float(2 * (i % 7)), 1.0, 0.0, 3.0]) for i in range(20)]
    agree(embedding_whitening(made(spark, line)), line)


def test_no_variance_and_empty(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = embedding_whitening(made(spark, rows))
        assert out.columns == NAMES and out.count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(np.float32(2.0**17 * (i % 5))), float(np.float32(2.0**15 * (i % 3)))]) for i in range(15)]
    agree(embedding_whitening(made(spark, rows)), rows)
    with pytest.raises(Exception, match="OverflowError"):
        embedding_whitening(made(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0])])).collect()


def test_steps_are_certified():
    g = np.random.default_rng(3)
    q = np.linalg.qr(g.normal(size=(200, 200)))[0]
    values = np.concatenate([[10, 9.99, 5, 4.999], np.linspace(4.9, 0, 196)])
    a = (q * values) @ q.T
    steps = []
    e, u = lobpcg(lambda b: (steps.append(1), a @ b)[1], 200, values.sum(), 4)
    assert np.abs(e - values[:4]).max() < 1e-11 and np.linalg.norm(a @ u - u * e, axis=0).max() <= 1e-11
    assert np.abs(np.abs(u.T @ q[:, :4]) - np.eye(4)).max() < 1e-9 and len(steps) < 80
