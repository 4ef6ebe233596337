"""Whitening against a dense eigenvalue solve of small tables."""

import numpy as np
import pytest

from flowboard.llm import registry
from flowboard.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def expected(rows, components=32):
    whole = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in whole], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-12 * values[0]).sum())
    k = min(components, rank)
    return [i for i, _ in whole], n, [int(((n * r - s) ** 2).sum()) for r in x], y @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(make, rows, components=32, tolerance=1e-6):
    ids, n, deviation, whitened, explained = expected(rows, components)
    got = sorted(whiten(make(rows, SCHEMA), components=components).collect(), key=lambda r: r.row.vec_id)
    assert [r.row.vec_id for r in got] == sorted(ids) and {r.n for r in got} == {n}
    order = np.argsort(ids, kind="stable")
    assert [r.deviation for r in got] == [deviation[i] for i in order]
    w = np.array([r.whitened for r in got])
    sign = np.sign((w * whitened[order]).sum(axis=0))
    assert np.abs(w - whitened[order] * sign).max() < tolerance
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and max(r.identity_error for r in got) < 1e-9


def vectors(n, size, seed=0, scale=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, size)) * (np.linspace(3, 1, size) if scale is None else scale)
    return [(i, [float(c) for c in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("n, size, components", [(400, 24, 32), (60, 8, 3), (3, 12, 32), (300, 40, 5)])
def test_components_match_a_dense_solve(make, n, size, components):
    check(make, vectors(n, size, n), components)


def test_long_vectors_end_by_their_residuals(make, monkeypatch):
    rows = vectors(500, 90, 1, np.array([200.0 / 1.25 ** i + 0.5 for i in range(90)]))
    monkeypatch.setattr("flowboard.llm.whitening.LEAST_STEPS", 1)
    from flowboard.llm import whitening

    data, size = whitening.usable(make(rows, SCHEMA))
    fitted = whitening.fit(data, size, 4)
    assert fitted.steps < 90
    check(make, rows, 4)


def test_equal_eigenvalues_are_all_found(make):
    # Corners of a cross: every direction deviates alike.
    rows = [(2 * i + s, [float(8 * (1 - 2 * s)) if j == i else 0.0 for j in range(6)]) for i in range(6) for s in range(2)]
    got = whiten(make(rows, SCHEMA)).collect()
    w = np.array([r.whitened for r in got])
    assert w.shape == (12, 6) and np.abs(w.T @ w / 12 - np.eye(6)).max() < 1e-9 and np.allclose(got[0].explained, 1 / 6)


def test_odd_rows(make):
    rows = vectors(50, 5, 2)
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]), (104, [float("inf")] * 5), (105, [-float("inf")] * 5)]
    check(make, rows + odd)
    assert whiten(make(rows + odd + [(106, [1.0, 2.0])], SCHEMA)).count() == 50
    twice = [(0, rows[0][1])] * 30 + rows[1:]
    got = whiten(make(twice, SCHEMA))
    assert got.count() == 79 and got.first().n == 79
    extra = make([(i, v, 1, 2.0, "x") for i, v in rows + [(None, rows[3][1])]], SCHEMA + ", n int, x double, row string")
    assert whiten(extra).where("row.vec_id is null and row.row = 'x'").count() == 1


def test_tables_without_deviation(make):
    assert whiten(make([], SCHEMA)).count() == 0 and whiten(make([(1, None)], SCHEMA)).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        got = whiten(make(rows, SCHEMA)).collect()
        assert len(got) == len(rows) and all(r.deviation == 0 and r.whitened == [] for r in got)


def test_query_over_the_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, whitened, explained = expected(rows)
    got = registry.QUERIES["op11_embedding_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(ids) * whitened.shape[1] and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    w = got["whitened"].to_numpy().reshape(len(ids), -1)
    want = whitened[np.argsort(ids)]
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-7
    assert np.allclose(got["explained"].to_numpy()[:whitened.shape[1]], explained, rtol=1e-10)
