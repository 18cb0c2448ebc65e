"""Whitening against a dense eigendecomposition and exact sums."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from jobgrid.llm import queries as q
from jobgrid.llm import whitening


def whole(v) -> list[int]:
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def table(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return q.op11(spark, str(path)).collect()


@pytest.mark.parametrize("d", [3, 40])
def test_whitening(spark, tmp_path, d):
    r = np.random.default_rng(d)
    v = r.normal(size=(400, d)) @ np.diag(np.linspace(3, 0.2, d)) + r.normal(size=d)
    v[50:180] = v[50]  # a third of all rows
    rows = [(i // 2, [float(c) for c in x], "x", "y") for i, x in enumerate(v)]
    odd = [(900, None, "", ""), (901, [float("nan")] * d, "", ""), (902, [1.0, None] + [0.0] * (d - 2), "", ""), (903, [float("inf")] + [0.0] * (d - 1), "", ""), (904, [1.0], "", ""), (905, [], "", "")]
    got = table(spark, tmp_path, [*rows, *odd, (None, rows[7][1], None, None), rows[8]])
    kept = [*rows, (None, rows[7][1]), rows[8]]
    x = [whole(y[1]) for y in kept]
    n, k = len(kept), min(d, 32)
    sums = [sum(c) for c in zip(*x)]
    want = sorted((y[0] if y[0] is not None else -1, sum((n * a - s) ** 2 for a, s in zip(z, sums))) for y, z in zip(kept, x))
    assert {g["n"] for g in got} == {n} and len(got) == n * k
    assert sorted((g["vec_id"] if g["vec_id"] is not None else -1, g["deviation"]) for g in got if g["component"] == 1) == want
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(z, sums)] for z in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = centred @ u / np.sqrt(e)
    by_row: dict = {}
    for g in got:
        assert g["explained"] == pytest.approx(e[g["component"] - 1] / np.trace(cov), rel=1e-9)
        assert 0 <= g["identity_error"] < 1e-10
        by_row.setdefault((g["vec_id"] if g["vec_id"] is not None else -1, g["component"]), []).append(g["whitened"])
    mine: dict = {}
    for y, values in zip(kept, z):
        for c in range(k):
            mine.setdefault((y[0] if y[0] is not None else -1, c + 1), []).append(values[c])
    signs = {}
    for key, values in mine.items():
        a, b = sorted(map(abs, values)), sorted(map(abs, by_row[key]))
        assert np.allclose(a, b, atol=1e-6)
        if len(values) == 1 and abs(values[0]) > 1e-3:
            signs.setdefault(key[1], set()).add(np.sign(values[0]) == np.sign(by_row[key][0]))
    assert all(len(s) == 1 for s in signs.values())


def test_components_keep_small_eigenvalues():
    r = np.random.default_rng(0)
    u, _ = np.linalg.qr(r.normal(size=(24, 24)))
    e = 10.0 ** -np.arange(0, 12, 0.5)
    found, vectors = whitening.components((u * e) @ u.T)
    assert np.allclose(found, e[: len(found)], rtol=1e-3) and len(found) == 24
    assert np.allclose(vectors.T @ vectors, np.eye(24), atol=1e-9)
    low, _ = whitening.components(np.outer(np.arange(5.0), np.arange(5.0)))
    assert len(low) == 1 and low[0] == pytest.approx(30.0)
    assert len(whitening.components(np.zeros((3, 3)))[0]) == 0


def test_rows_without_variance_and_large_components(spark, tmp_path):
    assert table(spark, tmp_path / "one", [(1, [1.0, 2.0], "", "")]) == []
    assert table(spark, tmp_path / "same", [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")]) == []
    big = table(spark, tmp_path / "big", [(1, [1e6, 1.0], "", ""), (2, [-1e6, 1.0], "", ""), (3, [0.0, 1.0], "", "")])
    assert [b["deviation"] for b in sorted(big, key=lambda b: b["vec_id"])] == [(3 * 64_000_000) ** 2] * 2 + [0]
    with pytest.raises(Exception, match="too large"):
        table(spark, tmp_path / "huge", [(1, [1e30, 2.0], "", ""), (2, [1.0, 2.0], "", "")])
