"""Whitening against numpy on whole numbers."""

import math

import numpy as np
import pytest

from taplight.llm import whitening


def _want(rows):
    """n, and per row: identifier, exact deviation, whitened values up to the sign of a component; and explained shares."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    width = max(set(lengths), key=lambda d: (lengths.count(d), d))
    whole = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good if len(v) == width]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(width)]
    centre = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
    a = np.array([centre(x) for x in fit])
    covariance = a.T @ a / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(16, int((values > 1e-12 * values[0]).sum()))
    out = [(i, sum((n * b - s) ** 2 for b, s in zip(x, sums, strict=True)), centre(x) @ vectors[:, :kept] / np.sqrt(values[:kept])) for i, x in whole]
    return n, out, values[:kept] / np.trace(covariance)


def _check(got, rows):
    n, want, explained = _want(rows)
    kept = len(explained)
    by_row = {}
    for x in got:
        by_row.setdefault((x["vec_id"], x["deviation"]), []).append(x)
        assert x["n"] == n and 0 <= x["identity_error"] < 1e-9
        assert math.isclose(x["explained"], explained[x["component"] - 1], rel_tol=1e-9)
    assert len(got) == len(want) * kept
    signs = np.zeros(kept)
    for i, deviation, z in want:
        cells = by_row[(i, deviation)]
        assert {x["component"] for x in cells} == set(range(1, kept + 1))
        for x in cells:
            k = x["component"] - 1
            if not signs[k] and abs(z[k]) > 1e-6:
                signs[k] = np.sign(z[k]) * np.sign(x["whitened"])
            assert abs(x["whitened"] * (signs[k] or 1) - z[k]) < 1e-7


def test_query_equals_numpy(spark):
    base = "/root/testdata/sf0.001"
    rows = [(x["vec_id"], list(x["embedding"])) for x in spark.read.parquet(f"{base}/embeddings.parquet").collect()]
    _check(whitening.op12_whitening(spark, base).collect(), rows)


def test_many_blocks_hot_vector_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 3)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(0, 2, 6) + 100).tolist()) for i in range(150)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, -6.0]) for i in range(80)]
    rows += [(1, None), (2, []), (3, [1.0] * 5 + [None]), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5), (6, [1.0, 2.0]), (None, [0.0] * 6), (7, rows[7][1]), (7, rows[8][1])]
    frame = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, index long, key string")
    _check(whitening.whiten(frame).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_varies(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).collect() == [] and whitening.whiten(frame).columns[0] == "vec_id"


def test_equal_entries_leave_fewer_components(spark):
    r = np.random.default_rng(4)
    rows = [(i, [a, a, a + b, 3.0]) for i, (a, b) in enumerate(r.integers(-50, 50, (60, 2)).astype(float).tolist())]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["component"] for x in got} == {1, 2}
    _check(got, rows)
