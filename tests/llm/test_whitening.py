"""Whitening against plain integers and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from brindle.llm import op12_whitening as op12
from brindle.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, x array<long>, component int"


def plain(rows: list[tuple], k: int = 16):
    """n, sums, distinct x vectors, covariance, eigenvalues and axes of usable rows."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({tuple(x) for _, x in kept})
    n, d = len(fitted), len(fitted[0])
    sums = [sum(x[j] for x in fitted) for j in range(d)]
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fitted]
    v = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(d)] for i in range(d)])
    return kept, n, sums, v


def check(spark, rows, got, k=16):
    kept, n, sums, v = plain(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1].T
    assert sorted(r["vec_id"] for r in got) == sorted(i for i, _ in kept for _ in range(min(k, len(v))))
    by_id = {i: x for i, x in kept}
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() <= 1e-4
    signs: dict[int, float] = {}
    for r in got:
        x, c = by_id[r["vec_id"]], r["component"] - 1
        centred = [n * a - s for a, s in zip(x, sums)]
        assert r["n"] == n and r["deviation"] == sum(a * a for a in centred) and r["deviation_exact"] == str(r["deviation"])
        assert math.isclose(r["explained"], values[c] / v.trace(), rel_tol=1e-9)
        want = float(np.array([a / n for a in centred]) @ axes[c] / math.sqrt(values[c]))
        if abs(want) > 1e-3:
            assert math.isclose(r["whitened"] * signs.setdefault(c, math.copysign(1, want * r["whitened"])), want, rel_tol=1e-6)


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(spark, rows, queries.op12_embedding_whitening(spark, sf_dir).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, 5)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(200)] + [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [-2.75, 900.0, 0.0, 0.0, 0.0])]
    given = [(*r, 1, [7], 3) for r in [*rows, (906, [0.5] * 3), (907, [1e300] + [0.0] * 4)]]
    got = op12.digest(spark.createDataFrame(given, SCHEMA).repartition(7)).collect()
    check(spark, rows, got)
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5}


def test_repeated_rows_and_null_ids_are_returned(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 1.0]), (2, [5.0, -1.0]), (3, [5.0, 4.0])]
    got = op12.whiten(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA), 1).collect()
    assert sorted((r["vec_id"] or 0 for r in got)) == [0, 1, 1, 2, 3] and {r["n"] for r in got} == {4}


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op12.digest(none).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, None, None) for i in range(9)], SCHEMA)
    assert op12.digest(same).count() == 0


def test_entries_near_the_end_of_long(spark):
    big = 1e17
    rows = [(i, [big * (-1) ** i, float(i * i)]) for i in range(6)]
    got = op12.digest(spark.createDataFrame([(*r, 0, None, None) for r in rows], SCHEMA)).collect()
    kept, n, sums, v = plain(rows)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    assert all(r["deviation"] is None and r["deviation_exact"] == str(want[r["vec_id"]]) for r in got) and len(got) == 6
    assert math.isclose(got[0]["explained"], 1, rel_tol=1e-9)


@pytest.mark.parametrize("width", [1, 7, 31, 63])
def test_bit_sliced_products_are_exact(width):
    rng = np.random.default_rng(width)
    u = rng.integers(0, 2**width, (150, 4), dtype=np.uint64)
    want = [[sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j])) if i <= j else 0 for j in range(4)] for i in range(4)]
    bits = np.array([int(u[:, j].max()).bit_length() for j in range(4)])
    assert np.triu(op12.scatter(u, bits)).tolist() == want


def test_planes_hold_one_bit_a_row():
    u = np.arange(130, dtype=np.uint64)[:, None]
    planes = op12.bit_planes(u, np.array([8]))
    assert planes.shape == (8, 3) and int(np.bitwise_count(planes[0]).sum()) == 65
