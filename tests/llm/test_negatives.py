"""Hard negatives against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from brindle.llm import op11_hard_negatives as op11
from brindle.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, key long, q string, score double"


def plain(rows: list[tuple], d: int | None = None) -> list[tuple]:
    """Results of rows (vec_id, vector, label), over all pairs, in Python integers."""
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v) and d in (None, len(v)):
            label = (label + 1) % 10 if i % 7 == 0 else label
            kept[i, label, tuple(math.floor(256 * float(c)) for c in v)] = None
    kept = list(kept)
    exact = np.array([k[2] for k in kept], dtype=object).reshape(len(kept), -1)
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        score = dict(zip(kept, (exact @ np.array(a[2], dtype=object)).tolist()))
        near = sorted((k for k in kept if k[1] == a[1] and k != a), key=lambda k: (-score[k], k[0]))[:5]
        for p in near:
            fits = [k for k in kept if k[1] != a[1] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            for rank, k in enumerate(sorted(fits, key=lambda k: (-score[k], k[0]))[:10], 1):
                out.append((a[0], p[0], rank, k[0], score[p], score[k]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*[x.split()[0] for x in op11.RESULT.split(", ")]).collect())


def test_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain(rows)
    assert len(want) > 100 and got(queries.op11_hard_negatives_mined(spark, sf_dir)) == want


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (10, 13))
    rows = [(i, [float(c) for c in centres[i % 10] + rng.normal(0, 0.5, 13)], i % 10) for i in range(900)]
    rows += [(1000 + i, rows[100][1], 0) for i in range(400)]  # copies, some of them relabelled
    rows += [rows[100], rows[200], rows[200]]
    rows += [(2000, [0.0] * 13, 3), (2100, [-c for c in rows[0][1]], 0), (2001, None, 1), (2002, [1.0] * 13, None), (2003, [1.0, None] + [0.0] * 11, 1), (None, rows[0][1], 0), (2004, [float("nan")] * 13, 1), (2005, [float("inf")] + [0.0] * 12, 2), (2006, [], 1), (2007, [1e30] + [0.0] * 12, 1), (2008, [1.0] * 4, 1)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"SAMPLE": 40, "ROWS": 64, "BLOCK": 3, "ANCHORS": 5}, {"SAMPLE": 3, "FEW": 0.0}, {"FEW": 2.0, "STEP": 3}])
def test_odd_rows(spark, odd, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(op11, k, v)
    table = spark.createDataFrame([(*r, 1, "q", 0.5) for r in odd], SCHEMA).repartition(5)
    want = plain([r for r in odd if r[0] != 2007], 13)
    assert got(op11.digest(table)) == want


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.uniform(2**20, 2**21, 4)], i % 2) for i in range(400)]
    table = spark.createDataFrame([(*r, 1, "q", 0.5) for r in rows], SCHEMA)
    assert got(op11.digest(table)) == plain(rows)


def test_fewer_rows_than_asked_for(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.2], 2), (3, [0.2, 0.0], 3), (200, [0.0, 1.0], 5)]
    table = spark.createDataFrame([(*r, 1, "q", 0.5) for r in rows], SCHEMA)
    assert got(op11.digest(table)) == plain(rows) and got(op11.digest(table.limit(0))) == []


def test_index_omits_what_norms_cover():
    x = np.array([[5.0, 0, 0, 0], [1, 1, 1, 1], [0.1, 0, 0, 0.1]])
    anchors = np.array([[4.0, 1, 0, 0]])
    at = np.array([0, 2, 4])
    index = op11.Index(x, op11.suffix_norms(x, at), op11.suffix_norms(anchors, at), np.array([3.0]), at)
    assert index.lists == [2, 0] and index.order.tolist() == [0, 1, 2]
    a, r, s = op11.join(anchors, op11.suffix_norms(anchors, at), index, np.array([3.0]), np.ones((1, 3), bool))
    assert sorted(zip(r.tolist(), s.tolist())) == [(0, 20.0), (1, 5.0)]


def test_join_finds_all_pairs_that_reach_their_thresholds():
    rng = np.random.default_rng(5)
    for few in (0.0, 1 / 16, 2.0):
        x, anchors = np.floor(rng.normal(0, 80, (500, 20))), np.floor(rng.normal(0, 80, (30, 20)))
        at, limits = op11.edges(20), rng.uniform(1, 60_000, 30)
        op11_few, op11.FEW = op11.FEW, few
        norms, own = op11.suffix_norms(x, at), op11.suffix_norms(anchors, at)
        a, r, s = op11.join(anchors, own, op11.Index(x, norms, own, limits, at), limits, np.ones((30, 500), bool))
        op11.FEW = op11_few
        want = anchors @ x.T
        assert set(zip(a.tolist(), r.tolist(), s.tolist())) == {(i, j, want[i, j]) for i, j in zip(*np.nonzero(want >= limits[:, None]))}
