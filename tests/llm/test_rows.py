"""Mixing, nearest neighbours, sharding and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import op1_mixing, op2_additive_quantisation, op6_uniform_shuffle, op7_byte_bpe, op10_toxicity, queries
from tests.llm import brute


@pytest.mark.parametrize("table", ["odd", "small"])
def test_mixing_meets_its_targets(request, table):
    docs = request.getfixturevalue(table)
    rows = op1_mixing.digest(docs).collect()
    assert len(rows) == docs.count()
    cells = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows if r["n_tokens"]}
    tokens = Counter()
    for r in rows:
        tokens[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    assert abs(sum(cells.values()) - 1) < 1e-6
    for k, margin in enumerate(("source", "lang", "topic")):
        shares, now = Counter(), Counter()
        for c, n in tokens.items():
            if n:
                shares[c[k]] += n
                now[c[k]] += cells[c]
        powered = {x: n ** op1_mixing.TEMPER[margin] for x, n in shares.items()}
        if table == "small":
            assert all(abs(now[x] - p / sum(powered.values())) < 1e-3 for x, p in powered.items())
    for r in rows:
        cell = (r["source"], r["lang"], r["topic"])
        assert 0 <= r["probability"] <= 1
        if r["n_tokens"]:
            assert math.isclose(r["probability"] * tokens[cell] / cells[cell], max(x["probability"] * tokens[x["source"], x["lang"], x["topic"]] / x["weight"] for x in rows if x["weight"]), rel_tol=1e-6)


def test_mixing_draws_by_probability(small):
    """The draw is a fixed hash of id and text against the probability; its share of tokens is near the expected one."""
    rows = op1_mixing.digest(small).collect()
    kept = {r["doc_id"] for r in op1_mixing.sample(small).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows if r["sampled"]}
    h = {r["doc_id"]: r["h"] for r in small.select("doc_id", F.xxhash64(F.lit(3), "doc_id", "text").alias("h")).collect()}
    assert all(r["sampled"] == ((h[r["doc_id"]] % (1 << 53)) / (1 << 53) < r["probability"]) for r in rows)
    assert rows[0]["gap"] < op1_mixing.TOLERANCE


def test_mixing_by_given_topics_and_targets_that_contradict(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "if(id % 50 = 0, ' ', repeat('word ', 20)) AS text", "if(id % 2 = 0, 'a', 'b') AS source", "if(id % 2 = 0, 'x', 'y') AS lang")
    shares = lambda name, values: spark.createDataFrame(values, f"{name} string, share double")
    targets = {"source": shares("source", [("a", 0.5), ("b", 0.5)]), "lang": shares("lang", [("x", 0.9), ("y", 0.1)])}
    rows = op1_mixing.calibrated(docs, targets, topic_of=F.col("doc_id") % 3).collect()
    assert {r["topic"] for r in rows} == {"0", "1", "2"} and rows[0]["gap"] > 0.1
    assert all(r["probability"] == 1 and r["sampled"] for r in rows if r["n_tokens"] == 0)


def test_mixing_to_given_targets(spark, small, empty):
    targets = {"source": small.select("source").distinct().withColumn("share", F.lit(1.0) / small.select("source").distinct().count())}
    rows = op1_mixing.calibrated(small, targets).where("n_tokens > 0").dropDuplicates(["source", "lang", "topic"]).groupBy("source").agg(F.sum("weight").alias("w")).collect()
    assert max(r["w"] for r in rows) - min(r["w"] for r in rows) < 1e-2
    assert op1_mixing.digest(empty).count() == 0 and op1_mixing.sample(small).columns == small.columns


def test_mixing_keeps_its_share_beside_a_rare_cell(spark):
    """One document of a new source is kept whole, and takes nothing from the rate of the others."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 300 + int(id % 7)) AS text", "element_at(array('en', 'de', 'fr', 'vi'), int(id % 4) + 1) AS lang", "if(id % 3 = 0, 'hot', concat('s', id % 19)) AS source")
    rows = op1_mixing.digest(docs.unionByName(spark.createDataFrame([(-1, "rare " * 250, "en", "new")], docs.schema))).collect()
    total = sum(r["n_tokens"] for r in rows)
    expected = sum(r["n_tokens"] * r["probability"] for r in rows) / total
    assert math.isclose(expected, 0.5, rel_tol=1e-6)
    assert math.isclose(rows[0]["kept_share"], expected, rel_tol=1e-6)
    assert abs(sum(r["n_tokens"] for r in rows if r["sampled"]) / total - expected) < 0.05
    tokens = Counter()
    for r in rows:
        tokens[r["source"], r["lang"]] += r["n_tokens"]
    rates = {(r["source"], r["lang"]): (r["probability"], tokens[r["source"], r["lang"]] / r["raked"] / total) for r in rows}
    assert rates["new", "en"][0] == 1 and min(x for _, x in rates.values()) < 0.25  # all that a common rate could keep
    scales = [p * x for p, x in rates.values() if p < 1]
    assert len(scales) == len(rates) - 1 and math.isclose(min(scales), max(scales), rel_tol=1e-9)


def nearest(rows, k=10):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for q in ids:
        if q % 100 == 0:
            d = np.sqrt(((x - good[q]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_search_recall(spark, sf_dir, monkeypatch):
    """An index of 20,000 vectors, of which few are ranked again, in one task's chunks and several blocks of queries."""
    monkeypatch.setattr(op2_additive_quantisation, "ENTRIES", 2_000)
    monkeypatch.setattr(op2_additive_quantisation, "QUERIES", 120)
    rng = np.random.default_rng(4)
    own = [r["embedding"] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet").collect() if r["embedding"]]
    more = rng.normal(size=(20_000 - len(own), len(own[0]))).astype(np.float32)
    more /= np.linalg.norm(more, axis=1, keepdims=True)
    table = spark.createDataFrame(list(enumerate([*own, *more.tolist()])), "vec_id long, embedding array<float>").repartition(6)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, listed = nearest(rows), []
    plain = op2_additive_quantisation._candidates
    monkeypatch.setattr(op2_additive_quantisation, "_candidates", lambda *a: listed.append(plain(*a)) or listed[-1])
    got = {}
    for r in op2_additive_quantisation.digest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert listed[0].count() / len(want) < 0.03 * len(rows)  # of the index ranked again for a query
    exact = {(q, i): s for q, x in nearest(rows, 10**6).items() for i, s in x}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12, abs_tol=1e-12) for q, x in got.items() for i, s in x)


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 1.0]), (8, [2.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, []), (9, [0.0, -1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in op2_additive_quantisation.digest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == nearest([r for r in rows if r[0] is not None])
    assert op2_additive_quantisation.digest(table.where("false")).count() == 0


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_shards(request, table, monkeypatch):
    docs = request.getfixturevalue(table)
    rows = op6_uniform_shuffle.digest(docs).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    held = Counter(r["shard"] for r in rows)
    assert not rows or max(held.values()) - min(held.get(s, 0) for s in range(40)) <= 1
    for s in held:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(held[s]))
    again = op6_uniform_shuffle.digest(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_shards_of_many_blocks_and_parts(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id % 50) AS text")
    rows = op6_uniform_shuffle.shard(docs, 4, seed=3, block_rows=300).select("row.doc_id", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(5000))
    for s in range(4):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s)
        assert [x for x, _ in own] == list(range(1250))
        ids = np.array([i for _, i in own])
        assert abs(np.corrcoef(np.arange(1250), ids)[0, 1]) < 0.12 and abs(ids.mean() - 2500) < 200


def test_matrix_is_exact_and_hypergeometric():
    draws = np.array([op6_uniform_shuffle.communication_matrix([30, 50, 20], 4, s) for s in range(800)])
    assert (draws.sum(axis=2) == [30, 50, 20]).all() and (draws.sum(axis=1) == 25).all()
    mean, var = draws[:, 0, 0].mean(), draws[:, 0, 0].var()
    assert abs(mean - 7.5) < 0.3 and abs(var - 30 * 0.25 * 0.75 * 70 / 99) < 0.8


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir)
        if name == "toxicity":
            scores = op10_toxicity.digest(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert sorted(r["doc_id"] for r in scores.where("predicted = 0").collect()) == sorted(r["doc_id"] for r in out.collect())
        if name == "mixing":
            assert sorted(r["doc_id"] for r in op1_mixing.digest(kept).where("sampled").collect()) == sorted(r["doc_id"] for r in out.collect())
        if name == "suffix_array_dedup":
            rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
            lengths = {i: n - gone for i, n, gone, _, _ in brute.bytes_dedup(rows)}
            assert all(0 <= lengths[r["doc_id"]] - len((r["text"] or "").encode()) <= 8 * (lengths[r["doc_id"]] and 8) for r in out.collect())
            assert out.count() == kept.count()
        if name == "simhash_near_dedup":
            firsts = {c for _, _, c in brute.simhash_groups([tuple(r) for r in kept.select("doc_id", "text").collect()])}
            assert {r["doc_id"] for r in out.collect()} == firsts
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert out.count() > 0
        kept = out
    v = op7_byte_bpe.decode(kept.withColumnRenamed("text", "was"))
    assert v.where("was <> text").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "byte_bpe"]


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Every stage on nulls, ties, repeated rows, clashing names and an empty table."""
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int").selectExpr("doc_id", "quality", "quality AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.where("false")):
        kept = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            kept = stage(spark, kept, str(tmp_path))
            assert k == 4 or kept.columns == docs.columns
            kept.count()


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
