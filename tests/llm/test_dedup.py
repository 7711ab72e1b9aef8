"""Substring and near dedup against brute force."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import components, op3_lempel_ziv, op4_suffix_array, op8_simhash, repeats, symbols
from tests.llm import brute

ops = {
    "op3": (op3_lempel_ziv.digest, brute.windows_dedup, ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    "op4": (op4_suffix_array.digest, brute.bytes_dedup, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "op8": (op8_simhash.digest, brute.simhash_groups, ["doc_id", "fingerprint", "component_id"]),
}


@pytest.mark.parametrize("name", sorted(ops))
@pytest.mark.parametrize("table", ["odd", "small"])
def test_equals_brute_force(request, name, table):
    docs = request.getfixturevalue(table)
    run, plain, columns = ops[name]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in run(docs).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("name", sorted(ops))
def test_empty_table(empty, name):
    run, _, columns = ops[name]
    out = run(empty)
    assert out.columns == columns and out.count() == 0


def test_many_contents_of_one_anchor(spark, monkeypatch):
    """Anchors of many contents that lie across several partitions."""
    for op in (op3_lempel_ziv, op4_suffix_array):
        monkeypatch.setattr(op, "PER_TASK", 7)
    common = " ".join(brute.WORDS)
    rows = [(i, f"left {i % 9} {i % 4} " + common + f" right {i % 5} " + " ".join(f"t{(i % 6) * j}" for j in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("op3", "op4"):
        run, plain, columns = ops[name]
        assert sorted(tuple(r) for r in run(docs).select(*columns).collect()) == sorted(plain(rows))


def test_dedup_keeps_columns_and_rows(odd):
    cut = op4_suffix_array.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert cut.where("text is null").count() == 1
    one = op8_simhash.dedup(odd)
    assert one.columns == odd.columns
    kinds = {x for _, _, x in brute.simhash_groups([tuple(r) for r in odd.select("doc_id", "text").collect()])}
    assert one.count() == len(kinds)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.data())
def test_links_within_three_bits_share_a_cell(fps, data):
    masks = op8_simhash.grid_masks()
    for x in fps:
        y = x
        for _ in range(data.draw(st.integers(0, 3))):
            y ^= 1 << data.draw(st.integers(0, 63))
        count = lambda f: ((f >> 1) & f & op8_simhash.LOW_BITS) << 1 | ((f >> 1 ^ f) & op8_simhash.LOW_BITS)
        assert any(count(x) & m == count(y) & m for m in masks)


def test_spanning_forest_of_near_fingerprints():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 20), dtype=np.uint64)))
    a, b = op8_simhash._tree(fps)
    assert len(a) < len(fps) and all(int(x ^ y).bit_count() <= 3 for x, y in zip(a, b))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and len(got) == 203


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=6), max_size=20))
def test_multikey_quicksort(rows):
    keys = np.array([r + [9] * (6 - len(r)) for r in rows], np.uint64).reshape(len(rows), 6)
    order = op4_suffix_array.multikey_quicksort(keys)
    assert keys[order].tolist() == sorted(keys.tolist())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=8))
def test_words_of_texts(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    starts, ends, first = symbols.words(data, offsets)
    got = [[data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] for i in range(len(texts))]
    assert got == [brute.SPACE.findall(t) for t in texts]


def test_factors_of_a_known_text():
    """The longest run that any reference block holds, then the windows across its end."""
    reference = op3_lempel_ziv.Reference(3)
    for block in (b"a b c d e x", b"q d e f g h", b"b c d z"):
        reference.add(block, *op3_lempel_ziv.word_places(block))
    text = b"a b c d e f g y b c d z w"
    assert op3_lempel_ziv.parse(text, *op3_lempel_ziv.word_places(text), reference) == [(0, 5), (3, 7), (8, 12)]
    assert op3_lempel_ziv.parse(b"a b", *op3_lempel_ziv.word_places(b"a b"), reference) == []


def _blocks_of(texts, at):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    n = np.array([len(t) - 199 for t in texts])
    zero = np.zeros(len(texts), np.int64)
    return repeats.Blocks(raw, offsets, zero, np.arange(len(texts)), np.arange(len(texts)), zero, zero, n, np.full(len(texts), at))


def test_suffix_order_decides(monkeypatch):
    """Neighbours in sorted order are all that is compared: in another order strings would be missed."""
    rng = np.random.default_rng(2)
    gram, tails, heads = b"anchor" + b"." * 34, [rng.bytes(150) for _ in range(6)], [rng.bytes(60) for _ in range(6)]
    texts = [heads[int(a)] + gram + tails[int(b)][: int(c)] + rng.bytes(150 - int(c)) for a, b, c in zip(rng.integers(0, 6, 80), rng.integers(0, 6, 80), rng.integers(60, 150, 80))]
    blocks = _blocks_of(texts, 60)
    blocks = repeats.Blocks(**{**blocks.__dict__, "n": np.full(len(texts), 51)})  # windows that hold the anchor
    row, i, _, _ = op4_suffix_array._judge(200, 40)(blocks)
    count = {}
    for t in texts:
        for s in range(51):
            count[s, t[s : s + 200]] = count.get((s, t[s : s + 200]), 0) + 1
    want = {(r, s) for r, t in enumerate(texts) for s in range(51) if count[s, t[s : s + 200]] > 1}
    assert len(row) == len(want) > 50 and set(zip(row.tolist(), i.tolist())) == want
    monkeypatch.setattr(op4_suffix_array, "multikey_quicksort", lambda keys: np.arange(len(keys)))
    assert len(op4_suffix_array._judge(200, 40)(blocks)[0]) < len(want)


def test_long_periodic_texts(spark):
    """A periodic stretch is one row of anchors, however long."""
    for period in (b"a", b"abcdefg"):
        syms, first = repeats.byte_units(np.frombuffer(period * (2_000_000 // len(period)), np.uint8), np.array([0, 2_000_000 // len(period) * len(period)]))
        rows = symbols.anchors(syms, first, 200, 40)
        assert len(rows["n"]) < 40 and int((rows["n"] * rows["times"]).sum()) == len(syms) - 199
    texts = ["a" * 2_000_000, "abcdefg" * 100_000, "a " * 300_000, "b c d " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op4_suffix_array.digest(docs).collect()}
    assert all(r["n_removed"] == r["n_bytes"] == len(texts[i]) and r["n_spans"] == 1 for i, r in got.items())
    got = {r["doc_id"]: r for r in op3_lempel_ziv.digest(docs).collect()}
    assert [got[i]["n_words"] - got[i]["n_removed"] for i in range(4)] == [1, 1, 1, 3]


def test_reference_of_long_words_takes_little_more_than_its_blocks():
    word = lambda b, i: (f"{b if i % 9 == 0 else 0}-{i}-" * 2000)[:20_000].encode()
    blocks = [b" ".join(word(b, i) for i in range(35)) for b in range(25)]
    placed = [(x, *op3_lempel_ziv.word_places(x)) for x in blocks]
    tracemalloc.start()
    reference = op3_lempel_ziv.Reference(20)
    for x in placed:
        reference.add(*x)
    assert tracemalloc.get_traced_memory()[1] < 30e6  # the blocks are 17 MB, and not copied
    tracemalloc.stop()
    assert reference.longest(*placed[3], 2) == 33 and op3_lempel_ziv.parse(*placed[7], reference) == [(0, 35)]


def test_a_run_of_equal_hash_and_other_bytes_is_no_factor(monkeypatch):
    monkeypatch.setattr(op3_lempel_ziv, "hash", lambda x: 7, raising=False)
    reference = op3_lempel_ziv.Reference(2)
    for block in (b"a b c d", b"x y z"):
        reference.add(block, *op3_lempel_ziv.word_places(block))
    assert reference.longest(b"q r s", *op3_lempel_ziv.word_places(b"q r s"), 0) == 0


def test_near_copies_of_long_words(spark):
    word = lambda b, i: (f"{b}.{i}" if i == 50 else str(i)) * 4000
    docs = spark.createDataFrame([(b, " ".join(word(b, i) for i in range(100))) for b in range(8)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in op3_lempel_ziv.digest(docs).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, 8), 99)
