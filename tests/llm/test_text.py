"""Quality rules, tokens, language model and toxicity."""

from __future__ import annotations

import itertools
import math
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from brindle.llm import op5_quality_rules, op7_byte_bpe, op9_class_lm, op10_toxicity
from tests.llm import brute
from tests.llm.conftest import TEXTS, UNBROKEN


@pytest.fixture(scope="module")
def official():
    return tiktoken.Encoding("own", pat_str=op7_byte_bpe.public_pattern(), mergeable_ranks=op7_byte_bpe.read_ranks(op7_byte_bpe.default_path()), special_tokens={})


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_quality_measures_equal_sql(request, table):
    docs = request.getfixturevalue(table)
    unbroken = docs.where(F.col("text") == UNBROKEN)  # DuckDB's own replacing takes minutes on it
    assert [tuple(r)[1:7] for r in op5_quality_rules.digest(unbroken).collect()] == [(1, len(UNBROKEN), 0, 0, 0, True)] * (table == "odd")
    docs = docs.where(F.coalesce(F.col("text") != UNBROKEN, F.lit(True)))
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841  DuckDB reads it by name
    c = duckdb.connect()
    c.register("documents", documents)
    cursor = c.execute(op5_quality_rules.sql())
    columns = [x[0] for x in cursor.description]
    got = [tuple(r) for r in op5_quality_rules.digest(docs).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(cursor.fetchall(), key=repr)


def test_rules_are_data(odd):
    none = op5_quality_rules.judge(odd, (op5_quality_rules.Rule("no_words", "n_words", None, -1.0),))
    assert none.where("kept").count() == 0 and none.where("array_contains(failed_rules, 'no_words')").count() == odd.count()


@pytest.mark.parametrize("table", ["odd", "small"])
def test_tokens_equal_the_library(request, official, table):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = official.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((r["text"] or "").encode())))
    got = [tuple(r) for r in op7_byte_bpe.digest(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_classes_of_all_code_points():
    """Letters, numbers and spaces are those of the library, for every code point."""
    everything = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x <= 0xDFFF)
    letters, numbers = op7_byte_bpe.classes(0x10FFFF)
    for theirs, ours in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", op7_byte_bpe.SPACES)):
        plain = tiktoken.Encoding("class", pat_str=theirs, mergeable_ranks={bytes([x]): x for x in range(256)}, special_tokens={})
        assert plain.decode(plain.encode_ordinary(everything)) == "".join(re.findall(f"[{ours}]", everything))


def test_tokens_at_the_edges_of_classes(official):
    """Every code point at which a class begins or ends, and its neighbours, alone and beside others."""
    encoder = op7_byte_bpe.Encoder(op7_byte_bpe.read_ranks(op7_byte_bpe.default_path()))
    edges = {int(x, 16) for c in op7_byte_bpe.classes(0x10FFFF) for x in re.findall("U([0-9a-f]{8})", c)}
    points = sorted({min(max(x + d, 0), 0x10FFFF) for x in edges for d in (-1, 0, 1)} | set(range(0x3100)))
    for x in points:
        if not 0xD800 <= x <= 0xDFFF:
            c = chr(x)
            for text in (c, c + "'s", c + "1", " " + c, f"a{c} {c}{c}  b"):
                assert np.frombuffer(encoder.encode(text), "<u4").tolist() == official.encode_ordinary(text), hex(x)


def test_ids_decode_to_the_text(odd, empty):
    back = op7_byte_bpe.decode(op7_byte_bpe.encode(odd).withColumnRenamed("text", "was"))
    assert back.where("coalesce(was, '') <> text").count() == 0
    twice = op7_byte_bpe.encode(odd, decoded="kept")  # a column of this name is replaced
    assert twice.columns == [*[c for c in odd.columns if c not in ("ids", "kept")], "ids", "kept"]
    assert twice.where("kept <> sha2(coalesce(text, ''), 256)").count() == 0
    assert op7_byte_bpe.encode(empty).count() == 0 and op7_byte_bpe.digest(empty).count() == 0


def test_prefix_table_appends_and_edits(official):
    v = op7_byte_bpe.Vocabulary(op7_byte_bpe.read_ranks(op7_byte_bpe.default_path()))
    table = op7_byte_bpe.PrefixTable(v)
    text = b"internationalisation"
    table.append(text[:7])
    table.append(text[7:])
    for end in range(1, len(text) + 1):  # every prefix
        assert table.ids(end) == official._encode_single_piece(text[:end])
    table.edit(3, 6, b"XYzz")
    assert table.ids() == official._encode_single_piece(b"int" + b"XYzz" + text[6:])


@pytest.mark.parametrize("table", ["odd", "small"])
def test_language_model_base(request, table):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    plain = lambda rs: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rs), key=repr)
    scored = op9_class_lm.scored(docs).collect()
    assert plain([[r[c] for c in columns] for r in scored]) == plain(brute.base_lm(rows))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in scored)


@pytest.mark.parametrize("table", ["odd", "small"])
def test_language_model_score(request, table, monkeypatch):
    """Scores by plain counting over the model's classes; from any class, all words and the unseen share a sum of 1."""
    monkeypatch.setattr(op9_class_lm, "OWN", 300)
    docs = request.getfixturevalue(table)
    model, _ = op9_class_lm.fit(docs.select("doc_id", "text", (~op9_class_lm.held_out(F.col("doc_id"))).alias("train")))
    words = {r["h"]: (r["n"], r["class"]) for r in model.words.collect()}
    for h, c in zip(model.head.hashes.view(np.int64).tolist(), model.head_classes.tolist()):
        words[h] = (words[h][0], c)
    assert all(c is not None and c != op9_class_lm.REST_CLASS for _, c in words.values())
    emission = {h: math.log10(n + 0.1) - model.shared[c] for h, (n, c) in words.items()}
    left = 0.1 / 10 ** model.shared[model.unseen]
    inside = np.zeros(op9_class_lm.CLASSES)
    for h, (_, c) in words.items():
        inside[c] += 10 ** emission[h]
    inside[model.unseen] += left
    reach = 10**model.transitions
    used = inside > 0
    assert np.allclose(inside[used], 1)
    assert np.allclose(reach.sum(axis=1), 1)

    def hashes(text):
        data = np.frombuffer((text or "").encode().lower(), np.uint8)
        starts, ends, _ = op9_class_lm.symbols.words(data, np.array([0, len(data)]))
        return [*op9_class_lm.symbols.word_hashes(data, starts, ends).view(np.int64).tolist(), op9_class_lm.END_HASH]

    texts = [(r["doc_id"], hashes(r["text"])) for r in docs.select("doc_id", "text").collect()]
    pairs = np.zeros((op9_class_lm.CLASSES,) * 2)
    want = []
    for i, hs in texts:
        before = op9_class_lm.END_CLASS
        for h in hs:
            c = words.get(h, (0, model.unseen))[1]
            if i is None or brute.crc(i) % 10:
                pairs[before, c] += 1
            before = c
    live = op9_class_lm.CLASSES - 1
    for i, hs in texts:
        total, before = 0.0, op9_class_lm.END_CLASS
        for h in hs:
            n, c = words.get(h, (0, model.unseen))
            total += math.log10((pairs[before, c] + 0.1) / (pairs[before].sum() + 0.1 * live)) + math.log10(n + 0.1) - model.shared[c]
            before = c
        want.append((i, round(total, 4)))
    got = [(r["doc_id"], round(r["score"], 4)) for r in op9_class_lm.scored(docs).collect()]
    assert [i for i, _ in sorted(got, key=repr)] == [i for i, _ in sorted(want, key=repr)]
    assert all(math.isclose(a[1], b[1], rel_tol=1e-6, abs_tol=1e-3) for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)))


def test_rare_words_choose_by_their_contexts():
    """A word beyond the frequent ones goes to the class of words that stand in the same places."""
    pairs = np.full((op9_class_lm.CLASSES,) * 2, 1.0)
    pairs[3, 5], pairs[5, 3], pairs[4, 6], pairs[6, 4] = 900, 900, 800, 800
    around = pa.array([[{"around": 3 * op9_class_lm.CLASSES + 3, "n": 2}], [{"around": 6 * op9_class_lm.CLASSES + 6, "n": 1}]], pa.list_(pa.struct([("around", pa.int32()), ("n", pa.int64())])))
    out = list(op9_class_lm._choose(pairs)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), around], ["h", "contexts"])])))
    assert out[0].column("class").to_pylist() == [5, 4]


def test_classes_beat_single_words(spark, sf_dir):
    scored = op9_class_lm.scored(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)


def test_language_model_empty(empty):
    assert op9_class_lm.scored(empty).count() == 0


def auc(pairs):
    up, down = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


def test_toxicity_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = op10_toxicity.digest(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.9


def test_toxicity_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(20)] + [(3, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    out = op10_toxicity.digest(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    assert op10_toxicity.digest(empty, labels).count() == 0
    none = op10_toxicity.digest(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert op10_toxicity.keep_clean(odd, labels.where("false")).columns == odd.columns


def test_hits_near_a_second_person():
    words = "you are an idiot and then so many other words come before the next moron of them all but then ur clown stays".split()
    features = op10_toxicity.text_features(" ".join(words), {}, {})
    at = [i for i, w in enumerate(words) if w in op10_toxicity.INSULTS]
    you = [i for i, w in enumerate(words) if w in op10_toxicity.SECOND_PERSON]
    near = sum(min(abs(i - j) for j in you) <= op10_toxicity.NEAR for i in at)
    assert len(at) == 3 and near == 2 and math.isclose(features[4], 100 * near / len(words))
    assert len(op10_toxicity.text_features("you idiot " * 200_000, {}, {})) == 7  # in seconds, not hours


def plain_features(text: str | None, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    """op10's thirteen features, word by word and character by character."""
    text = text or ""
    raw, words = text.encode(), re.findall(r"[^\W_]+", text.lower())
    n, spaced = max(len(words), 1), max(1, text.count(" ") + 1)
    is_letter = lambda c: c.isalnum() and not re.fullmatch(r"\d", c)
    bad = [i for i, w in enumerate(words) if w in lexicon or w in op10_toxicity.INSULTS or w[:4] in stems or w[:5] in stems]
    you = [i for i, w in enumerate(words) if w in op10_toxicity.SECOND_PERSON]
    odd, i = [], 0
    while i < len(text):
        if not is_letter(text[i]):
            i += 1
            continue
        a = b = i
        while b < len(text) and is_letter(text[b]):
            b += 1
        c = b
        while c < len(text) and text[c] in "0123456789@$!*#":
            c += 1
        d = c
        while d < len(text) and is_letter(text[d]):
            d += 1
        i = d if b < c < d else b
        odd += [text[a:d]] if b < c < d else []
    plainer = [w.lower().translate(op10_toxicity.LOOKALIKES) for w in odd]
    stretched = sum(1 for c, g in itertools.groupby(text) if is_letter(c) and len(list(g)) >= 4)
    shouted = sum(1 for w in re.findall(r"\w+", text) if len(w) >= 3 and all("A" <= c <= "Z" for c in w))
    upper, letters = sum(65 <= b <= 90 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    size = max(len(raw), 1)
    return [
        100 * sum(w in op10_toxicity.INSULTS for w in words) / n, 100 * sum(w in lexicon for w in words) / n, 100 * sum(w[:4] in stems or w[:5] in stems for w in words) / n,
        max([lexicon.get(w, 0.0) for w in words] + [max(stems.get(w[:4], 0.0), stems.get(w[:5], 0.0)) for w in words], default=0.0),
        100 * sum(any(abs(i - j) <= op10_toxicity.NEAR for j in you) for i in bad) / n, upper / max(letters, 1), 100 * shouted / spaced,
        100 * sum(b in b"!?" for b in raw) / size, 100 * sum(b in b"#*$%&|<>@^~" for b in raw) / size, 100 * len(odd) / n,
        100 * sum(w in op10_toxicity.INSULTS or w in lexicon for w in plainer) / n, 100 * stretched / spaced, math.log1p(size),
    ]


def test_toxicity_features_equal_a_plain_version(spark):
    rng = random.Random(10)
    made = ["".join(rng.choice(["idiot ", "you ", "YOU", " ", "aaaa", "x", "Z", "1", "@", "$", "!", "_", "é", "漢", "stupi", "d", "\n", "mor0n "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts = [*made, *(t for t in TEXTS if len(t or "") < 10_000)]
    lexicon, stems = {"x": 1.5, "zzz": 0.5, "moron": 2.0}, {"stup": 0.7, "idiot"[:5]: 2.5}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.struct("text").alias("row"))
    got = {r["i"]: r["features"] for r in op10_toxicity.with_features(rows, lexicon, stems).select("i", "features").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_features(t, lexicon, stems)), t


@pytest.mark.parametrize("text", ["x" * 2_000_000, UNBROKEN, "1" * 2_000_000, "a1" * 1_000_000, "A" * 2_000_000 + "a", "a" + "!" * 2_000_000])
def test_toxicity_features_of_unbroken_texts_take_linear_time(text):
    began = time.perf_counter()
    op10_toxicity.text_features(text, {}, {})
    assert len(op10_toxicity.SHOUTED.findall(text)) + sum(1 for _ in op10_toxicity.STRETCHED.finditer(text)) <= 1
    assert time.perf_counter() - began < 20


def test_what_an_encoder_remembers_is_bounded_by_bytes(official, monkeypatch):
    encoder = op7_byte_bpe.Encoder(op7_byte_bpe.read_ranks(op7_byte_bpe.default_path()))
    monkeypatch.setattr(op7_byte_bpe, "KEPT_BYTES", 10_000)
    texts = [" ".join(f"{a}{b}" for a in "abcdefghij" for b in range(100)), "漢字" * 50_000, ("x" * 100_000 + " ") * 3 + "y", " ".join(["same", "same"])]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == official.encode_ordinary(text)
    kept = [*encoder._spaced.items(), *encoder._piece.items()]
    assert encoder.kept <= 10_000 and sum(len(k) + len(v) for k, v in kept) <= 10_000 and max(len(k) for k, _ in kept) <= op7_byte_bpe.KEPT_CHARS
