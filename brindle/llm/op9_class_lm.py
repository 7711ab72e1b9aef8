"""LM scoring by a class-based n-gram model: classes by exchange clustering, class transitions, word emissions.

P(w | before) = P(class(w) | class(before)) * P(w | class(w)). Every word of the training texts has a class of its
own choice. The most frequent words exchange classes one after the other, on the driver, while all others stand in
one class of the rest. Then every other word, however many there are, takes its class in Spark tasks: the one whose
class-by-class counts gain most by the word's contexts (to first order in its counts, which are small beside those
of a class). Words that were not seen in training go to the class with the most words seen once. Counts are exact,
over all training texts. Words are told apart by a 64-bit hash.

Counts and classes of the HEAD most frequent words are sent to every task; those of all other words are joined to
the texts that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import store, symbols

#: Bounds of what every task holds: words with a known count and class; classes. Words that exchange one by one.
HEAD, CLASSES, OWN = 65_534, 32, 8_192
#: Items are places in the head; then the end of a text, and any word beyond the head.
END_ITEM, TAIL_ITEM, END_HASH = HEAD, HEAD + 1, 1
END_CLASS, REST_CLASS = CLASSES - 1, CLASSES - 2
#: Exchange sweeps, each after counting all contexts anew.
SWEEPS = 3
WORD_ADD, CLASS_ADD = 0.1, 0.1
U64 = np.uint64


def held_out(doc_id: Column) -> Column:
    """Rows not learned from. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some texts of a batch: hashes of their words, A-Z lowered, and the first word of each text."""
    data, offsets = symbols.text_bytes(batch.column("text"))
    for a, b in symbols.groups_of(offsets, symbols.PIECE):
        part = data[offsets[a] : offsets[b]]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part).astype(np.uint8)
        starts, ends, first = symbols.words(part, offsets[a : b + 1] - offsets[a])
        yield a, b, symbols.word_hashes(part, starts, ends), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = texts = 0

    def rows() -> pa.RecordBatch:
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["h", "n"])

    for batch in batches:
        texts += batch.num_rows
        for _, _, hashes, _ in _pieces(batch):
            held.append(hashes)
            size += len(hashes)
            if size > 1_500_000:
                yield rows()
                held, size = [], 0
    if texts:
        held.append(np.full(texts, END_HASH, U64))
        yield rows()


@dataclass(frozen=True)
class Known:
    """The head of the vocabulary, the most frequent first: hashes and counts; and the places of sorted hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    order: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes (0 if absent), and whether they are there."""
        if not len(self.order):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.order[np.minimum(np.searchsorted(self.hashes, hashes, sorter=self.order), len(self.order) - 1)]
        return at, self.hashes[at] == hashes


def _encode(known: Known, end_count: int):
    """Texts as items; sums over words of the head; the words beyond it (in order of their hashes), how often each
    stands in the text, and which of them stand there, one after the other."""
    logs = np.log10(known.counts + WORD_ADD)
    names = ["_n", "doc_id", "train", "items", "tails", "n_tokens", "head_known", "head_log", "tail_h", "tail_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, first in _pieces(batch):
                at, there = known.find(hashes)
                items = np.where(there, at, TAIL_ITEM).astype(np.uint16)
                totals = np.concatenate(([0.0], np.cumsum(np.where(there, logs[at] if len(logs) else 0.0, 0.0))))
                found = np.concatenate(([0], np.cumsum(there)))
                head_log = totals[first[1:]] - totals[first[:-1]] + np.log10(end_count + WORD_ADD)
                head_known = found[first[1:]] - found[first[:-1]] + (end_count > 0)
                rest = np.flatnonzero(~there)
                text = np.searchsorted(first, rest, "right") - 1
                order = np.lexsort((hashes[rest], text))
                t, h = text[order], hashes[rest][order]
                new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])))) if len(t) else np.zeros(0, np.int64)
                cuts = pa.array(np.searchsorted(t[new], np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (h[new].view(np.int64), np.diff(np.concatenate((new, [len(t)]))))]
                closed = [np.append(items[first[i] : first[i + 1]], np.uint16(END_ITEM)).tobytes() for i in range(b - a)]
                which = np.empty(len(t), np.int64)
                which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(t))))
                which -= np.searchsorted(t[new], text)
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)), pa.array(which.astype(np.int32)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_n"), part.column("doc_id"), part.column("train"), pa.array(closed, pa.binary()), tails,
                     pa.array(np.diff(first) + 1, pa.int64()), pa.array(head_known, pa.int64()), pa.array(head_log), *lists], names,
                )

    return run, "_n long, doc_id long, train boolean, items binary, tails array<int>, n_tokens long, head_known long, head_log double, tail_h array<long>, tail_n array<long>"


def _binary(batch: pa.RecordBatch, column: str, kind) -> np.ndarray:
    return np.frombuffer(symbols.text_bytes(batch.column(column))[0].tobytes(), kind)


def _contexts(class_of: np.ndarray):
    """Counts of (frequent word, side, class beside it), as (cell, n): words are items up to OWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(OWN * 2 * CLASSES, np.int64)
        for batch in batches:
            items = _binary(batch, "items", np.uint16).astype(np.int64)
            if len(items):
                kinds = class_of[items]
                own = items < OWN
                ahead = np.concatenate(([END_CLASS], kinds[:-1]))
                after = np.concatenate((kinds[1:], [END_CLASS]))
                total += np.bincount(items[own] * 2 * CLASSES + after[own], minlength=len(total))
                total += np.bincount(items[own] * 2 * CLASSES + CLASSES + ahead[own], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    return run


def _pairs_of(kinds_of):
    """Counts of pairs of neighbouring classes, as (cell, n); kinds_of(batch): classes of all tokens, texts end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            kinds = kinds_of(batch).astype(np.int64)
            total += np.bincount(np.concatenate(([END_CLASS], kinds[:-1]))[: len(kinds)] * CLASSES + kinds, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    return run


def _counted(rows: DataFrame, f, *shape: int) -> np.ndarray:
    """Cells summed over all tasks: as many numbers at most, whatever the input, come to the driver."""
    got = store.map_arrow(rows, f, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(classes: np.ndarray, contexts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """One sweep over frequent words, the most frequent first: each goes to the class that makes the text likeliest.

    contexts[word, 0, c]: how often class c follows; [word, 1, c]: how often it precedes. pairs: of all tokens.
    """
    classes, pairs = classes.copy(), pairs.copy()
    size = pairs.sum(axis=1)
    for w in range(len(classes)):
        r, p = contexts[w]
        n = r.sum()
        if not n:
            continue
        a = classes[w]
        pairs[a] = np.maximum(pairs[a] - r, 0)
        pairs[:, a] = np.maximum(pairs[:, a] - p, 0)
        size[a] -= n
        gain = (_xlogx(pairs + r) - _xlogx(pairs)).sum(axis=1) + (_xlogx(pairs + p[:, None]) - _xlogx(pairs)).sum(axis=0) - 2 * (_xlogx(size + n) - _xlogx(size))
        gain[[END_CLASS, REST_CLASS]] = -np.inf
        b = int(np.argmax(gain)) if gain.max() > gain[a] else a
        pairs[b] += r
        pairs[:, b] += p
        size[b] += n
        classes[w] = b
    return classes


def _other_contexts(class_of: np.ndarray, hashes: np.ndarray):
    """For every occurrence of a word that has no class yet: its hash and the classes around it, counted in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = _binary(batch, "items", np.uint16).astype(np.int64)
            if not len(items):
                continue
            kinds = class_of[items]
            at = np.flatnonzero(kinds == REST_CLASS)
            words = np.zeros(len(at), U64)
            head = items[at] < HEAD
            words[head] = hashes[items[at][head]]
            tails, kinds_of = batch.column("tails"), batch.column("tail_h")
            low = np.repeat(kinds_of.offsets.to_numpy()[:-1], np.diff(tails.offsets.to_numpy()))
            words[~head] = kinds_of.values.to_numpy()[low + tails.values.to_numpy()].view(U64)
            around = np.where(at > 0, kinds[at - 1], END_CLASS) * CLASSES + kinds[np.minimum(at + 1, len(kinds) - 1)]
            order = np.lexsort((around, words))
            w, x = words[order], around[order]
            new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])))) if len(w) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w[new].view(np.int64)), pa.array(x[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(w))))], ["h", "around", "n"])

    return run


def _choose(pairs: np.ndarray):
    """The class that gains most by a word's contexts, to first order in its counts."""
    after, ahead = np.log(pairs + 0.5), np.log(pairs.T + 0.5)  # [class, class beside it]
    size = np.log(pairs.sum(axis=1) + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around, n = batch.column("contexts").values.field("around").to_numpy(), batch.column("contexts").values.field("n").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("contexts").offsets.to_numpy()))
            beside = np.zeros((2, batch.num_rows, CLASSES))
            np.add.at(beside[0], (row, around // CLASSES), n)
            np.add.at(beside[1], (row, around % CLASSES), n)
            gain = beside[0] @ ahead.T + beside[1] @ after.T - 2 * beside[0].sum(axis=1)[:, None] * size
            gain[:, [END_CLASS, REST_CLASS]] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(gain.argmax(axis=1).astype(np.int32))], ["h", "class"])

    return run


@dataclass(frozen=True)
class Model:
    """words: h, n, class of every word of the training texts and of the end; log10 of transitions, and of what a
    class's words share (a word's emission is its count and WORD_ADD over it); the class of unseen words."""

    words: DataFrame
    head: Known
    head_classes: np.ndarray
    transitions: np.ndarray
    shared: np.ndarray
    unseen: int
    train_tokens: int
    distinct: int


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and all rows (doc_id, text, train) with their classes: _n and the counts that scores need.

    Without any training text all counts are zero.
    """
    counts = store.map_arrow(rows.where("train").select("text"), _count, "h long, n long")
    counts = store.table(counts.groupBy("h").agg(F.sum("n").alias("n")), "counts")
    train_tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("h") == END_HASH, F.col("n"))), F.lit(0))).first()
    by_count = [F.desc("n"), F.col("h")]
    head = counts.where(F.col("h") != END_HASH).orderBy(*by_count).limit(HEAD).toArrow()  # HEAD rows at most
    hashes = head.column("h").to_numpy().view(U64)
    known = Known(hashes, head.column("n").to_numpy(), np.argsort(hashes))
    f, schema = _encode(known, ends)
    encoded = store.table(store.map_arrow(rows.withColumn("_n", F.monotonically_increasing_id()), f, schema), "encoded")
    train = encoded.where("train")

    class_of = np.full(HEAD + 2, REST_CLASS)
    class_of[END_ITEM] = END_CLASS
    own = min(OWN, len(hashes))
    class_of[:own] = np.arange(own) % (CLASSES - 2)
    by_item = lambda c: lambda batch: c[_binary(batch, "items", np.uint16)]
    for _ in range(SWEEPS):
        contexts = _counted(train.select("items"), _contexts(class_of), OWN, 2, CLASSES)
        pairs = _counted(train.select("items"), _pairs_of(by_item(class_of)), CLASSES, CLASSES)
        class_of[:own] = exchange(class_of[:own], contexts[:own], pairs)
    pairs = _counted(train.select("items"), _pairs_of(by_item(class_of)), CLASSES, CLASSES)

    around = store.map_arrow(train.select("items", "tails", "tail_h"), _other_contexts(class_of, hashes), "h long, around int, n long")
    around = around.repartition("h").groupBy("h", "around").agg(F.sum("n").alias("n"))  # at most CLASSES**2 rows of a word; one shuffle, by word, for both groupings
    around = around.groupBy("h").agg(F.collect_list(F.struct("around", "n")).alias("contexts"))
    chosen = store.map_arrow(around, _choose(pairs), "h long, class int")
    words = counts.join(chosen, "h", "left").withColumn("class", F.when(F.col("h") == END_HASH, END_CLASS).otherwise(F.col("class")))
    words = store.table(words, "words")  # class is null for the words that exchanged
    store.drop(counts)
    rest = words.where(F.col("h") != END_HASH).orderBy(*by_count).limit(HEAD).select("class").toArrow().column("class").to_numpy(zero_copy_only=False)
    class_of[own : len(hashes)] = rest[own:]
    stats = words.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).toArrow()
    v, n, once = (np.bincount(stats.column("class").to_numpy(), stats.column(k).to_numpy(), CLASSES) for k in ("v", "n", "once"))
    v += np.bincount(class_of[:own], minlength=CLASSES)
    n += np.bincount(class_of[:own], known.counts[:own], CLASSES)
    v[END_CLASS] = 1
    once[[END_CLASS, REST_CLASS]] = -1
    unseen = int(np.argmax(once))
    shared = np.log10(np.maximum(n + WORD_ADD * (v + (np.arange(CLASSES) == unseen)), WORD_ADD))

    classed = store.table(_classed(encoded, words, class_of, unseen), "classed")
    store.drop(encoded)
    pairs = _counted(classed.where("train").select("kinds"), _pairs_of(lambda batch: _binary(batch, "kinds", np.uint8)), CLASSES, CLASSES)
    live = np.ones(CLASSES, bool)
    live[REST_CLASS] = False  # no word is left in it
    transitions = np.where(live, np.log10((pairs + CLASS_ADD) / (pairs.sum(axis=1, keepdims=True) + CLASS_ADD * live.sum())), -np.inf)
    return Model(words, known, class_of[: len(hashes)], transitions, shared, unseen, int(train_tokens), int(distinct)), classed


def _classed(encoded: DataFrame, words: DataFrame, class_of: np.ndarray, unseen: int) -> DataFrame:
    """Texts as classes of their tokens, and the sums over all words."""
    tail = encoded.select("_n", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("x")).select("_n", F.col("x.tail_h").alias("h"), F.col("x.tail_n").alias("k"))
    tail = tail.join(words.select("h", "n", "class"), "h", "left").groupBy("_n").agg(
        F.collect_list(F.struct("h", F.coalesce("class", F.lit(unseen)).alias("class"))).alias("tail"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + WORD_ADD)).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("tail_known"),
    )
    joined = encoded.drop("tail_h", "tail_n").join(tail, "_n", "left").withColumns(
        {"words_log": F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)), "n_known": F.col("head_known") + F.coalesce("tail_known", F.lit(0))}
    )
    names = ["_n", "doc_id", "train", "n_tokens", "n_known", "words_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = symbols.text_bytes(batch.column("items"))
            kinds = class_of[np.frombuffer(data.tobytes(), np.uint16)].astype(np.uint8)
            items = np.frombuffer(data.tobytes(), np.uint16)
            places, tails = batch.column("tails").offsets.to_numpy(), batch.column("tails").values.to_numpy()
            lists = batch.column("tail")
            cuts, h, c = lists.offsets.to_numpy(), lists.values.field("h").to_numpy(), lists.values.field("class").to_numpy()
            for i in range(batch.num_rows):
                if places[i + 1] > places[i]:
                    own = c[cuts[i] : cuts[i + 1]][np.argsort(h[cuts[i] : cuts[i + 1]].view(U64))]
                    low = offsets[i] // 2
                    kinds[low + np.flatnonzero(items[low : offsets[i + 1] // 2] == TAIL_ITEM)] = own[tails[places[i] : places[i + 1]]]
            parts = [kinds[offsets[i] // 2 : offsets[i + 1] // 2].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(parts, pa.binary())], [*names, "kinds"])

    return store.map_arrow(joined.select(*names, "items", "tails", "tail"), run, "_n long, doc_id long, train boolean, n_tokens long, n_known long, words_log double, kinds binary")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs.

    Null and empty texts have one token, the end. Repeated rows are learned from, and scored, each by itself.
    perplexity is that of the class model, for each token of the text.
    """
    model, classed = fit(docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train")))
    step = model.transitions - model.shared  # of entering a class and leaving by one of its words
    names = ["doc_id", "train", "n_tokens", "n_known", "words_log", "walk"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = symbols.text_bytes(batch.column("kinds"))
            before = np.concatenate(([END_CLASS], data[:-1]))[: len(data)]  # each text follows an end
            total = np.add.reduceat(step[before, data], offsets[:-1]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:-1]), pa.array(total)], names)

    walked = store.map_arrow(classed.select("doc_id", "train", "n_tokens", "n_known", "words_log", "kinds"), walk, "doc_id long, train boolean, n_tokens long, n_known long, words_log double, walk double")
    score = F.col("words_log") + F.col("walk")
    return walked.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("words_log") - F.col("n_tokens") * F.lit(float(np.log10(model.train_tokens + WORD_ADD * (model.distinct + 1))))).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
