"""Hard negatives by threshold joins in the manner of L2AP.

Scores are inner products of integer vectors. A window asks for the first k rows, by falling score, that lie between
a low and a high score and have the anchor's label (positives) or another one (negatives). A task holds a chunk of
rows as an inverted index, dimension by dimension. Of a row only its leading dimensions are indexed: the norms of what
is left of it and of the anchors prove that the rest alone cannot reach any threshold. Partial scores are accumulated
from the index; a pair whose partial score and remaining norms stay below the anchor's threshold is dropped, and only
what is left is scored in full.

Thresholds start high, from a sample of rows, and are lowered for the windows that did not fill: first to a score that
k rows of the sample reach, then to the window's own low end. So the sample decides how much is read, never what is
found. A task's own k best raise its thresholds as it goes on, and no more than they leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brindle.llm import store

#: Components become floor(SCALE * x). Rows of a greater squared norm have scores beyond a long.
SCALE, MOST_NORM = 256, 2.0**61
#: Positives of an anchor; negatives of a positive; and, in hundredths of its score, what a negative's may be.
POSITIVES, NEGATIVES, FROM, TO = 5, 10, 30, 90
#: Rows that first thresholds are taken from; rows aimed at by the first, as a multiple of k.
SAMPLE, MARGIN = 4096, 4
#: Anchors sent to all tasks at a time (about); anchors and rows scored at a time; dimensions between two prunings.
ANCHORS, BLOCK, ROWS, STEP = 8192, 256, 4096, 8
#: Below this share of a group's pairs, those left are scored one by one.
FEW = 1 / 16


@dataclass(frozen=True)
class Rows:
    """Keys, labels and integer vectors."""

    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def take(self, at) -> Rows:
        return Rows(self.ids[at], self.keys[at], self.labels[at], self.vectors[at])


@dataclass(frozen=True)
class Windows:
    """Of anchors (by their place, in order): what is asked for, from `low` to `high`, reported with tag and tag_score."""

    owner: np.ndarray
    tag: np.ndarray
    tag_score: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, at) -> Windows:
        return Windows(*(getattr(self, k)[at] for k in ("owner", "tag", "tag_score", "low", "high")))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Not null or empty, every component a finite number, and inner products that fit a long."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0)
    norm = F.aggregate(quantised(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(fine, F.lit(False)) & F.coalesce(norm < MOST_NORM, F.lit(False))


def as_rows(table: pa.Table | pa.RecordBatch, d: int) -> Rows:
    """Rows of columns vec_id, key, label, q."""
    q = table.column("q")
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    return Rows(*(table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy() for k in ("vec_id", "key", "label")), q.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def edges(d: int) -> np.ndarray:
    """Where the groups of dimensions start, and the end."""
    return np.append(np.arange(0, d, STEP), d)


def suffix_norms(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from each of the edges on (the last is 0)."""
    squares = x.astype(np.float64) ** 2
    sums = np.stack([squares[:, a:b].sum(axis=1) for a, b in zip(at[:-1], at[1:])], axis=1)
    left = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((left, np.zeros((len(x), 1))), axis=1))


class Index:
    """Inverted index of a chunk of rows for a block of anchors and their thresholds.

    A row's entries end at its cut, an edge from which on its norm, times that of any anchor over the anchor's
    threshold, stays below 1. Rows are held by falling cut, so a dimension's list is a stretch from the first row on.
    """

    def __init__(self, x: np.ndarray, norms: np.ndarray, anchor_norms: np.ndarray, thresholds: np.ndarray, at: np.ndarray) -> None:
        self.at = at
        if (thresholds > 0).all():
            reach = (anchor_norms / thresholds[:, None]).max(axis=0)
            cut = (norms * reach[None, :] < 1 - 1e-9).argmax(axis=1)
        else:  # a threshold that no norm excludes
            cut = np.full(len(x), len(at) - 1)
        self.order = np.argsort(-cut, kind="stable")
        self.cut, self.x, self.norms = cut[self.order], x[self.order], norms[self.order]
        self.lists = [int((self.cut > g).sum()) for g in range(len(at) - 1)]  # rows with entries in each group of dimensions

    def accumulate(self, anchors: np.ndarray) -> np.ndarray:
        """Partial scores (anchors, rows that are in the index) from all entries."""
        total = np.zeros((len(anchors), self.lists[0]), self.x.dtype)
        for g, n in enumerate(self.lists):
            if n:
                total[:, :n] += anchors[:, self.at[g] : self.at[g + 1]] @ self.x[:n, self.at[g] : self.at[g + 1]].T
        return total


def join(anchors: np.ndarray, anchor_norms: np.ndarray, index: Index, thresholds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, rows (as given to the index) and scores of all wanted pairs that reach their anchor's threshold.

    wanted: (anchors, rows) of bool, in the order that the rows were given.
    """
    least = thresholds - 1 - 1e-9 * np.abs(thresholds)
    partial, n = index.accumulate(anchors), index.lists[0]
    cut, at, norms = index.cut[:n], index.at, index.norms[:n]
    alive = partial + anchor_norms[:, cut] * norms[np.arange(n), cut] >= least[:, None]
    alive &= wanted[:, index.order[:n]]
    out = []
    for c in np.unique(cut):
        low, high = np.searchsorted(-cut, [-c, -c + 1])
        a, r = np.nonzero(alive[:, low:high])
        if not len(a):
            continue
        if len(a) > FEW * alive[:, low:high].size:
            rest = anchors[:, at[c] :] @ index.x[low:high, at[c] :].T if at[c] < at[-1] else 0
            score = (partial[:, low:high] + rest)[a, r]
        else:
            score = partial[a, low + r]
            for g in range(c, len(at) - 1):
                kept = score + anchor_norms[a, g] * norms[low + r, g] >= least[a]
                a, r, score = a[kept], r[kept], score[kept]
                score = score + (anchors[a, at[g] : at[g + 1]] * index.x[low + r, at[g] : at[g + 1]]).sum(axis=1)
        kept = score >= thresholds[a]
        out.append((a[kept], index.order[low + r[kept]], score[kept]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, anchors.dtype)
    return tuple(np.concatenate(x) for x in zip(*out))


class Best:
    """The first k rows of each window so far, and the threshold that they set for it."""

    def __init__(self, windows: Windows, thresholds: np.ndarray, k: int) -> None:
        self.windows, self.thresholds, self.k = windows, thresholds.copy(), k
        self.first = np.searchsorted(windows.owner, np.arange(windows.owner.max() + 2 if len(windows.owner) else 1))
        none = np.zeros(0, np.int64)
        self.held = (none, none, none, none)  # window, score, id, key

    def of_anchors(self, n: int) -> np.ndarray:
        """The least threshold of each anchor's windows; infinity for those without any."""
        out = np.full(n, np.inf)
        np.minimum.at(out, self.windows.owner, self.thresholds)
        return out

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        count = self.first[anchor + 1] - self.first[anchor]
        pair = np.repeat(np.arange(len(anchor)), count)
        window = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + self.first[anchor][pair]
        fits = (score[pair] <= self.windows.high[window]) & (score[pair] >= self.thresholds[window])
        pair, window = pair[fits], window[fits]
        if not len(pair):
            return
        window, score, ids, keys = (np.concatenate(x) for x in zip(self.held, (window, score[pair].astype(np.int64), ids[pair], keys[pair])))
        order = np.lexsort((keys, ids, -score, window))
        window, score, ids, keys = window[order], score[order], ids[order], keys[order]
        start = np.searchsorted(window, window)
        rank = np.arange(len(window)) - start
        full = rank == self.k - 1
        self.thresholds[window[full]] = np.maximum(self.thresholds[window[full]], score[full])
        self.held = tuple(x[rank < self.k] for x in (window, score, ids, keys))


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Rows]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(a, ROWS))
            if sum(b.num_rows for b in held) >= ROWS:
                yield as_rows(pa.Table.from_batches(held), d)
                held = []
    if held:
        yield as_rows(pa.Table.from_batches(held), d)


FOUND = "anchor_id long, anchor_key long, slot int, tag long, tag_score long, vec_id long, key long, score long"


def _search(anchors: Rows, windows: Windows, slots: np.ndarray, thresholds: np.ndarray, k: int, same: bool, dims: np.ndarray, exact: type):
    """The first k rows of each window in a task."""
    d = len(dims)
    at = edges(d)
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for low in range(0, len(anchors.ids), BLOCK):
            part = anchors.take(slice(low, low + BLOCK))
            mine = slice(*np.searchsorted(windows.owner, [low, low + BLOCK]))
            own = windows.take(mine)
            vectors = part.vectors[:, dims].astype(exact)
            blocks.append((part, vectors, suffix_norms(vectors, at), Best(replace(own, owner=own.owner - low), thresholds[mine], k), mine.start))
        for rows in _chunks(batches, d):
            x = np.ascontiguousarray(rows.vectors[:, dims]).astype(exact)
            norms = suffix_norms(x, at)
            for part, vectors, anchor_norms, best, _ in blocks:
                limits = best.of_anchors(len(part.ids))
                asked = np.flatnonzero(limits < np.inf)
                if not len(asked):
                    continue
                wanted = (part.labels[asked, None] == rows.labels[None, :]) == same
                wanted &= (part.ids[asked, None] != rows.ids[None, :]) | (part.keys[asked, None] != rows.keys[None, :])
                index = Index(x, norms, anchor_norms[asked], limits[asked], at)
                a, r, score = join(vectors[asked], anchor_norms[asked], index, limits[asked], wanted)
                best.add(asked[a], score, rows.ids[r], rows.keys[r])
        for part, _, _, best, first in blocks:
            window, score, ids, keys = best.held
            if len(window):
                own, owner = best.windows, best.windows.owner[window]
                columns = (part.ids[owner], part.keys[owner], slots[first + window].astype(np.int32), own.tag[window], own.tag_score[window], ids, keys, score)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def first_thresholds(anchors: Rows, windows: Windows, sample: Rows, share: float, k: int, same: bool, exact: type) -> tuple[np.ndarray, np.ndarray]:
    """For each window a score that about MARGIN * k of all rows may reach, and one that k rows of the sample do (else low).

    share: of all rows, those in the sample.
    """
    high, sure = windows.low.astype(np.float64), windows.low.astype(np.float64)
    aim = MARGIN * k * share  # the rank in the sample that is aimed at
    for a in range(0, len(anchors.ids), BLOCK):
        part = anchors.take(slice(a, a + BLOCK))
        scores = part.vectors.astype(exact) @ sample.vectors.astype(exact).T
        fits = ((part.labels[:, None] == sample.labels[None, :]) == same) & ((part.ids[:, None] != sample.ids[None, :]) | (part.keys[:, None] != sample.keys[None, :]))
        for w in range(*np.searchsorted(windows.owner, [a, a + BLOCK])):
            own = scores[windows.owner[w] - a][fits[windows.owner[w] - a]]
            own = np.sort(own[(own >= windows.low[w]) & (own <= windows.high[w])])[::-1].astype(np.float64)
            if not len(own):
                continue
            if len(own) >= k:
                sure[w] = own[k - 1]
            if aim >= 1:
                high[w] = own[min(int(np.ceil(aim)), len(own)) - 1]
            elif np.isfinite(windows.high[w]):
                high[w] = windows.high[w] - (windows.high[w] - own[0]) * aim
            else:  # an exponential tail beyond the sample's best
                top = own[:k]
                high[w] = own[0] + (top - top[-1]).mean() * np.log(1 / aim)
    return np.maximum(high, sure), sure


def fill(rows: DataFrame, anchors: Rows, windows: Windows, slots: np.ndarray, sample: Rows, share: float, k: int, same: bool, dims: np.ndarray, exact: type) -> list[DataFrame]:
    """Tables of FOUND with rank: the first k rows of every window, threshold after threshold until all are filled."""
    high, sure = first_thresholds(anchors, windows, sample, share, k, same, exact)
    open_, out = np.arange(len(windows.owner)), []
    for thresholds in (high, sure, windows.low.astype(np.float64)):
        if not len(open_):
            break
        asked, inverse = np.unique(windows.owner[open_], return_inverse=True)
        f = _search(anchors.take(asked), replace(windows.take(open_), owner=inverse), slots[open_], thresholds[open_], k, same, dims, exact)
        found = store.map_arrow(rows, f, FOUND)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "vec_id", "key"))
        found = store.table(found.withColumn("rank", rank).where(F.col("rank") <= k), "windows")
        counts = found.groupBy("anchor_id", "anchor_key", "slot").count().collect()  # one row a window of these anchors
        filled = {(r["anchor_id"], r["anchor_key"], r["slot"]) for r in counts if r["count"] >= k}
        keys = list(zip(anchors.ids[windows.owner].tolist(), anchors.keys[windows.owner].tolist(), slots.tolist()))
        done = np.array([keys[w] in filled or thresholds[w] <= windows.low[w] for w in open_.tolist()], bool)
        if not done.all():  # keep what is final; the others come again, whole
            final = rows.sparkSession.createDataFrame(pa.table({"anchor_id": anchors.ids[windows.owner[open_[done]]], "anchor_key": anchors.keys[windows.owner[open_[done]]], "slot": slots[open_[done]].astype(np.int32)}))
            found = found.join(final, ["anchor_id", "anchor_key", "slot"], "left_semi")
        out.append(found)
        open_ = open_[~done]
    return out


def negative_windows(positives: list, anchors: Rows, low: int, high: int) -> tuple[Windows, np.ndarray]:
    """Windows of the negatives of anchors' positives (rows of FOUND with rank), by anchor and rank."""
    place = {k: i for i, k in enumerate(zip(anchors.ids.tolist(), anchors.keys.tolist()))}
    asked = sorted((place[r["anchor_id"], r["anchor_key"]], r["rank"], r["vec_id"], r["score"]) for r in positives)
    asked = [(*x, -(-low * x[3] // 100), high * x[3] // 100) for x in asked]
    asked = np.array([x for x in asked if x[4] <= x[5]], np.int64).reshape(-1, 6)
    return Windows(asked[:, 0], asked[:, 2], asked[:, 3], asked[:, 4], asked[:, 5]), asked[:, 1]


def prepared(vectors: DataFrame, relabel: Column | None = None) -> DataFrame:
    """vec_id, label, key, q of the rows that take part, each once; relabel: an expression of vec_id and label."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("q"))
    rows = rows.withColumn("label", relabel) if relabel is not None else rows
    return rows.distinct().withColumn("key", F.xxhash64("label", "q"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = FROM, high: int = TO) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's hard negatives.

    vectors: vec_id, embedding (array of float or double), label. An anchor's positives are its first other rows of the
    same label; a positive's negatives the first rows of other labels whose score is `low` to `high` hundredths of the
    positive's. Higher scores come first, ties by vec_id, then by a hash of the rest of the row. Rows take no part whose
    id, label or vector is null, or whose vector is empty, of another size than most (of equally common sizes the
    greater counts), has null or non-finite components, or ones so large that scores do not fit a long. A row that
    repeats id, label and vector counts once; rows with an id in common and other contents are different rows. Fewer
    rows than asked for are all returned; a negative positive score has no window. No rows give none.
    """
    spark = vectors.sparkSession
    rows = store.table(prepared(vectors, relabel), "rows")
    sizes = rows.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    d, total = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("q") == d)
    norm = rows.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    exact = np.float64 if norm < 2**52 else np.int64  # doubles hold all partial scores, or longs do
    order = ["vec_id", "key", "label", "q"]
    sample = as_rows(rows.orderBy(F.xxhash64("vec_id", "key"), "vec_id").limit(SAMPLE).select(order).toArrow(), d)  # SAMPLE rows at most
    dims = np.argsort(-(sample.vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    share = len(sample.ids) / total
    asked = store.table(rows.where(is_anchor).select(order), "anchors")
    n_blocks, out = max(1, -(-asked.count() // ANCHORS)), []
    for b in range(n_blocks):
        anchors = as_rows(asked.where(F.pmod(F.xxhash64("vec_id", "key"), F.lit(n_blocks)) == b).toArrow(), d)  # ANCHORS rows, about
        n = len(anchors.ids)
        if not n:
            continue
        none, whole = np.zeros(n, np.int64), np.full(n, np.inf)
        parts = fill(rows, anchors, Windows(np.arange(n), none, none, -whole, whole), none, sample, share, positives, True, dims, exact)
        near = [r for p in parts for r in p.select("anchor_id", "anchor_key", "rank", "vec_id", "score").collect()]  # positives of these anchors
        for part in parts:
            store.drop(part)
        windows, slots = negative_windows(near, anchors, low, high)
        if len(windows.owner):
            out += fill(rows, anchors, windows, slots, sample, share, negatives, False, dims, exact)
    store.drop(asked)
    store.drop(rows)
    if not out:
        return spark.createDataFrame([], RESULT)
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select("anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("tag_score").alias("positive_score"), F.col("score").alias("negative_score"))


def digest(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; every seventh row has the next label."""
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, relabel)
