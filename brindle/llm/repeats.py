"""Which windows of a fixed number of symbols (bytes or words) stand more than once in a corpus.

Shared frame of the suffix-array and the Lempel-Ziv operators. A window is never shuffled by itself. Each text
is cut into rows of consecutive windows that share an anchor (see symbols.anchors), about one row for every
40 % of a window; a periodic stretch is one row. Equal windows have equal anchors, so all comparisons are within
one anchor's rows:

1. anchors that stand once are dropped: their windows are unique;
2. rows with the same anchor and the same whole content (ctx) are counted, not compared: copies, however
   many, become one representative;
3. only representatives of anchors that have several contents fetch their text, as blocks, and are judged by
   the operator's own method (judge) in partitions of bounded size. A group of equal anchors may lie across
   partitions: windows of the groups at a partition's edges, packed by anchor and hash, go through a second
   comparison. It is dealt by both, so that one anchor's windows spread over as many tasks as there were
   partitions.

Step 2 and the comparison across partitions take content as equal if two independent 64-bit hashes are (anchor
and content); the judges compare bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import store, symbols

#: From a text's bytes: symbols of a batch of texts, and where each text's symbols start.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Blocks:
    """The blocks of a partition: bytes end to end, where each starts, and for each its anchor's hash, the hash of
    its content, its text's key, the text's symbol it starts at, its windows and its anchor's place in it."""

    raw: np.ndarray
    offsets: np.ndarray
    gram: np.ndarray
    ctx: np.ndarray
    id: np.ndarray
    rk: np.ndarray
    first: np.ndarray
    n: np.ndarray
    at: np.ndarray


#: Rows and windows of blocks that stand elsewhere among them; then those that blocks of other partitions may hold.
Judge = Callable[[Blocks], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: The bytes of one text, and of wanted blocks in it the first symbol and the number of symbols: the blocks.
Cut = Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]]


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return symbols.BYTE_SYMBOL[data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = symbols.words(data, offsets)
    return symbols.word_hashes(data, starts, ends), first


def byte_blocks(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    return [raw[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist())]


def word_blocks(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Words joined by one space."""
    starts, ends, _ = symbols.words(raw, np.array([0, len(raw)]))
    return [b" ".join(raw[a:b].tobytes().split()) for a, b in zip(starts[first].tolist(), ends[first + size - 1].tolist())]


def _anchor_rows(units: Units, window: int, gram: int):
    names = ["_id", "_rk", "first", "n", "at", "gram", "ctx", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = symbols.text_bytes(batch.column("text"))
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("_id", "_rk")]
            for a, b in symbols.groups_of(offsets, symbols.PIECE):
                syms, first = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = symbols.anchors(syms, first, window, gram)
                if len(rows["text"]):
                    at = rows["text"] + a
                    small = [pa.array(rows[k].astype(np.int32)) for k in ("n", "at")]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][at]), pa.array(keys[1][at]), pa.array(rows["first"]), *small, *(pa.array(rows[k]) for k in ("gram", "ctx", "times"))], names)

    return run, "_id long, _rk long, first long, n int, at int, gram long, ctx long, times long"


def _fetch(cut: Cut, window: int):
    """The content under each wanted row."""
    names = ["gram", "ctx", "_id", "_rk", "first", "n", "at", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = symbols.text_bytes(batch.column("text"))
            keys = [batch.column(k).to_numpy() for k in ("_id", "_rk")]
            wants = batch.column("wants")
            edges, own = wants.offsets.to_numpy(), wants.values
            for i in range(batch.num_rows):
                part = own.slice(edges[i], edges[i + 1] - edges[i])
                first, n = part.field("first").to_numpy(), part.field("n").to_numpy()
                blocks = cut(data[offsets[i] : offsets[i + 1]], first, n.astype(np.int64) - 1 + window)
                yield pa.RecordBatch.from_arrays(
                    [part.field("gram"), part.field("ctx"), *(pa.array(np.full(len(part), k[i])) for k in keys), part.field("first"), part.field("n"), part.field("at"), pa.array(blocks, pa.binary())], names
                )

    return run, "gram long, ctx long, _id long, _rk long, first long, n int, at int, block binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, for the JVM's sake."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 5000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Rows of either spans of a block (bucket is null) or, packed, windows to be compared once more.
COMPARED = "gram long, ctx long, starts array<int>, ends array<int>, bucket int, hash binary, i binary, ctxs binary, ids binary, rks binary, places binary"
PACKED = ("hash", "i", "ctxs", "ids", "rks", "places")
#: Buckets of hashes, at least, that the windows of an anchor at a partition's edge are dealt over.
LEAST_BUCKETS = 64
#: Bytes of blocks that a task compares, about.
TASK_BYTES = 32 << 20


def _compare(units: Units, window: int, keep_first: bool, judge: Judge, buckets: int):
    """Judge a partition's blocks; give spans of those that stand elsewhere and, packed, windows that may."""
    schema = pa.schema(
        [("gram", pa.int64()), ("ctx", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("bucket", pa.int32()), *((k, pa.binary()) for k in PACKED)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        raw, offsets = symbols.text_bytes(t.column("block").combine_chunks() if t.column("block").num_chunks != 1 else t.column("block").chunk(0))
        blocks = Blocks(raw, offsets, *(t.column(k).to_numpy().astype(np.int64) for k in ("gram", "ctx", "_id", "_rk", "first", "n", "at")))
        row, i, far_row, far_i = judge(blocks)
        if len(row):
            yield pa.RecordBatch.from_arrays(_spans(row, i, blocks, window), schema=schema)
        if len(far_row):
            yield pa.RecordBatch.from_arrays(_packed(far_row, far_i, _hashes(units, blocks, far_row, far_i, window), blocks, keep_first, buckets), schema=schema)

    return run


def _hashes(units: Units, blocks: Blocks, row: np.ndarray, i: np.ndarray, window: int) -> np.ndarray:
    """Hashes of windows i of rows."""
    rows, at = np.unique(row, return_inverse=True)
    size = np.diff(blocks.offsets)[rows]
    offsets = np.concatenate(([0], np.cumsum(size)))
    syms, first = units(blocks.raw[np.arange(offsets[-1]) + np.repeat(blocks.offsets[rows] - offsets[:-1], size)], offsets)
    start = first[at] + i
    return symbols.run_hash(symbols.prefix_sums(syms), start, start + window)


def _packed(row, i, hashes, blocks: Blocks, keep_first: bool, buckets: int) -> list[pa.Array]:
    """Windows as rows of (gram, bucket of hash), each with all it needs end to end as bytes."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((bucket, blocks.gram[row]))
    row, i, hashes, bucket = row[order], i[order], hashes[order], bucket[order]
    g = blocks.gram[row]
    begin = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1]))))
    values = [hashes, i.astype(np.int64), blocks.ctx[row]]
    values += [blocks.id[row], blocks.rk[row], blocks.first[row] + i] if keep_first else [np.zeros(0, np.int64)] * 3
    at = np.concatenate((begin, [len(row)])).astype(np.int32) * 8
    empty = np.zeros(len(at), np.int32)
    packs = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at if len(v) else empty), pa.py_buffer(np.ascontiguousarray(v))]) for v in values]
    none = pa.nulls(len(begin), pa.list_(pa.int32()))
    return [pa.array(g[begin]), pa.nulls(len(begin), pa.int64()), none, none, pa.array(bucket[begin]), *packs]


def _meet(window: int, keep_first: bool):
    """Windows of packed rows that stand in several of them (keep_first: all but the first of each), as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        hashes, i, ctx, ids, rks, places = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.int64) for k in PACKED)
        gram = np.repeat(t.column("gram").to_numpy(), [len(x) // 8 for x in t.column("hash").to_pylist()])
        order = np.lexsort((places, rks, ids, hashes, gram) if keep_first else (hashes, gram))
        new = np.concatenate(([True], (gram[order[1:]] != gram[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])))
        if keep_first:
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = order[(ids[order] != ids[head]) | (rks[order] != rks[head]) | (places[order] != places[head])]
        else:
            again = order[~(new & np.concatenate((new[1:], [True])))]
        if not len(again):
            return
        again = again[np.lexsort((i[again], ctx[again], gram[again]))]
        g, c, w = gram[again], ctx[again], i[again]
        other = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
        begin = np.flatnonzero(other | np.concatenate(([True], w[1:] > w[:-1] + 1)))
        stop = np.concatenate((begin[1:], [len(w)])) - 1
        first = np.flatnonzero(other)
        at = pa.array(np.searchsorted(begin, np.append(first, len(w))).astype(np.int32))
        spans = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (w[begin], w[stop] + window)]
        yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(c[first]), *spans], ["gram", "ctx", "starts", "ends"])

    return run


def _spans(row, i, blocks: Blocks, window: int) -> list[pa.Array]:
    """Runs of consecutive windows of a row, as lists of starts and ends within the row's block."""
    order = np.lexsort((i, row))
    r, w = row[order], i[order]
    begin = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] > w[:-1] + 1))))
    stop = np.concatenate((begin[1:], [len(r)])) - 1
    rows, counts = np.unique(r[begin], return_counts=True)
    at = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    n = len(rows)
    return [
        pa.array(blocks.gram[rows]), pa.array(blocks.ctx[rows]),
        pa.ListArray.from_arrays(at, pa.array(w[begin].astype(np.int32))), pa.ListArray.from_arrays(at, pa.array((w[stop] + window).astype(np.int32))),
        pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in PACKED),
    ]


def repeated_spans(docs: DataFrame, units: Units, window: int, gram: int, keep_first: bool, cut: Cut, judge: Judge, deal, per_task: int) -> DataFrame:
    """Spans of symbols under windows that stand elsewhere too (keep_first: that also start earlier).

    docs: _id, _rk (store.row_key), text. deal(blocks, n) spreads blocks over n partitions, equal anchors side
    by side; n is such that a task gets about per_task blocks, or TASK_BYTES if they are long. Returns _id, _rk, starts and ends (array<long>),
    in symbols; texts without any have no row. Spans may overlap.
    """
    docs = docs.select("_id", "_rk", "text")
    f, schema = _anchor_rows(units, window, gram)
    rows = store.table(store.map_arrow(docs, f, schema), "anchors")
    grams = rows.groupBy("gram").agg(F.sum("times").alias("c"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
    grams = store.table(grams.where("c > 1").select("gram", (F.col("lo") != F.col("hi")).alias("many")), "grams")
    found = store.table(rows.join(grams, "gram"), "found")
    store.drop(rows)
    store.drop(grams)
    reps = found.groupBy("gram", "ctx").agg(
        F.sum("times").alias("copies"), F.min(F.struct("_id", "_rk", "first", "n", "at")).alias("own"), F.first("many").alias("many")
    )
    reps = store.table(reps, "reps")
    wants = reps.where("many").groupBy("own._id", "own._rk").agg(F.collect_list(F.struct("gram", "ctx", "own.first", "own.n", "own.at")).alias("wants"))
    f, schema = _fetch(cut, window)
    blocks = store.map_arrow(docs.join(wants, ["_id", "_rk"]), lambda batches: _gather(f(batches)), schema)
    blocks = store.table(blocks, "blocks")
    n, size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("block").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n // per_task), -(-size // TASK_BYTES))
    compare = _compare(units, window, keep_first, judge, max(LEAST_BUCKETS, parts))
    compared = store.table(store.map_arrow(deal(blocks, parts), compare, COMPARED), "compared")
    store.drop(blocks)
    edge = compared.where("bucket is not null").select("gram", "bucket", *PACKED).repartition(parts, "gram", "bucket")
    edge = store.map_arrow(edge, _meet(window, keep_first), "gram long, ctx long, starts array<int>, ends array<int>")
    inner = compared.where("bucket is null").select("gram", "ctx", "starts", "ends")
    parts_of = inner.unionByName(edge).groupBy("gram", "ctx").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("parts"))
    known = store.table(reps.select("gram", "ctx", "copies", "own").join(parts_of, ["gram", "ctx"], "left"), "known")
    # A row is `times` stretches of n windows each, all of the same content.
    first, n, times = F.col("first"), F.col("n"), F.col("times")
    mine = (F.col("_id") == F.col("own._id")) & (F.col("_rk") == F.col("own._rk")) & (first == F.col("own.first"))
    whole_from = F.when(~mine, first).when(times > 1, first + n) if keep_first else F.when(F.col("copies") > 1, first)
    hits = found.join(known, ["gram", "ctx"]).withColumn("_from", whole_from)
    whole = F.when(F.col("_from").isNotNull(), F.array(F.struct(F.col("_from").alias("start"), (first + times * n - 1 + window).alias("end"))))
    parted = F.when(mine if keep_first else F.col("copies") == 1, F.transform("parts", lambda p: F.struct((first + p.starts).alias("start"), (first + p.ends).alias("end"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    hits = hits.select("_id", "_rk", F.concat(F.coalesce(whole, none), F.coalesce(parted, none)).alias("spans")).where(F.size("spans") > 0)
    spans = hits.groupBy("_id", "_rk").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # a set: of documents given several times, once
    return spans.select("_id", "_rk", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def span_lists(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """starts and ends of each row of a batch, as joined() gives them."""
    starts, ends = batch.column("starts"), batch.column("ends")
    empty = np.zeros(0, np.int64)
    a, x, y = starts.offsets.to_numpy(), starts.values.to_numpy(), ends.values.to_numpy()
    b = ends.offsets.to_numpy()
    return [joined(x[a[i] : a[i + 1]], y[b[i] : b[i + 1]]) if ok else (empty, empty) for i, ok in enumerate(starts.is_valid().to_pylist())]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as sorted starts and ends of maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return s[new], e[np.append(new[1:] - 1, len(e) - 1)]


def kept(pieces, starts: np.ndarray, ends: np.ndarray) -> list:
    """What of a sequence (bytes or a list) lies outside of joined spans, as slices."""
    edges = [0, *np.column_stack((starts, ends)).ravel().tolist(), len(pieces)]
    return [pieces[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)]
