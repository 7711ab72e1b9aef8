"""SimHash near-dedup: fingerprints linked through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts (0 to 2) of its 32 two-bit segments. Fingerprints that differ
in d bits have count vectors at Manhattan distance d or less, so that distance is a lower bound. The segments
form 6 bands; for each choice of 3 bands there is a grid whose cells hold equal counts in those bands. Vectors
within distance 3 differ in 3 bands at most and so share a cell of at least one of the 20 grids. Within cells
the Manhattan bound is tested first, then the exact number of differing bits. Of a cell's links, only a
spanning forest is emitted, so groups of near copies never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import components, store, symbols

SEED = 42
MOST_BITS = 3
BANDS = 6
#: Fingerprints compared in one group; larger cells are split into pairs of blocks.
BLOCK = 4096
LOW_BITS = 0x5555555555555555


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def grid_masks() -> list[int]:
    """Bits of the segments in each choice of half of the bands."""
    edges = [round(32 * k / BANDS) for k in range(BANDS + 1)]
    bands = [sum(3 << (2 * s) for s in range(edges[k], edges[k + 1])) for k in range(BANDS)]
    return [sum(c) for c in combinations(bands, BANDS - MOST_BITS)]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of each shingle of lower-cased words; zero without words."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:n] - 1 - np.fromiter(map(len, words[:n]), np.int64, n)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for low in range(0, n, 4096):
        votes += np.unpackbits(hashes[low : low + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Columns row (all of docs, as a struct), _id, _rk and fp (long). A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            data, offsets = symbols.text_bytes(row.field("text"))
            fps = np.array([fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), shingle) for i in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, "fp"])

    keyed = docs.select(F.struct("*").alias("row"), *store.row_key())
    return store.map_arrow(keyed, run, keyed.withColumn("fp", F.lit(0).cast("long")).schema)


def counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed two bits each."""
    high, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    two, one = high.bitwiseAND(fp).bitwiseAND(low), high.bitwiseXOR(fp).bitwiseAND(low)
    return F.shiftleft(two, 1).bitwiseOR(one)


def _tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of fps under at most MOST_BITS differing bits."""
    one = fps - ((fps >> np.uint64(1)) & np.uint64(LOW_BITS))
    steps = one | ((one >> np.uint64(1)) & np.uint64(LOW_BITS))  # counts in unary: their xor's bits are |difference|
    rest = np.arange(len(fps))
    a, b = [], []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(steps[rest] ^ steps[x]) <= MOST_BITS
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[x]) <= MOST_BITS
            if near.any():
                new = rest[near]
                a += [x] * len(new)
                b += new.tolist()
                front += new.tolist()
                rest = rest[~near]
    return fps[a], fps[b]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell; rows come sorted by cell."""
    key_names = ("grid", "cell", "low", "high")
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
        edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(rows)]))
        size = np.diff(edges)
        fps = rows[:, 4].view(np.uint64)
        twos = edges[:-1][size == 2]
        near = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= MOST_BITS]
        a, b = [fps[near]], [fps[near + 1]]
        for k in np.flatnonzero(size > 2):
            x, y = _tree(fps[edges[k] : edges[k + 1]])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (*key_names, "fp")]))
        rows = np.ascontiguousarray(np.concatenate(held))
        change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
        if len(change):
            cut = change[-1] + 1
            yield links(np.asfortranarray(rows[:cut]))
            held = [rows[cut:]]
        else:
            held = [rows]
    if held:
        yield links(np.asfortranarray(np.concatenate(held)))


def linked(fps: DataFrame) -> DataFrame:
    """a, b: links that span the components of the distinct fingerprints fp under MOST_BITS differing bits."""
    grids = F.array(*[F.struct(F.lit(g).alias("grid"), counts(F.col("fp")).bitwiseAND(F.lit(_signed(m))).alias("cell")) for g, m in enumerate(grid_masks())])
    keys = fps.select("fp", F.explode(grids).alias("k")).select("fp", "k.grid", "k.cell")
    full = store.table(keys.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    rows = keys.join(full, ["grid", "cell"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grid", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    rows = rows.repartition("grid", "cell", "low", "high").sortWithinPartitions("grid", "cell", "low", "high")
    return store.map_arrow(rows, _cells, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fingerprinted documents (row, _id, _rk, fp), and of each fp: component_id and the key (_id, _rk) that stays."""
    marked = store.table(with_fingerprint(docs, shingle).select("row.doc_id", "_id", "_rk", "fp"), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("_id", "_rk")).alias("key"))
    fps = store.table(fps, "distinct")
    roots = components.connected_components(linked(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("key").alias("stays"))
    return marked, rooted.join(best, "root").select("fp", "component_id", "stays")


def digest(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    component_id is the smallest doc_id of the component, null ids aside (null if there are only null ids).
    Null and empty texts, and texts of white space, have fingerprint zero and link like any other.
    """
    marked, of = groups(docs.select("doc_id", "text"), shingle)
    out = marked.join(of, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component (null ids first); repeated rows once."""
    marked, of = groups(docs, shingle)
    keep = of.select("stays._id", "stays._rk").distinct()
    keyed = docs.select(F.struct("*").alias("row"), *store.row_key())
    return keyed.join(keep, ["_id", "_rk"]).dropDuplicates(["_id", "_rk"]).select("row.*")
