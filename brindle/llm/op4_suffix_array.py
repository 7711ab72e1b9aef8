"""Suffix-array dedup: remove every byte under a string of `length` bytes that stands elsewhere too.

The suffixes sorted are those at anchors (repeats.py): a sparse suffix array that still decides every string
of `length` bytes, as equal strings have an equal anchor at the same place. Splitters sampled by the range
partitioner cut the suffixes by their leading tokens (8-byte words); each bucket is sorted by multikey quicksort,
and so are the reversed bytes before the anchors. A string that starts d bytes before its anchor stands twice in
the bucket if, and only if, two neighbours in a run of suffixes with at least length - d bytes in common are also in
one run of at least d bytes before the anchor. Runs that touch a bucket's ends may go on in the next bucket: their
strings are compared across boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import repeats, store, symbols

TOKEN = 8
#: Bytes of a suffix, its leading tokens, that splitters tell apart; suffixes sorted in one task.
LEAD, PER_TASK = 8 * TOKEN, 12_000


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of tokens, compared from left to right.

    Every pass quicksorts on one token; only rows still tied with a neighbour go on to the next token, each
    within its run of ties. All runs of a depth are sorted together.
    """
    order = np.argsort(keys[:, 0], kind="quicksort") if len(keys) else np.zeros(0, np.int64)
    place, rows = np.arange(len(order)), order
    run = np.zeros(len(order), np.int64)
    for depth in range(1, keys.shape[1] if len(keys) else 0):
        token = keys[rows, depth - 1]
        tied = (token[1:] == token[:-1]) & (run[1:] == run[:-1])
        keep = np.concatenate((tied, [False])) | np.concatenate(([False], tied))
        if not keep.any():
            break
        run = np.cumsum(np.concatenate(([True], ~tied)))[keep]
        place, rows = place[keep], rows[keep]
        again = np.lexsort((keys[rows, depth], run))
        rows = rows[again]
        order[place] = rows
    return order


def _tokens(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bytes of each raw[begin:end], padded by zeros, as a matrix."""
    out = np.zeros((len(begin), -(-width // TOKEN) * TOKEN), np.uint8)
    for low in range(0, len(begin), 500):
        at = begin[low : low + 500, None] + np.arange(out.shape[1])
        out[low : low + 500] = np.where(at < end[low : low + 500, None], raw[np.minimum(at, len(raw) - 1)], 0)
    return out


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and the number of bytes that each shares with the one before it (-1: the first)."""
    order = multikey_quicksort(keys.view(">u8").astype(np.uint64))
    differ = keys[order[1:]] != keys[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return order, np.concatenate(([-1], shared))


def _runs(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each row the number of its run of neighbours that share `least` bytes or more."""
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(shared < least) - 1
    return run


def _judge(length: int, gram: int) -> repeats.Judge:
    def judge(b: repeats.Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        anchor = b.offsets[:-1] + b.at
        after = _sorted(_tokens(b.raw, anchor, b.offsets[1:], length))
        before = _sorted(_tokens(b.raw[::-1], len(b.raw) - anchor, len(b.raw) - b.offsets[:-1], max(length - gram, 1)))
        lead = _runs(*after, LEAD)
        found, far = [], []
        for d in range(int((b.at - b.n).min()) + 1, int(b.at.max()) + 1):
            own = np.flatnonzero((b.at - b.n < d) & (d <= b.at))  # blocks with a string that starts d bytes before the anchor
            if not len(own):
                continue
            right = _runs(*after, length - d)
            kind = right[own] * len(b.n) + _runs(*before, d)[own]
            order = np.argsort(kind, kind="stable")
            kind, own = kind[order], own[order]
            new = np.concatenate(([True], kind[1:] != kind[:-1]))
            twice = ~(new & np.concatenate((new[1:], [True])))
            found.append(np.column_stack((own[twice], b.at[own[twice]] - d)))
            edge = right if length - d < LEAD else lead
            own = own[new]
            own = own[(edge[own] == 0) | (edge[own] == edge.max())]
            far.append(np.column_stack((own, b.at[own] - d)))
        found, far = np.concatenate(found), np.concatenate(far)
        return found[:, 0], found[:, 1], far[:, 0], far[:, 1]

    return judge


def _deal(blocks: DataFrame, parts: int) -> DataFrame:
    """By leading tokens; suffixes that share all of them by their hash, so that no number of them is too many."""
    return blocks.repartitionByRange(parts, F.expr(f"substring(block, at + 1, {LEAD})"), F.col("ctx"))


def duplicate_spans(docs: DataFrame, length: int = 200, gram: int = 40) -> DataFrame:
    """Byte spans to remove, by row key. docs: _id, _rk, text."""
    if gram % TOKEN or gram > length:
        raise ValueError(f"gram must be a multiple of {TOKEN}, {length} at most")
    return repeats.repeated_spans(
        docs, repeats.byte_units, length, gram, keep_first=False, cut=repeats.byte_blocks, judge=_judge(length, gram), deal=_deal, per_task=PER_TASK
    )


def with_spans(docs: DataFrame, length: int = 200, gram: int = 40) -> DataFrame:
    """Columns row (all of docs, as a struct), starts and ends of spans (may overlap; null if none).

    Any columns besides doc_id and text pass through in row, whatever their names. Null texts count as empty.
    Rows equal in doc_id and text are copies of each other like any others; null ids are ids.
    """
    keyed = docs.select(F.struct("*").alias("row"), *store.row_key(), "text")
    spans = duplicate_spans(keyed, length, gram)
    return keyed.select("row", "_id", "_rk").join(spans, ["_id", "_rk"], "left").select("row", "starts", "ends")


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(repeats.kept(text, starts, ends)) if len(starts) else text


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        data, offsets = symbols.text_bytes(row.field("text"))
        raw = data.tobytes()
        out = []
        for i, (starts, ends) in enumerate(repeats.span_lists(batch)):
            text = raw[offsets[i] : offsets[i + 1]]
            kept = _cut(text, starts, ends)
            out.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
        a, b, c, d = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [row.field("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def digest(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs; see with_spans for odd inputs."""
    rows = with_spans(docs.select("doc_id", "text"), length)
    return store.map_arrow(rows, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with repeated bytes cut from text, every row kept.

    A character cut in the middle is removed whole. n_chars, if there is such a column, is counted anew. A
    null text stays null.
    """
    rows = with_spans(docs, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            data, offsets = symbols.text_bytes(row.field("text"))
            raw = data.tobytes()
            spans = repeats.span_lists(batch)
            texts = [None if not valid else _cut(raw[offsets[i] : offsets[i + 1]], *spans[i]).decode("utf-8", "ignore") for i, valid in enumerate(row.field("text").is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], ["row", "kept"])

    out = store.map_arrow(rows, cut, rows.select("row", F.lit(None).cast("string").alias("kept")).schema)
    columns = [F.col("kept").alias("text") if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
