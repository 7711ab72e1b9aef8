"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the corpus itself, cut into blocks around indexed anchors (repeats.py). A block of a document is
factored greedily against every reference block with its anchor that stands earlier in the corpus: only they can
hold `length` words in common with it. Each factor is the longest run of words from its start that any of them
holds. A factor of `length` words or more is a duplicate span; windows that lie across its end are looked up one
after the other, as another reference block may hold them, and start factors of their own. A shorter factor is
passed over by one word. The index takes room in proportion to a task's words, not to their bytes, and tasks are
bounded by bytes too.

A task holds the reference blocks of its partition; windows of an anchor that lies across partitions, as far as no
reference block here has them, are looked up by hash in those of the other partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import repeats, store, symbols

#: Blocks parsed in one task.
PER_TASK = 4_000


class Reference:
    """Index of reference blocks: all runs of `least` words or more in them, by hash, each with the first place that
    holds it. A hit is compared with the block's own bytes, so that a run takes the same room however long its words are.

    The hash of a run of one word more is made of the run's and the word's: each word is hashed once a block.
    """

    def __init__(self, least: int) -> None:
        self.least = least
        self.blocks: list[tuple[bytes, list[int], list[int]]] = []
        self.places: dict[int, int] = {}

    def add(self, block: bytes, starts: list[int], ends: list[int]) -> None:
        least, places, first = self.least, self.places, len(self.blocks) << 32
        self.blocks.append((block, starts, ends))
        words = [hash(block[a:b]) for a, b in zip(starts, ends)]
        for k in range(len(starts) - least + 1):
            key = hash(block[starts[k] : ends[k + least - 1]])
            places.setdefault(key, first + k)
            for word in words[k + least :]:
                key = hash((key, word))
                places.setdefault(key, first + k)

    def longest(self, block: bytes, starts: list[int], ends: list[int], at: int) -> int:
        """Words of the longest run from the word `at` on that a reference block holds; 0 if shorter than `least`."""
        stop, hits = at + self.least - 1, []
        if stop >= len(ends):
            return 0
        key = hash(block[starts[at] : ends[stop]])
        while (place := self.places.get(key)) is not None:
            hits.append(place)
            stop += 1
            if stop == len(ends):
                break
            key = hash((key, hash(block[starts[stop] : ends[stop]])))
        while hits:  # the longest whose bytes are equal, which is the first but for equal hashes of unequal runs
            size = self.least - 1 + len(hits)
            place = hits.pop()
            other, begin, end = self.blocks[place >> 32]
            word = place & 0xFFFFFFFF
            if other[begin[word] : end[word + size - 1]] == block[starts[at] : ends[at + size - 1]]:
                return size
        return 0


def parse(block: bytes, starts: list[int], ends: list[int], reference: Reference) -> list[tuple[int, int]]:
    """Factors of `least` words or more of a block (first word, word after the last), each the longest from its start.

    After a factor the parse goes on at the first window across its end, so factors may overlap, and every window
    that the reference holds lies in one of them.
    """
    out, at, last = [], 0, len(starts) - reference.least
    while at <= last:
        size = reference.longest(block, starts, ends, at)
        if size:
            out.append((at, at + size))
            at += size - reference.least + 1
        else:
            at += 1
    return out


def word_places(block: bytes) -> tuple[list[int], list[int]]:
    """Starts and ends of the words of a block."""
    starts, ends, _ = symbols.words(np.frombuffer(block, np.uint8), np.array([0, len(block)]))
    return starts.tolist(), ends.tolist()


def _judge(length: int) -> repeats.Judge:
    def judge(b: repeats.Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        word_starts, word_ends, first_word = symbols.words(b.raw, b.offsets)
        begin = np.repeat(b.offsets[:-1], np.diff(first_word))
        word_starts, word_ends, first_word = (word_starts - begin).tolist(), (word_ends - begin).tolist(), first_word.tolist()
        raw, offsets = b.raw.tobytes(), b.offsets.tolist()
        order = np.lexsort((b.first, b.rk, b.id, b.gram))  # anchor after anchor, each in the order of the corpus
        cuts = np.flatnonzero(np.diff(b.gram[order])) + 1
        groups = [x.tolist() for x in np.split(order, cuts)]
        row, start, stop = [], [], []
        for group in groups:
            reference = Reference(length)
            before = None
            for r in group:
                key = (b.id[r], b.rk[r], b.first[r])
                if key == before:  # a row given twice
                    continue
                block, low, high = raw[offsets[r] : offsets[r + 1]], first_word[r], first_word[r + 1]
                starts, ends = word_starts[low:high], word_ends[low:high]
                if before is not None:
                    for a, z in parse(block, starts, ends, reference):
                        row.append(r)
                        start.append(a)
                        stop.append(z - length + 1)
                if r != group[-1]:
                    reference.add(block, starts, ends)
                before = key
        count = np.array(stop, np.int64) - np.array(start, np.int64)
        row = np.repeat(np.array(row, np.int64), count)
        i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.array(start, np.int64), count)
        # Windows that no reference block here has, of anchors that other partitions may have too.
        edge = np.array(sorted({*groups[0], *groups[-1]}))
        n = b.n[edge]
        far_row, far_i = np.repeat(edge, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = int(b.n.max())
        rest = ~np.isin(far_row * wide + far_i, row * wide + i)
        return row, i, far_row[rest], far_i[rest]

    return judge


def duplicate_spans(docs: DataFrame, length: int = 20, gram: int = 5) -> DataFrame:
    """Word spans to remove, by row key. docs: _id, _rk, text."""
    return repeats.repeated_spans(
        docs, repeats.word_units, length, gram, keep_first=True, cut=repeats.word_blocks, judge=_judge(length),
        deal=lambda blocks, parts: blocks.repartitionByRange(parts, "gram", "ctx"), per_task=PER_TASK,
    )


def with_spans(docs: DataFrame, length: int = 20) -> DataFrame:
    """Columns row (all of docs, as a struct), starts and ends of spans of words to remove (may overlap; null if none).

    The first of equal windows stays: that of the smallest doc_id (null ids come first; rows with the same id
    and other texts in a fixed order), then the smallest start. Rows equal in id and text are one document
    given twice and are treated alike. Null texts have no words.
    """
    keyed = docs.select(F.struct("*").alias("row"), *store.row_key(), "text")
    spans = duplicate_spans(keyed, length)
    return keyed.select("row", "_id", "_rk").join(spans, ["_id", "_rk"], "left").select("row", "starts", "ends")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        data, offsets = symbols.text_bytes(row.field("text"))
        raw = data.tobytes()
        out = []
        for i, (starts, ends) in enumerate(repeats.span_lists(batch)):
            words = raw[offsets[i] : offsets[i + 1]].split()
            kept = [w for part in repeats.kept(words, starts, ends) for w in part] if len(starts) else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        a, b, c = zip(*out) if out else ((),) * 3
        yield pa.RecordBatch.from_arrays(
            [row.field("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digest(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs; see with_spans for odd inputs."""
    rows = with_spans(docs.select("doc_id", "text"), length)
    return store.map_arrow(rows, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
