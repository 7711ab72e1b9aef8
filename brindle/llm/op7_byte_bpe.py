"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a piece there is exactly one token that its encoding ends in. A token that ends the prefix
is that one if, and only if, it may stand next to the last token of what is before it. So a table of last
tokens, one for each prefix, holds the encodings of all prefixes at once: appending bytes only adds entries,
and an edit leaves the entries before it as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import store

#: A worker remembers the ids of parts between spaces, and of other pieces, of so many characters at most, and so many
#: bytes of them in all, of which ENTRY are an entry's own (later ones are encoded each time); and pairs of tokens.
KEPT_CHARS, KEPT_BYTES, ENTRY, FOLLOWS = 64, 64 << 20, 250, 200_000
#: Texts in Python's hands at a time.
AT_ONCE = 500
#: White space, and the letters and numbers that Unicode 16.0, by which the library splits, has and
#: Unicode 15.1, which Python knows, has not.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ADDED = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}


class PrefixTable:
    """Last tokens of all prefixes of a growing run of bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = []

    def append(self, more: bytes) -> None:
        """Add bytes; entries there are stay."""
        self.text += more
        v, last, text = self.vocabulary, self.last, self.text
        for end in range(len(last) + 1, len(text) + 1):
            for size in range(min(end, v.longest), 0, -1):
                token = v.ranks.get(text[end - size : end])
                if token is not None and (size == end or v.may_follow(last[end - size - 1], token)):
                    last.append(token)
                    break

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace text[start:end]; only entries from start on are computed again."""
        after = self.text[end:]
        self.text, self.last = self.text[:start], self.last[:start]
        self.append(new + after)

    def ids(self, end: int | None = None) -> list[int]:
        """Token ids of the first `end` bytes (all, if not given)."""
        end, out = len(self.text) if end is None else end, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Vocabulary:
    """Ranks of a byte-level BPE, with the two tokens that each merge joins."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._follows: dict[int, bool] = {}
        self.sizes = list(map(len, self.tokens))
        self.packed = [x.to_bytes(4, "little") for x in range(len(self.tokens))]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._merge(token, rank)):
                self.halves[rank] = pair
                self.joined[pair] = rank
        self._find = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._find.add_word(token.decode("latin-1"), (rank, len(token)))
        self._find.make_automaton()

    def _merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two parts of a token, after all merges of lower rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Take back the merges of both sides from the last one; no pair that meets at the boundary may have
        merged before the parts it belongs to were themselves merged further.
        """
        known = self._follows.get(left << 20 | right)
        if known is not None:
            return known
        a, b, before, ok = left, right, len(self.tokens), True
        while True:
            if self.joined.get((a, b), before) < before:
                ok = False
                break
            whole_a, whole_b = a not in self.halves, b not in self.halves
            if whole_a and whole_b:
                break
            if whole_b or (not whole_a and a > b):  # the left side's merge is the later one
                before, a = a, self.halves[a][1]
            else:  # at equal ranks the leftmost merges first
                before, b = b + 1, self.halves[b][0]
        if len(self._follows) > FOLLOWS:
            self._follows.clear()
        self._follows[left << 20 | right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        last: list[int] = []
        follows, filled = self._follows, -1
        for end, (token, size) in self._find.iter(piece.decode("latin-1")):  # longest first for each end
            if end > filled:
                if size <= end:
                    ok = follows.get(last[end - size] << 20 | token)
                    if not (self.may_follow(last[end - size], token) if ok is None else ok):
                        continue
                last.append(token)
                filled = end
        out, end, sizes = [], len(piece), self.sizes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        return out[::-1]


def classes(highest: int) -> tuple[str, str]:
    """Letters and numbers of Unicode 16.0 up to a code point, as ranges of a character class."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    more = {x: k for k, added in ADDED.items() for a, b in added for x in range(a, b + 1)}
    for x in range(highest + 1):
        own = spans.get(more.get(x) or unicodedata.category(chr(x))[0])
        if own is not None:
            if own and own[-1][1] == x - 1:
                own[-1][1] = x
            else:
                own.append([x, x])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[k]) for k in "LN")
    return letters, numbers


def split_pattern(highest: int) -> re.Pattern[str]:
    """The pattern that cuts texts into pieces, for texts of code points up to highest: its classes are written out."""
    letters, numbers = classes(highest)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Encoder:
    """Ids, as little-endian 32-bit integers end to end, of whole texts."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.vocabulary = Vocabulary(ranks)
        #: Smaller classes match faster.
        self.pieces = {"ascii": split_pattern(127), "basic": split_pattern(0xFFFF), "all": split_pattern(0x10FFFF)}
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        #: A space before a space, or at the end: such texts are not cut at spaces.
        self.odd = re.compile(r" (?=\s|\Z)")
        self._piece: dict[str, bytes] = {}
        self.kept = 0
        encoder = self

        class Spaced(dict):
            def __missing__(self, part: str) -> bytes:
                ids = encoder._whole(" " + part)
                if encoder._fits(part, ids):
                    self[part] = ids
                return ids

        self._spaced = Spaced()

    def _fits(self, text: str, ids: bytes) -> bool:
        """Whether a text and its ids may be kept; if so, counts their bytes."""
        size = 4 * len(text) + len(ids) + ENTRY
        fits = len(text) <= KEPT_CHARS and self.kept + size <= KEPT_BYTES
        self.kept += size * fits
        return fits

    def _whole(self, text: str) -> bytes:
        out, known = [], self._piece
        kind = "ascii" if text.isascii() else "all" if self.beyond.search(text) else "basic"
        found = self.pieces[kind].findall(text)
        for piece in found:
            ids = known.get(piece)
            if ids is None:
                ids = b"".join(map(self.vocabulary.packed.__getitem__, self.vocabulary.encode_piece(piece.encode())))
                if len(found) > 1 and self._fits(piece, ids):
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """A piece never goes on over a space that a non-space follows, so each such part is encoded alone."""
        if not text:
            return b""
        if self.odd.search(text):
            return self._whole(text)
        parts = text.split(" ")
        return self._whole(parts[0]) + b"".join(map(self._spaced.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines of a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _texts(column: pa.Array) -> Iterator[str]:
    for low in range(0, len(column), AT_ONCE):
        for x in column.slice(low, AT_ONCE).to_pylist():
            yield x or ""


def encode(docs: DataFrame, path: str | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of token ids (array<int>) after all others. A null or empty text has no ids.

    path: file of ranks, in the same place on every machine. decoded: name of one more column, the SHA-256 of the
    bytes that the ids decode to. Columns named like the new ones are replaced.
    """
    path = path or default_path()
    keyed = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"))
    new = {ids: F.col("ids")} | ({decoded: F.col("decoded")} if decoded else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            raw = [encoder.encode(t) for t in _texts(batch.column("_text"))]
            back = pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() if decoded else None for x in raw], pa.string())
            found = [np.frombuffer(x, "<i4") for x in raw]
            at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32())), back], ["row", "ids", "decoded"])

    out = store.map_arrow(keyed, run, keyed.select("row", F.array(F.lit(0)).alias("ids"), F.lit(None).cast("string").alias("decoded")).schema)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with a column text decoded from ids (bytes that are no UTF-8 become U+FFFD). Null ids give null."""
    path = path or default_path()
    keyed = rows.select(F.struct("*").alias("row"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            out: list[Any] = [None if x is None else encoder.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    out = store.map_arrow(keyed, run, keyed.select("row", F.lit(None).cast("string").alias("text")).schema)
    return out.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != text], F.col("text").alias(text))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; null texts count as empty."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in _texts(batch.column("text")):
                ids = encoder.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return store.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
