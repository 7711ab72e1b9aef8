"""Approximate nearest neighbours by additive quantisation.

A vector is stored as the sum of one word from each of several full-dimensional codebooks, the squared norm of
that sum, and how far the vector is from it. Codebooks start from k-means on residuals and are refitted together by
least squares; codes are found by beam search. A query's inner products with all words make a lookup table, so that
a stored vector costs a few additions.

The error of a code is the residual's length times a normal deviate, as residuals point in any direction: so every
score comes with a low and a high estimate, SPREAD deviations apart. All vectors whose low estimate is within the
k-th smallest high estimate are ranked again by their exact distance: the list follows the error of the codes and the
crowding around a query, at every size of the index.

The index is read in place, twice for each block of queries: for the queries' limits, then for what is within them.
Equal vectors are one entry of the index, so groups of copies do not crowd out other candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import store, symbols

#: Codebooks and words in each; beams kept in encoding.
BOOKS, WORDS, BEAM = 24, 64, 6
#: Vectors that codebooks are fitted on, at most (those of smallest hashed id); rounds of k-means and of least squares.
SAMPLE, ROUNDS, REFITS = 16_000, 6, 1
#: Deviations of a code's error that candidates are taken within.
SPREAD = 1.5
#: Entries of the index scored at a time; queries that are sent to all tasks at a time (about).
ENTRIES, QUERIES = 32_768, 16_384


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null or zero, every component a finite number, of the given size."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    fine = fine & (F.size(vector) == size) if size is not None else fine
    return F.coalesce(fine, F.lit(False))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) of x (n, d) by beam search over residuals."""
    n, m = len(x), len(books)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :].astype(np.float32)
    norms = (books**2).sum(axis=2)
    for k in range(m):
        b = rest.shape[1]
        cost = norms[k] - 2 * rest @ books[k].T + (rest**2).sum(axis=2)[..., None]
        flat = cost.reshape(n, -1)
        keep = 1 if k == m - 1 else min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        from_beam, word = best // WORDS, best % WORDS
        i = np.arange(n)[:, None]
        codes = np.concatenate((codes[i, from_beam], word[..., None].astype(np.uint8)), axis=2)
        rest = rest[i, from_beam] - books[k][word]
        assert b <= beam
    return codes[:, 0]


def train(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Codebooks (BOOKS, WORDS, d) fitted on x (n, d)."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, books = x.copy(), np.zeros((BOOKS, WORDS, x.shape[1]), np.float32)
    for k in range(BOOKS):
        words = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)] + rng.normal(0, 1e-6, (WORDS, x.shape[1])).astype(np.float32)
        for _ in range(ROUNDS):
            near = np.argmin((words**2).sum(axis=1) - 2 * rest @ words.T, axis=1)
            count = np.bincount(near, minlength=WORDS)
            total = np.zeros_like(words)
            np.add.at(total, near, rest)
            words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
        books[k] = words
        rest = rest - words[np.argmin((words**2).sum(axis=1) - 2 * rest @ words.T, axis=1)]
    for _ in range(REFITS):  # all books together, given the codes
        codes = np.concatenate([encode(x[a : a + 1000], books) for a in range(0, len(x), 1000)])
        at = codes.astype(np.int64) + WORDS * np.arange(BOOKS)
        gram, right = np.zeros((BOOKS * WORDS,) * 2, np.float32), np.zeros((BOOKS * WORDS, x.shape[1]))
        for a in range(BOOKS):
            np.add.at(right, at[:, a], x)
            for b in range(BOOKS):
                np.add.at(gram, (at[:, a], at[:, b]), 1)
        books = np.linalg.solve(gram + 0.1 * np.eye(len(gram), dtype=np.float32), right + 0.1 * books.reshape(len(right), -1)).astype(np.float32).reshape(books.shape)
    return books


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _index(books: np.ndarray):
    d = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                x = _matrix(part.column("embedding"), d)
                codes = encode(x, books)
                total = books[np.arange(BOOKS), codes.astype(np.int64)].sum(axis=1).astype(np.float64)
                numbers = [pa.array((total**2).sum(axis=1)), pa.array(((x - total) ** 2).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), *numbers], [*part.schema.names, "code", "norm", "rest"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """cid, codes (books, n), norm and rest of ENTRIES entries or more at a time."""

    def put(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        codes = np.concatenate([symbols.text_bytes(b.column("code"))[0] for b in held]).reshape(-1, BOOKS)
        return t.column("cid").to_numpy(), np.ascontiguousarray(codes.T).astype(np.intp), t.column("norm").to_numpy(), t.column("rest").to_numpy()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ENTRIES:
            yield put(held)
            held = []
    if held:
        yield put(held)


def _estimates(books: np.ndarray, query: np.ndarray, codes: np.ndarray, norm: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high estimates of squared distances, by the query's lookup table."""
    table = books @ query.astype(np.float32)
    inner = np.zeros(len(norm), np.float32)
    for words, at in zip(table, codes):
        inner += words.take(at)
    square = np.maximum(norm - 2 * inner + (query**2).sum(), 0)
    slack = 2 * SPREAD * np.sqrt(square * rest / len(query))
    return square + rest - slack, square + rest + slack


def _limits(books: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """The k smallest high estimates of each query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[np.ndarray] = []
        for _, codes, norm, rest in _chunks(batches):
            for i, query in enumerate(vectors):
                high = _estimates(books, query, codes, norm, rest)[1]
                high = high if i >= len(best) else np.concatenate((best[i], high))
                high = np.partition(high, k - 1)[:k] if len(high) > k else high
                best[i : i + 1] = [high]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in best])), pa.array(np.concatenate(best))], ["query_id", "high"])

    return run


def _within(books: np.ndarray, ids: np.ndarray, vectors: np.ndarray, limits: np.ndarray):
    """Entries whose low estimate is within a query's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cids, codes, norm, rest in _chunks(batches):
            for i, query in enumerate(vectors):
                near = cids[_estimates(books, query, codes, norm, rest)[0] <= limits[i]]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[i])), pa.array(near)], ["query_id", "cid"])

    return run


def _candidates(index: DataFrame, asked: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """query_id, cid of all entries that may be among the k nearest kinds of vectors. asked: n queries' ids and vectors.

    Each block of queries, of bounded size, goes to all tasks, which read the index in place.
    """
    n_blocks = max(1, -(-asked.count() // QUERIES))
    codes, found = index.select("cid", "code", "norm", "rest"), None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, vectors = block.column("query_id").to_numpy(), _matrix(block.column("vector").chunk(0), books.shape[2]).astype(np.float64)
        highs = store.map_arrow(codes, _limits(books, ids, vectors, k), "query_id long, high double")
        highs = highs.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("high"))).where(F.col("r") <= k)
        highs = highs.groupBy("query_id").agg(F.max("high").alias("high")).toArrow()  # one row for each query of the block
        limit = dict(zip(highs.column("query_id").to_pylist(), highs.column("high").to_pylist()))
        limits = np.array([limit[i] for i in ids.tolist()])
        near = store.table(store.map_arrow(codes, _within(books, ids, vectors, limits), "query_id long, cid long"), "candidates")
        found = near if found is None else found.unionByName(near)
    return found if found is not None else asked.where("false").select("query_id", F.col("query_id").alias("cid"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by exact Euclidean distance.

    vectors: vec_id, embedding (array of float or double); queries: the same columns. Rows with a null id, and
    vectors that are null, zero, of another size than most, or with components that are null or not finite, take
    no part. Rows that repeat id and vector count once; a query's own id is never its result. Ties go to the
    smaller vec_id. No usable vectors give no rows.
    """
    clean = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = clean.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    clean = clean.where(F.size("embedding") == d)
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), d)).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector")).distinct()
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().combine_chunks()  # SAMPLE rows at most
    if not sample.num_rows:
        return asked.where("false").select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    books = train(np.unique(_matrix(sample.column("embedding").chunk(0), d), axis=0))
    # Of a vector's ids only the first k + 1 can be results: one more than asked for, as a query's own id is none.
    first = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kinds = clean.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.collect_set("vec_id").alias("ids"))
    kinds = kinds.select("cid", "ids", "embedding")
    index = store.table(store.map_arrow(kinds, _index(books), kinds.select("*", F.lit(b"").alias("code"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("rest")).schema), "index")
    asked = store.table(asked, "asked")
    found = _candidates(index, asked, books, k + 1)
    squares = F.zip_with("vector", "embedding", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    exact = found.join(index.select("cid", "ids", "embedding"), "cid").join(asked, "query_id")
    exact = exact.select("query_id", "cid", "ids", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda x, y: x + y)).alias("score"))
    near = exact.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "cid"))).where(F.col("r") <= k + 1)
    out = near.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by 100, among all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k)
