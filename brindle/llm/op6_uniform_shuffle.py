"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows fall into blocks. How many rows of each block go to each shard is drawn from the multivariate
hypergeometric law, block after block, as in dealing cards: so the matrix has exact row and column sums. Every
block is permuted locally and cut by its row of the matrix, the parts are exchanged, and every shard is
permuted again. Rows are moved by DataFrame operations only.

Permutations order rows by a hash of their content, so a lost task is recomputed to the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and of a part of a shard that is permuted in one task, at most about; blocks at least.
BLOCK_ROWS, LEAST_BLOCKS = 1_000_000, 64
OVERHEAD = 16


def communication_matrix(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of block b that go to shard s. Shard sizes are at most one apart; which are larger is drawn too."""
    rng = np.random.default_rng(seed)
    total = sum(blocks)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(blocks), shards), np.int64)
    for b, n in enumerate(blocks):
        out[b] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[b]
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Columns row (all of docs, as a struct), shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    Every row is placed, repeated rows and rows with nulls too; among rows with equal ids and texts any order
    gives the same result. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"), F.xxhash64("text", F.lit(seed + 1), "doc_id").alias("_g"))
    total = docs.count()
    n_blocks = max(LEAST_BLOCKS, -(-total // block_rows))
    rows = rows.withColumn("_block", F.pmod("_h", F.lit(n_blocks)))
    counts = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    cuts = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({b}L, array({', '.join(f'{int(e)}L' for e in ends[b])}))" for b in range(n_blocks)) + " AS t(_block, _ends)")
    inside = Window.partitionBy("_block").orderBy("_g", "_h")
    dealt = rows.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(cuts), "_block")  # shards numbers for each block_rows rows
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))))
    # The second permutation: rows ordered by another hash, in parts of even hash ranges.
    n_parts = max(1, -(-total // (shards * block_rows)))
    dealt = dealt.withColumn("_order", F.xxhash64(F.lit(seed + 2), "_g", "_h")).withColumn("_part", F.pmod(F.shiftrightunsigned("_order", 8), F.lit(n_parts)))
    slot = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_order", "_g", "_h")) - 1
    if n_parts == 1:
        return dealt.withColumn("slot", slot.cast("long")).select("row", "shard", "slot")
    sizes = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "_part", before.alias("_before"))
    placed = dealt.withColumn("_in_part", slot).join(starts, ["shard", "_part"])
    return placed.withColumn("slot", (F.col("_before") + F.col("_in_part")).cast("long")).select("row", "shard", "slot")


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs. The law is `rows`.

    The crc32 of a null text is that of no bytes.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "text")
    rows = _slim_shard(slim, shards)
    return rows.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slim_shard(slim: DataFrame, shards: int) -> DataFrame:
    """shard() over ids, sizes and checksums: what moves has the text's hash in place of the text."""
    small = slim.select("doc_id", "size", "text_crc32", F.xxhash64("text").alias("text"))
    return shard(small, shards)


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 11) -> None:
    """The shards as Parquet folders shard=0, shard=1, ..., each in the order of its slots."""
    rows = shard(docs, shards, seed).select("row.*", "shard", "slot")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
