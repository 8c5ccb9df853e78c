"""Uniform shuffle into shards of exact sizes.

A shuffle of all rows that fills shards of fixed sizes sends a random number of rows from each input block to each shard;
those numbers follow the multivariate hypergeometric law. They are drawn first (the communication matrix, blocks by
shards), then each block deals its rows out by a random permutation of exactly so many labels, rows are exchanged once,
and each shard is permuted again. Shard sizes are exact, at most one apart, and every arrangement is equally likely.

A block is a run of rows of a file, so it is the same however tasks split the files, also after an executor is lost. No one
holds the matrix: counts are split along a binary tree over the blocks, by draws seeded with the tree's nodes, and a task goes
down the tree to the rows of its own blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, documents, freeze, numbered, unused

#: numpy draws hypergeometric numbers below this total; above, they are drawn by inverting the law's own sums.
EXACT = 10**9

#: Rows of a block, as a power of two, and blocks that a task tallies.
BLOCK_BITS, BLOCKS_A_TASK = 17, 16

#: Ranges of the second permutation's key in each shard, at least, and rows that one holds on average beyond those.
RANGES, ROWS_A_RANGE = 64, 4096


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _split(rng, good: int, bad: int, draws: int) -> int:
    if good + bad < EXACT:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    # the law from neighbour to neighbour around its mode, as far as a double can tell its mass from none
    total, least, most = good + bad, max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), least), most)
    width = 64 + int(14 * (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5)
    first = max(least, mode - width)
    k = np.arange(first, min(most, mode + width), dtype=np.float64)
    ratio = ((good - k) / (k + 1)) * ((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(sums) - 1)


def _drawn(rng, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows, drawn from all that are left, go to each shard."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for j, own in enumerate(left.tolist()):
        rest -= own
        out[j] = _split(rng, own, rest, n) if rest else n
        n -= int(out[j])
    return out


def matrix_row(ends: np.ndarray, shards: int, seed: int, block: int) -> np.ndarray:
    """Rows of a block to each shard. ends: rows up to and with each block. All blocks' rows add up to the shard sizes."""
    low, high, left = 0, len(ends), np.array(shard_sizes(int(ends[-1]), shards), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        part = _drawn(np.random.default_rng([seed, 0, low, high]), left, int(ends[mid - 1] - (ends[low - 1] if low else 0)))
        if block < mid:
            high, left = mid, part
        else:
            low, left = mid, left - part
    return left


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """The whole matrix, which no task needs: blocks by shards."""
    return np.array([matrix_row(np.cumsum(counts), shards, seed, k) for k in range(len(counts))])


def _labels(ends: np.ndarray, shards: int, seed: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and random second key of each row of a block, in its order."""
    rng = np.random.default_rng([seed, 1, block])
    shard = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix_row(ends, shards, seed, block)))
    return shard, rng.integers(0, 1 << 62, len(shard), dtype=np.int64)


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 9, frozen: bool = False) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (0 upwards in each shard, without gaps).

    Every row goes to one shard, whatever it holds: nulls, empty and repeated rows, hot sources and long texts are all
    dealt alike, by position. An empty table gives no rows. Columns named shard and slot are replaced, all others pass
    through. ``frozen`` says that ``docs`` reads a table as it lies, whole (a scan, projected or not), so it need not be
    written first; of a filtered one the job fails.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    rows, row = numbered(docs if frozen else freeze(docs, "shard-input"))
    found = rows.groupBy(F.shiftright(row, 40).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(row).bitwiseAND(F.lit((1 << 40) - 1))).alias("last")).collect()
    if any(r["last"] + 1 != r["n"] for r in found):  # a number for each file
        raise ValueError("rows are missing from the files: freeze the table first")
    sizes = np.zeros(1 + max([0, *(r["file"] for r in found)]), np.int64)
    for r in found:
        sizes[r["file"]] = r["n"]
    blocks = -(-sizes >> BLOCK_BITS)
    first = np.cumsum(blocks) - blocks
    whole = np.full(int(blocks.sum()), 1 << BLOCK_BITS)
    last = np.flatnonzero(blocks)
    whole[(first + blocks - 1)[last]] = sizes[last] - ((blocks[last] - 1) << BLOCK_BITS)
    sent = spark.sparkContext.broadcast((first, np.cumsum(whole)))  # a number for each file, one for each block
    ranges = max(RANGES, 1 << (int(sizes.sum()) // (shards * ROWS_A_RANGE)).bit_length())
    shift = 62 - ranges.bit_length() + 1
    names = [unused(n, rows.columns) for n in ("_shard", "_key", "_cell", "_at")]
    shard_, key_, cell_, at_ = names

    def deal(batches):
        first, ends = sent.value
        held: dict[int, tuple] = {}
        for b in batches:
            n = b.column(b.num_columns - 1).to_numpy()
            index = n & ((1 << 40) - 1)
            block, place = first[n >> 40] + (index >> BLOCK_BITS), index & ((1 << BLOCK_BITS) - 1)
            shard, key = np.empty(len(n), np.int32), np.empty(len(n), np.int64)
            used = np.unique(block).tolist()
            held = {k: held[k] if k in held else _labels(ends, shards, seed, k) for k in used}
            for k in used:
                own = block == k
                shard[own], key[own] = held[k][0][place[own]], held[k][1][place[own]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(key)], names=[*b.schema.names, shard_, key_])

    def tally(batches):
        ends = sent.value[1]
        for b in batches:
            for k in b.column(0).to_pylist():
                shard, key = _labels(ends, shards, seed, k)
                cell, n = np.unique(shard.astype(np.int64) * ranges + (key >> shift), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    parts = spark.range(0, len(whole), 1, max(1, -(-len(whole) // BLOCKS_A_TASK)))
    cells = parts.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    before = W.partitionBy(F.floor(F.col("cell") / ranges)).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    ahead = freeze(cells.select(F.col("cell").alias(cell_), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(at_)), "shard-cells")
    schema = T.StructType([*rows.schema.fields, T.StructField(shard_, T.IntegerType()), T.StructField(key_, T.LongType())])
    dealt = rows.mapInArrow(deal, schema).withColumn(cell_, F.col(shard_).cast("long") * ranges + F.shiftright(key_, shift))
    order = F.row_number().over(W.partitionBy(cell_).orderBy(key_, row)) - 1
    rank = unused("_rank", rows.columns)
    return dealt.withColumn(rank, order).join(ahead, cell_).select(*columns_of(docs), F.col(shard_).alias("shard"), (F.col(at_) + F.col(rank)).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_to_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
