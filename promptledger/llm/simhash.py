"""SimHash fingerprints and their near-duplicate components.

Fingerprints are computed in Arrow batches over whole texts. Equal ones collapse to one row before anything is joined,
so groups of exact copies cost nothing. The Hamming self-join walks binary tries in node pairs (``trie``). To give tasks
tries of their own, the 64 bits are cut into ``distance + 1`` blocks: two fingerprints within the distance agree in at
least one block, so for each block the fingerprints are dealt by its value and each trie below it is joined with itself.
Tries over ``SPLIT`` fingerprints are cut once more by the same rule on the bits that remain. Each trie gives a spanning
forest of its links, never all pairs, and components come from those edges by alternating star contraction, in
DataFrame operations with a frozen table a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, freeze, lookup, trimmed
from .trie import self_join

SHINGLE, DISTANCE, SEED = 4, 4, 42

#: Fingerprints that a trie may hold before it is cut again.
SPLIT = 512


def words(text: str | None) -> list[bytes]:
    """Words of the text with A to Z lower-cased. Only bytes 9 to 13 and 32 separate: what bytes.split() takes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words joined by spaces, repeats included; fewer words: of all of them."""
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    n = len(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    end = np.cumsum(sizes + 1) - 1
    begin = (end - sizes)[: n - width + 1].tolist()
    return np.array([digest(line[i:j], SEED) for i, j in zip(begin, end[width - 1:].tolist(), strict=True)], np.uint64)


#: Hashes whose bits are counted at once, so that a very long text takes bounded memory.
BLOCK = 1 << 16


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half the hashes have it; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i:i + BLOCK].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a row per document, fp as a signed 64-bit number; null and wordless texts have 0."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(shingle_hashes(words(t.as_py()), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), "doc_id long, fp long")


def blocks(bits: int, count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``count`` even blocks of ``bits`` bits."""
    cut = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _block(column, low: int, width: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1))


def trie_edges(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): edges that connect exactly what links of ``distance`` or fewer bits do."""
    cuts = blocks(64, distance + 1)
    keyed = prints.select("fp", F.posexplode(F.array(*[_block(F.col("fp"), *c) for c in cuts])).alias("block", "value"))
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = freeze(sizes.filter("n > 1"), "simhash-tries")
    dealt = keyed.join(sizes, ["block", "value"])
    inner = []
    for i, (low, width) in enumerate(cuts):  # the bits that remain, cut again
        rest = [b for b in range(64) if not low <= b < low + width]
        second = [[rest[j] for j in range(a, a + w)] for a, w in blocks(len(rest), distance + 1)]
        values = F.array(*[_gather(F.col("fp"), bits) for bits in second])
        inner.append(F.when(F.col("block") == i, values))
    again = F.when(F.col("n") > SPLIT, F.coalesce(*inner)).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.select("fp", "block", "value", "n", F.posexplode(again).alias("inner", "part"))
    # the trie's key, so that a task gets whole tries; sorted, a trie is a run of rows
    dealt = dealt.select("fp", F.xxhash64("block", "value", "inner", "part").alias("trie"))
    dealt = dealt.repartition("trie").sortWithinPartitions("trie", "fp")

    def run(batches):
        left: list[pa.RecordBatch] = []
        for b in batches:
            left.append(b)
            if sum(x.num_rows for x in left) >= 100_000:
                table = pa.Table.from_batches(left)
                trie = table.column("trie").to_numpy()
                last = int(np.flatnonzero(trie != trie[-1])[-1]) + 1 if trie[0] != trie[-1] else 0
                if last:
                    yield from _joined(table.slice(0, last), distance)
                    left = table.slice(last).to_batches()
        if left:
            yield from _joined(pa.Table.from_batches(left), distance)

    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def _gather(column, bits: list[int]):
    """The named bits of the column, as one number."""
    runs, out, at = [], None, 0
    for b in bits:
        if runs and runs[-1][0] + runs[-1][1] == b:
            runs[-1][1] += 1
        else:
            runs.append([b, 1])
    for low, width in runs:
        part = F.shiftleft(_block(column, low, width), at)
        out, at = part if out is None else out.bitwiseOR(part), at + width
    return out


def _joined(table: pa.Table, distance: int):
    trie, fp = table.column("trie").to_numpy(), table.column("fp").to_numpy()
    starts = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1]])
    starts = np.r_[starts, len(trie)]
    keys = fp.view(np.uint64) if fp.flags.c_contiguous else np.ascontiguousarray(fp).view(np.uint64)
    order = np.lexsort((keys, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))  # signed to unsigned order
    keys = keys[order]
    links = self_join(keys, starts, 64, distance)
    root = links.find(np.arange(len(keys)))
    tied = np.flatnonzero(root != np.arange(len(keys)))
    signed = keys.view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(signed[root[tied]]), pa.array(signed[tied])], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b) -> (node, root): for every node of an edge, the smallest node that it reaches.

    Alternating large and small stars: each round links every node to the least neighbour of its neighbourhood, until
    all edges are stars. The rounds grow as the logarithm of the longest path. Each is one aggregation by node: minima
    are pre-aggregated, and no neighbourhood is collected.
    """
    edges = freeze(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to its least; small star: those below, and itself
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = freeze(small.filter("u <> v").distinct(), "stars")
        # done when every node has one edge and no root is itself below another node
        nodes = after.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        deep = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        discard(edges)
        edges = after
        if nodes <= 1 and not deep:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of ``distance`` or fewer differing
    bits reach from a document, itself included.

    Null and empty texts have fingerprint 0 and link like others. Rows with equal texts share a component, also when
    they repeat a doc_id; a null doc_id counts as larger than any. Other columns are ignored. No rows give no rows.
    """
    rows = freeze(fingerprints(docs, width=width), "simhash-rows")
    prints = freeze(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    tied = freeze(components(trie_edges(prints.select("fp"), distance)), "simhash-components")
    member = prints.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = freeze(member, "simhash-members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = freeze(member.join(least, "root").select("fp", "component_id", "n"), "simhash-groups")
    return lookup(rows, member, "fp", "n").select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
