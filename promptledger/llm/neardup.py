"""Near-duplicate groups of five-word shingles, verified exactly.

A 64-bit SimHash joined within four differing bits finds what is nearly identical, but of pairs at a similarity of 0.8
to 0.95 it links only some (expected differing bits at 0.8: ten). So the fingerprint links of the trie self-join are one
source of candidates, and the least hashes of a document's shingles another: two documents 0.8 similar share at least
two of their six least hashes with probability above 0.99. Each pair of least hashes is a key. The documents
of a key are linked to the first of them and, in the order of their greatest hash, to the one before, so candidates stay
linear in the documents, however large a group, and what else is alike lies side by side. A key's first comes from an
aggregation; the order is a sort of all keys by ranges, so a hot key lies in several tasks, and the last row of each range
is carried to the next. Every candidate is verified by the exact Jaccard similarity of the shingle sets, and verified
links make groups.

Those links only spare work. What they leave apart is settled exactly, by prefix filtering: with all shingles in one order,
rare ones first, two sets of similarity s or more share one of the first n - ceil(s n) + 1 shingles of each. Documents
of different groups that meet under such a shingle are compared, all pairs of them that size and position allow; a
shingle of many documents is dealt in blocks, and each pair of blocks is a join key of its own.

Of each set a bitmap holds, for every value of a hash, whether an odd number of shingles has it. Two bitmaps differ in no
more bits than the sets in shingles, so the join itself leaves out pairs whose bitmaps differ in more bits than similar sets
can; what shares a passage and little else makes no rows there. (Bitmaps of sets far larger than they are wide rule out less.)

A pair is worth its sets only if its prefixes allow it: of the two, the one that ends first in the order holds all that both
share up to there, so no more than the shingles common to the prefixes and what follows that one can be common.

Texts are read in place: one pass makes sketches and prefixes, and each verification reads again those that a bitmap of
fixed size marks as wanted, shuffles these alone, and drops what the bitmap marked by chance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, columns_of, configured, discard, freeze, lookup, numbered, relieve, trimmed
from .simhash import components, fingerprint, shingle_hashes, trie_edges, words

SHINGLE, SIMILARITY, DISTANCE, LEAST = 5, 0.8, 4, 6

#: Documents of a shingle that are compared under one join key, on average, with as many others.
BLOCK = 512

#: Long integers in a set's bitmap.
PARITY = 8

#: Documents whose shingles are counted to tell frequent ones, and how many of those are sent out. Any order of the
#: shingles gives the same pairs; this one keeps passages of many documents out of the prefixes.
COUNTED, FREQUENT = 20_000, 100_000

#: Bits of the map of wanted rows.
BITMAP = 1 << 26


#: Columns of a set's bitmap.
ODD = [f"odd{k}" for k in range(PARITY)]


def _parity(h: np.ndarray) -> np.ndarray:
    """For each value of a hash of PARITY * 64 values, a bit: whether an odd number of the shingles has it."""
    odd = np.bincount(h & (PARITY * 64 - 1), minlength=PARITY * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(often: np.ndarray, count: np.ndarray):
    """(row, doc_id, text) -> what stands for a text; ``often``: frequent shingles, sorted, and their counts."""

    def prefix(h):
        if len(often):
            at = np.minimum(np.searchsorted(often, h), len(often) - 1)
            h = h[np.lexsort((h, np.where(often[at] == h, count[at], 0)))]
        h = h[: (n := len(h)) - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
        if not len(h):
            return n, h, -1, 0
        at = min(int(np.searchsorted(often, h[-1])), len(often) - 1)
        return n, h, int(count[at]) if len(often) and often[at] == h[-1] else 0, int(h[-1])

    def run(batches):
        for b in batches:
            fp, digest, keys, top, found, odd = [], [], [], [], [], []
            for t in b.column(2):
                w = words(t.as_py())
                h = shingle_hashes(w, SHINGLE)
                least = np.unique(h)[:LEAST].tolist()
                pairs = combinations(least, 2) if len(least) > 1 else [(x, x) for x in least]
                fp.append(fingerprint(h))
                top.append(int(h.max()) - (1 << 63) if len(h) else 0)
                digest.append(xxhash.xxh3_128_digest(b" ".join(w)))
                keys.append([xxhash.xxh64_intdigest(b"%d %d" % p) - (1 << 63) for p in pairs])
                whole = np.unique(h >> np.uint64(1)).astype(np.int64)
                found.append(prefix(whole))
                odd.append(_parity(whole))
            size, first, end_n, end_h = zip(*found, strict=True) if found else ((),) * 4
            longs = pa.list_(pa.int64())
            bits = np.array(odd, np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(digest, pa.binary()), pa.array(keys, longs), pa.array(top, pa.int64()), pa.array(size, pa.int64()), pa.array(first, longs), pa.array(end_n, pa.int64()), pa.array(end_h, pa.int64()), *map(pa.array, bits.T.copy())],
                names=["row", "doc_id", "fp", "digest", "keys", "top", "size", "prefix", "end_n", "end_h", *ODD])

    return run


SKETCH = "row long, doc_id long, fp long, digest binary, keys array<long>, top long, size long, prefix array<long>, end_n long, end_h long"  # end: the prefix's last, as the order has it
SKETCH += "".join(f", {c} long" for c in ODD)


def _set(text):
    return np.unique(shingle_hashes(words(text), SHINGLE) >> np.uint64(1)).astype(np.int64)


def _sets(batches):
    for b in batches:
        sets = [_set(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "set"])


def _verify(batches):
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _frequent(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one document in a sample of bounded size, sorted, and their counts there."""
    some = texts.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, rows // COUNTED))) == 0).mapInArrow(trimmed(_sets), "row long, set array<long>")
    counts = some.select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = sorted((r.h, r.n) for r in counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect())
    return np.array([h for h, _ in top], np.int64), np.array([n for _, n in top], np.int64)


def _marked(rows: DataFrame, name: str) -> np.ndarray:
    """A bitmap of BITMAP bits in which the bit of each value of the column is set, by its value modulo BITMAP."""
    at = F.pmod(F.col(name), F.lit(BITMAP))
    filled = rows.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    out = np.zeros(BITMAP // 64, np.int64)
    got = filled.toArrow()  # at most BITMAP / 64 rows
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _has(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % BITMAP
    return ((bitmap[at >> 6] >> (at & 63)) & 1).astype(bool)


def _common(x: str, y: str):
    """The least number of common shingles at which two sets are similar enough."""
    return F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col(x) + F.col(y)) - 1e-9


def _left(a: str, b: str):
    """How many shingles follow the prefix that ends first."""
    first = F.struct(f"end_n_{a}", f"end_h_{a}") <= F.struct(f"end_n_{b}", f"end_h_{b}")
    return F.when(first, F.col(f"size_{a}") - F.col(f"long_{a}")).otherwise(F.col(f"size_{b}") - F.col(f"long_{b}"))


def _differing(a: str, b: str):
    """In how many bits two bitmaps differ: no more than the sets in shingles."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{c}_{a}").bitwiseXOR(F.col(f"{c}_{b}"))) for c in ODD])


def _allowed(pairs: DataFrame, leads: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows that sizes and prefixes allow."""
    x, y = (leads.select(F.col("row").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("size", "end_n", "end_h", "prefix")], F.size("prefix").alias(f"long_{k}")) for k in "ab")
    least = F.lit(SIMILARITY - 1e-9)
    pairs = pairs.join(x.drop("prefix_a"), "a").join(y.drop("prefix_b"), "b").filter((F.col("size_a") >= least * F.col("size_b")) & (F.col("size_b") >= least * F.col("size_a")))
    pairs = pairs.join(x.select("a", "prefix_a"), "a").join(y.select("b", "prefix_b"), "b")
    both = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return pairs.filter((F.col("size_a") + F.col("size_b") == 0) | (both + _left("a", "b") >= _common("size_a", "size_b"))).select("a", "b")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows whose shingle sets are similar enough."""
    pairs = freeze(pairs, "near-allowed")
    wanted = freeze(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-wanted")
    sent = texts.sparkSession.sparkContext.broadcast(_marked(wanted, "row"))

    def some(batches):
        for b in batches:
            yield b.filter(pa.array(_has(sent.value, b.column(0).to_numpy())))

    marked = texts.select("row", "text").mapInArrow(trimmed(some), "row long, text string")  # shuffled, so that a task runs one of the two at a time
    sets = freeze(marked.join(wanted.hint("merge"), "row", "left_semi").mapInArrow(trimmed(_sets), "row long, set array<long>"), "near-sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    links = freeze(both.select("a", "b", "x", "y").mapInArrow(trimmed(_verify), "a long, b long"), "near-links")
    discard(pairs, wanted, sets)
    sent.destroy()
    relieve(texts.sparkSession)
    return links


#: Columns of a row that meets others under a shingle.
MET = ("own", "row", "size", "root", "long", "end_n", "end_h", *ODD)


def _meeting(met: DataFrame) -> DataFrame:
    """The pairs (columns by _x and _y) of rows of different groups that meet in a block of a shingle and may be similar by
    their sizes and bitmaps."""
    x, y = (met.select("key", "i", "j", *[F.col(c).alias(f"{c}_{s}") for c in MET]) for s in "xy")
    least = F.lit(SIMILARITY - 1e-9)
    pairs = x.join(y, ["key", "i", "j"]).filter("own_x = i and own_y = j and root_x <> root_y and (i < j or row_x < row_y)")
    pairs = pairs.filter(_differing("x", "y") <= F.col("size_x") + F.col("size_y") - 2 * _common("size_x", "size_y") + 1e-6)
    return pairs.filter((F.col("size_x") >= least * F.col("size_y")) & (F.col("size_y") >= least * F.col("size_x")))


def _pairs_apart(leads: DataFrame, tied: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows in different groups of ``tied`` (node, root), among them all that are similar enough."""
    held = leads.select("row", "size", "end_n", "end_h", *ODD, "prefix").join(tied.withColumnRenamed("node", "row"), "row", "left")
    held = freeze(held.withColumn("root", F.coalesce("root", "row")), "near-prefixes")
    between = held.select("root", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi")
    between = freeze(between.select("key"), "near-between")
    sent = leads.sparkSession.sparkContext.broadcast(_marked(between, "key"))

    def some(batches):  # shingles that one group has alone need not be shuffled again
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten()
            on = np.flatnonzero(_has(sent.value, flat.to_numpy()))
            size = pa.compute.list_value_length(lists).to_numpy()
            owner = np.repeat(np.arange(b.num_rows), size)[on]
            rest = [c.take(pa.array(owner)) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(size[owner], pa.int64()), flat.take(pa.array(on))], names=["row", "size", "end_n", "end_h", *ODD, "root", "long", "key"])

    bits = "".join(f"{c} long, " for c in ODD)
    shared = held.select("row", "size", "end_n", "end_h", *ODD, "root", "prefix").mapInArrow(trimmed(some), f"row long, size long, end_n long, end_h long, {bits}root long, long long, key long")
    shared = freeze(shared.join(between, "key", "left_semi"), "near-shared")
    sent.destroy()
    relieve(leads.sparkSession)
    counts = freeze(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "near-counts")
    met = lookup(shared, counts, "key", "n")
    blocks = F.ceil(F.col("n") / BLOCK)
    met = met.withColumn("own", F.pmod(F.xxhash64("row"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = freeze(met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *MET), "near-blocks")
    pairs = _meeting(met)
    pairs = pairs.select(F.least("row_x", "row_y").alias("a"), F.greatest("row_x", "row_y").alias("b"), (_common("size_x", "size_y") - _left("x", "y")).alias("need"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.max("need").alias("need")).filter("both >= need")
    pairs = freeze(pairs.select("a", "b"), "near-apart")
    discard(held, between, shared, counts, met)
    relieve(leads.sparkSession)
    return pairs


def _lags(batches):
    """Sorted (key, top, row, first) -> the same with the row before of the same key, and the partition's ends."""
    names = ["key", "top", "row", "first", "last", "head", "tail"]
    end = None
    for b in batches:
        if not b.num_rows:
            continue
        key, row = b.column(0).to_numpy(), b.column(2).to_numpy()
        last, before = np.r_[row[:1], row[:-1]], np.r_[key[:1], key[:-1]]
        same, head = key == before, np.zeros(len(key), bool)
        if end is None:
            same[0], head[0] = False, True
        else:
            last[0], same[0] = end[2], key[0] == end[0]
        end = [int(c[-1].as_py()) for c in b.columns]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(last, pa.int64(), mask=~same), pa.array(head), pa.array(np.zeros(len(key), bool))], names=names)
    if end is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in end), pa.array([None], pa.int64()), pa.array([False]), pa.array([True])], names=names)


def _neighbours(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, top, row, first) -> (row, other): each row with its key's first and with the one before it by (top, row); and
    the table that this reads."""
    ordered = met.select("key", "top", "row", "first").repartitionByRange("key", "top", "row").sortWithinPartitions("key", "top", "row")
    ordered = freeze(ordered.mapInArrow(trimmed(_lags), "key long, top long, row long, first long, last long, head boolean, tail boolean"), "near-order")
    ends = ordered.filter("head or tail").select("key", "top", "row", "tail").collect()  # two a partition
    across, end = [], None
    for r in sorted(ends):
        if r.tail:
            end = r
        elif end is not None and end["key"] == r["key"]:
            across.append((r["row"], end["row"]))
    inside = ordered.filter("not tail").select("row", F.explode(F.array("first", "last")).alias("other"))
    return inside.unionByName(met.sparkSession.createDataFrame(across, "row long, other long")).filter("other <> row"), ordered


def near_groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, row; row unique and the same at every reading) -> (row, first): ``first`` is the row that
    stands for the document's group, the one of its smallest doc_id, then row; null doc_ids stand last."""
    spark, texts = docs.sparkSession, docs.select("row", "text")
    relieve(spark)
    run = _sketches(*_frequent(texts, docs.count()))
    wide = freeze(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), SKETCH), "near-rows")
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    copies = freeze(wide.groupBy("digest").agg(order.alias("o"), F.count(F.lit(1)).alias("n")).select("digest", F.col("o.row").alias("lead"), F.col("o.doc_id").alias("lead_id"), "n"), "near-copies")
    leads = freeze(copies.select(F.col("lead").alias("row")).join(wide.drop("digest", "doc_id"), "row"), "near-leads")
    rows = freeze(wide.select("row", "digest"), "near-digests")
    discard(wide)
    relieve(spark)

    keyed = leads.select("row", "top", F.explode("keys").alias("key"))
    firsts = freeze(keyed.groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-keys")
    met = lookup(keyed, firsts, "key", "n").filter("first is not null")
    pairs, ordered = _neighbours(met)
    pairs = pairs.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))
    of_print = freeze(leads.groupBy("fp").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "near-prints")
    close = trie_edges(of_print.select("fp"), DISTANCE)
    close = close.join(of_print.select(F.col("fp").alias("a"), F.col("row").alias("ra")), "a").join(of_print.select(F.col("fp").alias("b"), F.col("row").alias("rb")), "b")
    close = close.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    same = lookup(leads.select("row", "fp"), of_print.select("fp", F.col("row").alias("a"), "n"), "fp", "n").filter("a <> row").select("a", F.col("row").alias("b"))
    pairs = freeze(pairs.unionByName(close).unionByName(same).distinct(), "near-pairs")
    discard(firsts, ordered, of_print)
    relieve(spark)

    links = _verified(texts, _allowed(pairs, leads))
    ties = freeze(components(links), "near-ties")
    relieve(spark)
    more = _pairs_apart(leads, ties)
    apart = _verified(texts, more)
    tied = freeze(components(links.unionByName(apart)), "near-components")
    discard(pairs, links, ties, more, apart)
    relieve(spark)

    member = copies.join(tied.withColumnRenamed("node", "lead"), "lead", "left").withColumn("root", F.coalesce("root", "lead"))
    first = F.min(F.struct(F.col("lead_id").isNull(), "lead_id", "lead")).alias("o")
    best = member.groupBy("root").agg(first).select("root", F.col("o.lead").alias("first"))
    member = freeze(member.join(best, "root").select("digest", "first", "n"), "near-members")
    found = freeze(lookup(rows.select("row", "digest"), member, "digest", "n").select("row", "first"), "near-found")
    discard(rows, copies, leads, tied, member)
    return found


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest doc_id.

    Texts of equal words (A to Z lower-cased) are copies; texts without words are copies of each other, and a text of any
    length is read whole. Repeated rows leave one; null doc_ids stand behind all others. No rows give no rows, and all columns
    pass through, whatever their names.
    """
    rows, row = numbered(docs)
    with configured(docs.sparkSession, SMALL_BATCHES):
        found = near_groups(rows.select("doc_id", "text", F.col(row).alias("row")))
    kept = found.filter("row = first").select(F.col("row").alias(row))
    return rows.join(kept.hint("merge"), row, "left_semi").select(*columns_of(docs))
