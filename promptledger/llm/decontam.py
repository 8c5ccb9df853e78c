"""Benchmark decontamination.

A text holds a benchmark item where some window of the item's number of words is 0.8 or more similar to it, by weighted
Jaccard over five-word shingles (weights: how often each occurs). A window that similar shares a shingle with the item,
so only windows over such shingles are looked at; that loses nothing. Their SimHash fingerprints are looked up in a
multi-index over the items' fingerprints: 64 bits in 11 blocks, each probed with up to one bit flipped, which finds
every item within 21 differing bits. At a similarity of 0.8 the differing bits number 10 on average with a standard
deviation of 3, so a miss at 21 is a matter of one in ten thousand at the very edge and rarer above. The exact
similarity decides.

The index is built once by each worker. Benchmarks are sets that people wrote, but their size is checked: beyond ``MOST_WORDS``
they are taken in parts, one pass over the documents each.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, freeze, unused

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 21, 11
MOST_WORDS, WORDS_A_BATCH = 2_000_000, 100_000
CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]

MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())]))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))[ids] if words else np.zeros(0, np.uint64)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, from the words' hashes."""
    n = len(h) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8").reshape(-1)


class Index:
    """Items by length: their shingles with weights, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.lengths = defaultdict(list)  # number of words -> items
        post = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            h = word_hashes(tokens(text))
            if not len(h):
                continue
            width = min(SHINGLE, len(h))
            s = shingles(h, width)
            mine = self.lengths[len(h)]
            for x in set(s.tolist()):
                post[width][x].append((len(h), len(mine)))
            mine.append((item_id, Counter(s.tolist()), len(s), _pack(_bits(s).sum(axis=0) * 2 > len(s))[0]))
        self.post = {w: dict(p) for w, p in post.items()}
        self.keys = {w: np.array(sorted(p), np.uint64) for w, p in self.post.items()}
        self.maybe = {}
        for w, k in self.keys.items():
            self.maybe[w] = np.zeros(1 << 16, bool)
            self.maybe[w][(k >> np.uint64(48)).astype(np.int64)] = True
        self.tables = {}
        for n, mine in self.lengths.items():
            fp = np.array([x[3] for x in mine], np.uint64)
            self.tables[n] = (fp, [self._table(fp, a, b) for a, b in zip(CUTS, CUTS[1:], strict=False)])
        self.lengths = dict(self.lengths)

    @staticmethod
    def _table(fp, low, high):
        """Postings of a block: the items that have each value up to one flipped bit, in a row, and where each value's begin."""
        value = ((fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
        near = value[:, None] ^ np.append(0, 1 << np.arange(high - low))
        order = np.argsort(near.ravel(), kind="stable")
        return order // near.shape[1], np.searchsorted(near.ravel()[order], np.arange((1 << (high - low)) + 1))

    def lookup(self, n: int, fp: np.ndarray) -> np.ndarray:
        """(fingerprint, item of n words) pairs within RADIUS, found by the block postings."""
        own, tables = self.tables[n]
        found = []
        for (low, high), (items, begin) in zip(zip(CUTS, CUTS[1:], strict=False), tables, strict=True):
            value = ((fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)
            size = begin[value + 1] - begin[value]
            at = np.repeat(begin[value] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            found.append(np.repeat(np.arange(len(fp)), size) * len(own) + items[at])
        pairs = np.unique(np.concatenate(found))
        w, i = pairs // len(own), pairs % len(own)
        near = np.bitwise_count(fp[w] ^ own[i]) <= RADIUS
        return np.column_stack([w[near], i[near]])

    def document(self, h: np.ndarray, width: int, hits: np.ndarray, sh: np.ndarray) -> list[tuple]:
        """Best window per item. h: word hashes of one text, sh: its shingles, hits: where those are some item's."""
        spots = defaultdict(list)  # (length, item) -> positions
        for p in hits.tolist():
            for key in self.post[width][int(sh[p])]:
                spots[key].append(p)
        by_length = defaultdict(set)
        for (n, _), at in spots.items():
            by_length[n].update(at)
        best = {}
        for n, at in by_length.items():
            size = min(n, len(h))
            m = size - width + 1
            starts = np.unique(np.concatenate([np.arange(max(0, p - m + 1), min(p, len(h) - size) + 1) for p in at]))
            for part in np.array_split(starts, 1 + len(starts) // 20_000):
                cut = np.flatnonzero(np.diff(part) > 4 * n) + 1  # far apart: counted apart
                for run in np.split(part, cut):
                    low = int(run[0])
                    sums = np.zeros((int(run[-1]) + m - low + 1, 64), np.int32)
                    np.cumsum(_bits(sh[low:int(run[-1]) + m]), axis=0, out=sums[1:])
                    fp = _pack((sums[run - low + m] - sums[run - low]) * 2 > m)
                    for w, i in self.lookup(n, fp).tolist():
                        if (n, i) in spots:
                            self._verify(best, n, i, int(run[w]), size, m, spots[(n, i)], sh)
        return sorted((*k, *v) for k, v in best.items())

    def _verify(self, best, n, i, start, size, m, at, sh):
        item_id, weights, total, _ = self.lengths[n][i]
        lo, hi = np.searchsorted(at, [start, start + m])
        if hi - lo < SIMILARITY / (1 + SIMILARITY) * (m + total) - 1e-9:
            return
        shared = sum(min(c, weights[x]) for x, c in Counter(sh[at[lo:hi]].tolist()).items())
        similarity = shared / (m + total - shared)
        if similarity >= SIMILARITY and ((item_id,) not in best or (-similarity, start) < (-best[(item_id,)][2], best[(item_id,)][0])):
            best[(item_id,)] = (start, size, similarity)

    def search(self, docs: list[list[bytes]]) -> list[list[tuple]]:
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        end = np.cumsum(sizes)
        h = word_hashes([w for d in docs for w in d])
        found: list[dict] = [{} for _ in docs]
        for width, keys in self.keys.items():
            sh = shingles(h, width)
            at = np.flatnonzero(self.maybe[width][(sh >> np.uint64(48)).astype(np.int64)])
            at = at[keys[np.minimum(np.searchsorted(keys, sh[at]), len(keys) - 1)] == sh[at]]
            doc = np.searchsorted(end, at, side="right")
            inside = at + width <= end[doc] if len(at) else at.astype(bool)
            at, doc = at[inside], doc[inside]
            for d in np.unique(doc).tolist():
                first = int(end[d] - sizes[d])
                own = h[first:int(end[d])]
                for item_id, *rest in self.document(own, width, at[doc == d] - first, sh[first:first + len(own) - width + 1]):
                    found[d][item_id] = tuple(rest)
        return [[(k, *v) for k, v in sorted(f.items())] for f in found]


def _parts(benchmark: DataFrame, most_words: int):
    """The items, in runs of at most ``most_words`` words (a longer item alone)."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    held, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(r.text.split())
        if held and size + n > most_words:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


#: The index that this worker built last, by the name of its items' broadcast.
_BUILT: dict[str, Index] = {}


def _with_matches(docs: DataFrame, benchmark: DataFrame, text: str, most_words: int, name: str) -> DataFrame:
    """``docs`` with the matches in a column ``name`` that it does not have."""
    where, out = docs.columns.index(text), docs
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, MATCH)])
    parts = list(_parts(benchmark, most_words)) or [[]]
    for k, part in enumerate(parts):
        sent, token = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches, sent=sent, token=token, more=k > 0):
            if token not in _BUILT:
                _BUILT.clear()
                _BUILT[token] = Index(sent.value)
            index = _BUILT[token]
            for b in batches:
                before = b.columns[-1].to_pylist() if more else [[]] * b.num_rows
                found, pending, size = [], [], 0
                for t in b.column(where):
                    pending.append(tokens(t.as_py()))
                    size += len(pending[-1])
                    if size >= WORDS_A_BATCH:
                        found += index.search(pending)
                        pending, size = [], 0
                found += index.search(pending) if pending else []
                new = []
                for a, f in zip(before, found, strict=True):
                    both = {x["item_id"]: x for x in a}
                    for i, s, n, x in f:
                        if i not in both or x > both[i]["similarity"]:
                            both[i] = {"item_id": i, "start_word": s, "n_words": n, "similarity": x}
                    new.append([both[i] for i in sorted(both)])
                keep = b.columns[:-1] if more else b.columns
                yield pa.RecordBatch.from_arrays([*keep, pa.array(new, kind)], names=schema.names)

        out = out.mapInArrow(run, schema)
        if k < len(parts) - 1:
            out = freeze(out, "decontam")
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` with matches: for each benchmark item in the text its best window (item_id, start_word, n_words,
    similarity), in order of item_id; empty where there is none.

    Null and empty texts match nothing, nor do items without words; items of fewer than five words are compared as one
    shingle. A text shorter than an item is one window. Of windows that tie, the first counts; an item_id that has
    several texts counts once. Repeated rows are all marked; a column named matches is replaced; no rows give no rows.
    """
    return _with_matches(docs.drop("matches"), benchmark, text, most_words, "matches")


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with its columns, whatever their names."""
    name = unused("_matches", docs.columns)
    return _with_matches(docs, benchmark, text, most_words, name).filter(F.size(name) == 0).drop(name)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("similarity"),
    )
