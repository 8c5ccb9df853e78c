"""Document scoring by a hashed maximum-entropy language model.

A word's probability is that of its class given the words before it, times its share of its class (a class-factored
softmax). Classes come from a softmax over hashed n-gram features (last word, last two) and skip features (the word
before last, the one before that). Inside a class a second softmax, by the word before, decides between the class's
``SLOTS - 1`` most frequent words and the rest, which share by count. Words beyond the ``HEAD`` most frequent ones form one
class of their own, in which words seen twice or more share by count and words seen once stand in for unseen ones.

Frequent words are clustered into classes by the words that they stand between (counts of hashed neighbours at each of their
places in the training texts); other head words join the class whose words they are spelled like.

Counting covers every training token: each task counts its own and a shuffle adds them up. Then every text is written once as
its words' codes, in folders by slice, and training and scoring read those. The same pass counts neighbours, since only
then it is known which words are the frequent ones. Training goes in rounds over disjoint slices of all training documents: at most ``TRAINERS`` tasks take sparse gradient steps from the round's weights, and
their changes are averaged, block by block, in streaming sums. Scoring runs in sparse numpy batches. Words beyond the head are too
many to send to every task, so their counts come by a join, summed per document; by their rank none of them is frequent.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, freeze

HEAD, CLASSES, BITS, ROUNDS = 1 << 18, 32, 14, 4
SLOTS, KNOWN, CONTEXTS, BEFORE = 32, 16_384, 4096, 223  # words of a class; words clustered by use; words that count as contexts; those inside a class
FOLDS, HELD_OUT = 7, 2
TAIL, BUCKETS, NEIGHBOURS = CLASSES - 1, 256, 32
TOKENS_A_BATCH, TOKENS_A_STEP, BLOCKS, TRAINERS = 100_000, 40_000, 64, 4096
DISTINCT_A_RUN, SEEN_A_RUN = 300_000, 32  # distinct words that a task counts at once; see _counted
USES, PLACES_A_RUN = -2, 1 << 20  # the slice that holds counts of neighbours; places whose neighbours are counted at once
END = b""  # the end token: no word is empty


def tokens(text: str | None) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END] if text else [END]


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _counted(words: list[bytes], ids: np.ndarray, uses: bool = True) -> pa.RecordBatch:
    """A run of tokens, as positions among its distinct words -> (word, c), and with ``uses`` a view of the run by itself,
    (word, c, use): ``use`` holds for the words seen SEEN_A_RUN times in it how often which hashed words stand before and
    behind them. The model takes no uses from here: ``encoded`` counts those of its words at every place."""
    c = np.bincount(ids, minlength=len(words))
    if not uses:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c)], names=["word", "c"])
    often = np.flatnonzero(c >= SEEN_A_RUN)
    place = np.full(len(words), -1)
    place[often] = np.arange(len(often))
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % NEIGHBOURS
    end = bucket.dtype.type(zlib.crc32(END) % NEIGHBOURS)
    code = place[ids] * (2 * NEIGHBOURS)
    known = code >= 0
    before = np.append(end, bucket[ids[:-1]]) if len(ids) else bucket[ids]
    behind = np.append(bucket[ids[1:]], end) if len(ids) else bucket[ids]
    n = len(often) * 2 * NEIGHBOURS
    use = np.bincount(code[known] + before[known], minlength=n) + np.bincount(code[known] + NEIGHBOURS + behind[known], minlength=n)
    lists = np.full(len(words), None, object)
    for i, row in zip(often.tolist(), use.reshape(-1, 2 * NEIGHBOURS), strict=True):
        lists[i] = row
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(lists, pa.list_(pa.int64()))], names=["word", "c", "use"])


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over the whole texts of ``docs``, the end token included: a word's counts lie in several rows, one of each
    run of tokens that holds it."""

    def run(batches):
        seen: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        for b in batches:
            for t in b.column(0):
                w = tokens(t.as_py())
                held.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int32, len(w)))
                if len(seen) > DISTINCT_A_RUN:
                    yield _counted(list(seen), np.concatenate(held), uses=False)
                    seen, held = {}, []
        if held:
            yield _counted(list(seen), np.concatenate(held), uses=False)

    return docs.select("text").mapInArrow(run, "word binary, c long")


def spelling(words: list[bytes], width: int = 64) -> np.ndarray:
    """Unit vectors of hashed letter pairs and triples, the bounds of the word included."""
    text = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    out = np.zeros(len(words) * width, np.float32)
    for n in (2, 3):
        h = np.zeros(max(len(text) - n + 1, 0), np.uint32)
        for k in range(n):
            h = (h ^ text[k:k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        ok = owner[:len(h)] == owner[n - 1:]
        sign = np.where(h[ok] & np.uint32(1 << 20), 1.0, -1.0)
        out += np.bincount(owner[:len(h)][ok] * width + h[ok] % np.uint32(width), weights=sign, minlength=len(out)).astype(np.float32)
    out = out.reshape(-1, width)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _clusters(x: np.ndarray, weight: np.ndarray, k: int, seed: int = 7, turns: int = 15) -> np.ndarray:
    """Spherical k-means of unit rows: the cluster of each."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())] if len(x) > k else x
    at = np.zeros(len(x), np.int64)
    for _ in range(turns):
        at = (x @ centre.T).argmax(axis=1)
        for j in range(len(centre)):
            own = at == j
            if own.any():
                m = weight[own] @ x[own]
                centre[j] = m / max(float(np.linalg.norm(m)), 1e-6)
    return at


def word_classes(words: list[bytes], counts: np.ndarray, use: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word. The first words, as many as ``use`` has rows, are clustered by use (how much more often than by
    chance each hashed neighbour is theirs); the others join the class whose words, on average, are spelled most like them."""
    if not words:
        return np.zeros(0, np.int64)
    if len(use) == 0:
        return _clusters(spelling(words), np.log1p(counts), classes)
    by_spelling = spelling(words[:len(use)])
    chance = use.sum(axis=0, keepdims=True) / max(use.sum(), 1)
    total = use.sum(axis=1, keepdims=True)
    x = np.maximum(np.log((use + chance) / ((total + 1) * chance + 1e-12)), 0)
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    at = _clusters(x, np.sqrt(counts[:len(use)]), classes)
    centre = np.zeros((classes, by_spelling.shape[1]), np.float32)
    np.add.at(centre, at, by_spelling * np.log1p(counts[:len(use), None]).astype(np.float32))
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
    rest = [(spelling(words[i:i + 20_000]) @ centre.T).argmax(axis=1) for i in range(len(use), len(words), 20_000)]
    return np.concatenate([at, *rest])


class Model:
    """Vocabulary head, its classes and shares, and the weights of both softmaxes."""

    def __init__(self, words, counts, total, distinct, once, use=None):
        """``use``: of the first words, the counts of their hashed neighbours."""
        counts = np.asarray(counts, np.float64)
        use = np.zeros((0, 2 * NEIGHBOURS)) if use is None else np.asarray(use, np.float64)
        self.total, self.distinct, n = int(total), int(distinct), len(counts)
        self.rank = {w: i for i, w in enumerate(words)}
        self.cls = np.append(word_classes(list(words), counts, use, TAIL), TAIL).astype(np.int64)
        mass = np.bincount(self.cls[:-1], weights=counts, minlength=CLASSES)
        rare = self.total - counts.sum()
        mass[TAIL] = rare
        held = (mass > 0) | (np.arange(CLASSES) == TAIL)  # a class without words gets no probability
        self.bias = np.where(held, np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES)), -1e9).astype(np.float32)
        # a class's most frequent words have slots of their own, all others share the last
        order = np.argsort(self.cls[:-1], kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.searchsorted(self.cls[:-1][order], self.cls[:-1][order])
        self.slot = np.append(np.minimum(place, SLOTS - 1), SLOTS - 1)
        cell = self.cls[:-1] * SLOTS + self.slot[:-1]
        inside = np.bincount(cell, weights=counts, minlength=CLASSES * SLOTS)
        with np.errstate(divide="ignore"):
            shares = np.log(inside.reshape(CLASSES, SLOTS) / np.maximum(mass, 1e-300)[:, None])
        shares[TAIL, SLOTS - 1] = 0.0
        self.inner_bias = np.maximum(shares, -1e9).astype(np.float32)
        self.inner = np.append(np.log(counts / inside[cell]) if n else counts, 0.0)
        self.plus = np.append(np.log10(counts + 1), 0.0)
        self.weights = np.zeros((1 << BITS, CLASSES), np.float32)
        self.inner_weights = np.zeros(((BEFORE + CLASSES + 1) * CLASSES, SLOTS), np.float32)
        # the rare class: words seen twice or more by count, words seen once and unseen ones alike
        ones = once if n == 0 or counts.min() > 1 else max(0, once - int((counts == 1).sum()))
        self.often = max(rare - ones, 0.0)
        share = (ones + 1) / (ones + self.often + 2)
        self.log_often, self.log_once = float(np.log10(1 - share)), float(np.log10(share) - np.log10(ones + 1))

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Head rank of each word; from len(head) on, rare words by a bucket of their first and last letters."""
        n, get = len(self.rank), self.rank.get
        out = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(out < 0)
        out[rare] = [n + ((words[i][0] * 31 + words[i][-1]) & (BUCKETS - 1) if words[i] else 0) for i in rare.tolist()]
        return out

    def places(self, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Head rank or len(head), hashed features (feature, token), and the row of each token's inner softmax. start:
        position of each token's document."""
        n = len(self.rank)
        ids = np.minimum(codes, n).astype(np.int64)
        cls = np.take(self.cls, ids)
        context = np.where(ids < min(CONTEXTS, n), ids, CONTEXTS + cls)
        rare = np.flatnonzero(ids == n)
        context[rare] = CONTEXTS + CLASSES + codes[rare] - n
        at, blank = np.arange(len(ids)), CONTEXTS + CLASSES + BUCKETS
        back = [np.where(at - k >= start, context[np.maximum(at - k, 0)], blank).astype(np.uint64) for k in (1, 2, 3)]
        m = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        mixed = [back[0] * m[0], back[0] * m[0] + (back[1] + np.uint64(1)) * m[1] + np.uint64(1), back[1] * m[1] + np.uint64(2), back[2] * m[2] + np.uint64(3)]
        features = np.empty((len(mixed), len(ids)), np.int64)
        for k, h in enumerate(mixed):
            h = (h ^ (h >> np.uint64(31))) * m[1]
            features[k] = ((h ^ (h >> np.uint64(29))) * m[0]) >> np.uint64(64 - BITS)
        last = np.maximum(at - 1, 0)
        before = np.where(at > start, np.where(ids[last] < min(BEFORE, n), ids[last], BEFORE + cls[last]), BEFORE + CLASSES)
        return ids, features, before * CLASSES + cls

    def logits(self, features: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the classes by ``features``, and of the slots of the class by ``rows`` and ``cls``: (token, class), (token,
        slot). The rare class has one slot, of probability one, so its tokens need no rows."""
        z = np.take(self.weights, features[0], axis=0)
        for f in features[1:]:
            z += np.take(self.weights, f, axis=0)
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        v = np.take(self.inner_weights, rows, axis=0)
        v += np.take(self.inner_bias, cls, axis=0)
        v -= v.max(axis=1, keepdims=True)
        return z, v

    def log_probs(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """By document, given as its words' codes: natural log probability but for the shares inside the rare class, and log10
        of (count + 1) summed over head words."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        first = np.cumsum(sizes) - sizes
        ids, features, rows = self.places(np.concatenate(docs), np.repeat(first, sizes))
        cls, slot, value = self.cls[ids], self.slot[ids], np.empty(len(ids))
        for i in range(0, len(ids), TOKENS_A_STEP):
            part = slice(i, i + TOKENS_A_STEP)
            inner = i + np.flatnonzero(cls[part] != TAIL)
            z, v = self.logits(features[:, part], rows[inner], cls[inner])
            value[part] = z[np.arange(len(z)), cls[part]]
            value[inner] += v[np.arange(len(v)), slot[inner]]
            value[part] -= np.log(np.exp(z, out=z).sum(axis=1))
            value[inner] -= np.log(np.exp(v, out=v).sum(axis=1))
        value += self.inner[ids]
        return np.add.reduceat(value, first), np.add.reduceat(self.plus[ids], first)

    def step(self, docs: list[np.ndarray], squares: list[np.ndarray], rate: float) -> None:
        """Adagrad steps on both softmaxes over the documents' codes."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ids, features, rows = self.places(np.concatenate(docs), np.repeat(np.cumsum(sizes) - sizes, sizes))
        cls, slot = self.cls[ids], self.slot[ids]
        for i in range(0, len(ids), TOKENS_A_STEP):
            part = slice(i, i + TOKENS_A_STEP)
            inner = i + np.flatnonzero(cls[part] != TAIL)
            both = self.logits(features[:, part], rows[inner], cls[inner])
            for z, own in zip(both, (cls[part], slot[inner]), strict=True):
                np.exp(z, out=z)
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(z)), own] -= 1
            self._descend(self.weights, squares[0], features[:, part], both[0], rate)
            self._descend(self.inner_weights, squares[1], rows[None, inner], both[1], rate)

    @staticmethod
    def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, errors: np.ndarray, rate: float) -> None:
        """One step of weights (row, output) by the errors (token, output) summed over the tokens of each row; ``rows``:
        (feature, token). ``squares`` lies the other way round, as the sums come."""
        grad = np.empty(squares.shape, np.float32)
        for j, e in enumerate(np.ascontiguousarray(errors.T).astype(np.float64)):
            total = np.bincount(rows[0], weights=e, minlength=len(weights))
            for r in rows[1:]:
                total += np.bincount(r, weights=e, minlength=len(weights))
            grad[j] = total
        squares += grad * grad
        size = np.sqrt(squares)
        size += 1
        grad /= size
        grad *= np.float32(rate)
        weights -= grad.T


def _model(state: dict) -> Model:
    model = Model.__new__(Model)
    vars(model).update(state)
    return model


def _batches_of(column, read=len, most: int = TOKENS_A_BATCH):
    """Runs of what ``read`` makes of the column's values, of about ``most`` tokens."""
    held, size = [], 0
    for t in column:
        held.append(read(t.as_py()))
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(NEIGHBOURS)


def encoded(docs: DataFrame, head: list[bytes], slices) -> DataFrame:
    """``docs`` (doc_id, text) tokenised once: a table (doc_id, n_tokens, codes, rare: the words that have no code of their
    own, as often as they occur, row) in folders by ``slices``, so that a round of training reads its own slice alone.
    ``head``: the words that have codes. The slice USES holds, a row for each task and block (as doc_id) of the first KNOWN
    of them, how often which hashed words stand before and behind them in the texts of slices from 0 on."""
    sent = docs.sparkSession.sparkContext.broadcast({"rank": {w: i for i, w in enumerate(head)}})
    n, known, wide = len(head), min(KNOWN, len(head)), 2 * NEIGHBOURS
    hashed = docs.sparkSession.sparkContext.broadcast(np.append(_buckets(head), np.uint32(0)))

    def run(batches):
        own, end = _model(sent.value), zlib.crc32(END) % NEIGHBOURS
        use, cells, held = np.zeros(known * wide, np.int64), [], 0
        for b in batches:
            size, codes, rare, many = [], [], [], []
            learnt, done = b.column(2).to_numpy() >= 0, 0
            for part in _batches_of(b.column(1), tokens):
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                flat = [w for d in part for w in d]
                all_codes = own.codes(flat)
                at = np.flatnonzero(all_codes >= n)
                ends = np.cumsum(sizes)
                many.append(np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(part)))
                others = [flat[i] for i in at.tolist()]
                rare += others
                codes += [c.tobytes() for c in np.split(all_codes, ends[:-1])]
                size.append(sizes)
                bucket = hashed.value[np.minimum(all_codes, n)]
                bucket[at] = _buckets(others)
                before, behind = np.append(np.uint32(end), bucket[:-1]), np.append(bucket[1:], np.uint32(end))
                behind[ends - 1] = end  # nothing stands behind a text's end, and another text's end before its first word
                places = np.flatnonzero((all_codes < known) & np.repeat(learnt[done:done + len(part)], sizes))
                first = all_codes[places] * wide
                cells += [first + before[places], first + NEIGHBOURS + behind[places]]
                done, held = done + len(part), held + len(places)
                if held >= PLACES_A_RUN:
                    use += np.bincount(np.concatenate(cells), minlength=len(use))
                    cells, held = [], 0
            if size:
                cuts = np.append(0, np.cumsum(np.concatenate(many))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare, pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(size)), pa.array(codes, pa.binary()), lists, b.column(2)], names=["doc_id", "n_tokens", "codes", "rare", "slice"])
        if held:
            use += np.bincount(np.concatenate(cells), minlength=len(use))
        for k in range(BLOCKS if use.any() else 0):
            own_block = use[known * k // BLOCKS * wide:known * (k + 1) // BLOCKS * wide]
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0]), pa.array([own_block.tobytes()], pa.binary()), pa.array([[]], pa.list_(pa.binary())), pa.array([USES], b.column(2).type)], names=["doc_id", "n_tokens", "codes", "rare", "slice"])

    rows = docs.select("doc_id", "text", slices.cast("int").alias("slice")).mapInArrow(run, "doc_id long, n_tokens long, codes binary, rare array<binary>, slice int")
    return freeze(rows.withColumn("row", F.monotonically_increasing_id()), "lm-codes", by="slice", codec="zstd")


def uses(codes: DataFrame, known: int) -> np.ndarray:
    """The counts of neighbours in ``codes`` (``encoded``), summed by block in streams: (one of the ``known`` words, hashed word before
    or behind)."""
    wide = 2 * NEIGHBOURS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(part, np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], names=["block", "use"])

    parts = codes.filter(F.col("slice") == USES).select(F.col("doc_id").alias("block"), "codes")
    out = np.zeros(known * wide, np.int64)
    for r in parts.repartition(BLOCKS, "block").mapInArrow(add, "block long, use binary").collect():  # KNOWN words' at most
        out[known * r["block"] // BLOCKS * wide:known * (r["block"] + 1) // BLOCKS * wide] = np.frombuffer(r["use"], np.int64)
    return out.reshape(known, wide)


def train_round(docs: DataFrame, model: Model, rate: float) -> np.ndarray:
    """One round over ``docs`` (codes): each task takes gradient steps from the model's weights; the changes, weighted by
    the tokens behind them, are summed by block in streams. Returns the mean change, of the weights' fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # head, classes, weights: fixed by HEAD and BITS
    whole = model.weights.size + model.inner_weights.size
    cuts = [whole * i // BLOCKS for i in range(BLOCKS + 1)]

    def run(batches):
        own, seen = _model(sent.value), 0
        before = np.concatenate([own.weights.ravel(), own.inner_weights.ravel()])
        own.weights, own.inner_weights = own.weights.copy(), own.inner_weights.copy()
        squares = [np.zeros_like(own.weights.T, order="C"), np.zeros_like(own.inner_weights.T, order="C")]
        for b in batches:
            for part in _batches_of(b.column(0), _codes):
                own.step(part, squares, rate)
                seen += sum(map(len, part))
        if seen:
            change = (np.concatenate([own.weights.ravel(), own.inner_weights.ravel()]) - before) * np.float32(seen)
            for k in range(BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([seen]), pa.array([change[cuts[k]:cuts[k + 1]].tobytes()], pa.binary())], names=["block", "n", "change"])

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, change in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = sums.setdefault(k, [0, np.zeros(cuts[k + 1] - cuts[k])])
                s[0] += n
                s[1] += np.frombuffer(change, np.float32)
        for k, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["block", "change"])

    found = docs.select("codes").coalesce(TRAINERS).mapInArrow(run, "block long, n long, change binary")
    found = found.repartition(BLOCKS, "block").mapInArrow(add, "block long, change binary").collect()
    out = np.zeros(whole, np.float32)
    for r in found:
        out[cuts[r["block"]]:cuts[r["block"] + 1]] = np.frombuffer(r["change"], np.float32)
    sent.unpersist()
    return out


def head_count(counts: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` words have it or more, from how many words have each count: one row
    per value, so no task and not the driver sorts the words."""
    values = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy(F.col("c").desc()))
    found = values.withColumn("upto", upto).filter(F.col("upto") <= head).agg(F.min("c")).first()[0]
    return found if found is not None else 1 << 62


def vocabulary(counts: DataFrame, least: int) -> tuple[list[bytes], np.ndarray, int, int, int]:
    """The head's words and counts, the most frequent first, and of all training tokens their number, that of the distinct
    ones and that of those seen once. ``counts``: (word, c); ``least``: the count from which a word belongs to the head."""
    total, distinct, once = counts.agg(F.sum("c"), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    top = counts.filter(F.col("c") >= least).toArrow()  # at most head rows
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return [words[i] for i in order], c[order], total or 0, distinct, once


def fit(codes: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``model`` trained on the slices 0 to ``rounds`` - 1 of ``codes`` (``encoded``), one a round."""
    for k in range(rounds):
        change = train_round(codes.filter(F.col("slice") == k), model, 0.5)
        model.weights = model.weights + change[:model.weights.size].reshape(model.weights.shape)
        model.inner_weights = model.inner_weights + change[model.weights.size:].reshape(model.inner_weights.shape)
    return model


def score_documents(docs: DataFrame, learn, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learn``: condition for training rows. Null texts count as empty: the end token alone. Null doc_ids are kept and
    belong to the fold of the empty string. Repeated rows count and score as often as they occur; a text of any length is
    read whole. Words of equal count stand in the head together or not at all. With no training rows every word is unseen
    and score equals base_score. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    train = docs.filter("learn")
    parts = freeze(counted(train), "lm-parts", codec="zstd")
    counts = freeze(parts.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    least = head_count(counts, head)
    discard(parts)
    words, *numbers = vocabulary(counts, least)
    round_of = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("slice")), F.lit(rounds))
    codes = encoded(docs, words, F.when(F.col("learn"), round_of).otherwise(-1))
    use = uses(codes, min(KNOWN, len(words)))
    model = fit(codes, Model(words, *numbers, use if use.any() else None), rounds)
    texts = codes.filter(F.col("slice") != USES)
    sent = spark.sparkContext.broadcast(vars(model))

    def run(batches):
        own = _model(sent.value)
        for b in batches:
            got = [own.log_probs(part) for part in _batches_of(b.column(4), _codes)]
            if got:
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(np.concatenate(x)) for x in zip(*got, strict=True))], names=["row", "doc_id", "n_tokens", "n_rare", "ln", "plus"])

    scored = texts.select("row", "doc_id", "n_tokens", F.size("rare").cast("long").alias("n_rare"), "codes")
    scored = freeze(scored.mapInArrow(run, "row long, doc_id long, n_tokens long, n_rare long, ln double, plus double"), "lm-scores")
    rare = texts.select("row", F.explode("rare").alias("word"))
    joined = rare.join(counts.filter(F.col("c") < least), "word", "left")
    often = F.col("c") >= 2
    inner = F.when(often, F.lit(model.log_often) + F.log10("c") - F.lit(float(np.log10(max(model.often, 1.0))))).otherwise(F.lit(model.log_once))
    sums = joined.groupBy("row").agg(
        F.count("c").alias("n_seen"),
        F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1)).alias("rare_plus"),
        F.sum(inner).alias("rare_log"),
    )
    sums = freeze(sums, "lm-sums")
    discard(codes, counts)
    n, v = model.total, model.distinct
    base = F.col("plus") + F.coalesce("rare_plus", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    score = F.col("ln") / F.lit(float(np.log(10))) + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_tokens") - F.col("n_rare") + F.coalesce("n_seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (score if n else base).alias("score"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_documents(docs, fold(F.col("doc_id")) != HELD_OUT)
    return out.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
