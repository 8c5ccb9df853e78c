"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a word part and a character part: learned embeddings of the hashed word and of its hashed byte
n-grams, and the weight of evidence (smoothed log odds over labelled documents) of the word and of its most telling
n-gram. While training, a document's own label is taken out of the evidence of its words. A text is read in blocks of ``BLOCK`` words that overlap by all but one word of a window; in each
the two recurrent passes run once, and attention pools their states over every run of ``WINDOW`` words. Blocks overlap so
that every such window lies whole in one of them: all windows are scored, one starting at every word, and a document's
score is that of its worst. A window's states know the words of its block around it.

Gates and states bend by x / (1 + abs x) in place of the hyperbolic tangent, which costs numpy six times as much.

Labels name documents, not windows, so training picks each document's highest window, fits on those, and picks again. The
first pick goes by the evidence alone. Training uses a bounded sample of labelled rows
(``SAMPLE`` of either class, none over ``SAMPLE_CHARS`` characters); scoring covers everything.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, trimmed, unused

WINDOW, BLOCK, HIDDEN = 24, 64, 8
STARTS = BLOCK - WINDOW + 1  # windows that begin in a block, and the words from one block to the next
SAMPLE, SAMPLE_CHARS, THRESHOLD = 2000, 20_000, 0.7
GRAMS, BITS, EMB, EMB_BITS = (4, 5, 6), 20, 6, 14
INPUTS = 2 + 2 * EMB
WORDS_A_BATCH, WORDS_A_RUN, BLOCKS_A_STEP = 200_000, 20_000, 1024
RATE, DECAY = 0.01, 0.98  # of the gradient steps; decay of the embeddings

_SPACES = bytes.maketrans(b".,;:!?\"()[]{}*#", b" " * 15)


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split() if text else []


def _ids(docs) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words, and each document as positions among them."""
    seen: dict[bytes, int] = {}
    out = [np.fromiter((seen.setdefault(w, len(seen)) for w in d), np.int64, len(d)) for d in docs]
    return list(seen), out


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all byte n-grams of the words (a caret before each), and the word each belongs to."""
    text = b"".join(b"^" + w for w in words)
    a = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(a))  # bytes from here to the word's end
    hashes, owners = [], []
    for n in GRAMS:
        h = np.full(max(len(a) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h + a[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = left[: len(h)] >= n
        hashes.append(h[ok])
        owners.append(word[: len(h)][ok])
    h, w = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(w, kind="stable")
    return h[order], w[order]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _per_word(values: np.ndarray, owner: np.ndarray, n: int, how) -> np.ndarray:
    """``how`` (a ufunc) over each word's grams; 0 where a word has none. Owners are sorted."""
    out = np.zeros((n, *values.shape[1:]), np.float32)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = how.reduceat(values, first, axis=0)
    return out


def _layout(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in steps of ``STARTS`` words: word positions (``pad`` where there are none), and of each
    step its document, its first word and the last window that begins in it (-1: none). Each document ends with a
    step that holds the rest of its last block and begins no window."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    steps = np.maximum(size - WINDOW, 0) // STARTS + 2
    flat = np.full((int(steps.sum()) + 1) * STARTS, pad, np.int64)
    begin = (np.cumsum(steps) - steps) * STARTS
    for d, i in zip(docs, begin.tolist(), strict=True):
        flat[i:i + len(d)] = d
    doc = np.repeat(np.arange(len(docs)), steps)
    first = np.arange(len(doc)) * STARTS - begin[doc]
    last = np.minimum(np.maximum(size[doc] - WINDOW, 0) - first, STARTS - 1)
    last[np.cumsum(steps) - 1] = -1
    return flat, doc, first, last


def _bend(x: np.ndarray, work: np.ndarray) -> None:
    """x / (1 + abs x), in place."""
    np.abs(x, out=work)
    work += 1
    x /= work


def _runs(x: np.ndarray) -> np.ndarray:
    """Sums of every ``WINDOW`` (16 + 8) rows in a row: of positive numbers only, so that nothing cancels."""
    two = x[:-1] + x[1:]
    four = two[:-2] + two[2:]
    eight = four[:-4] + four[4:]
    return eight[:STARTS] + eight[8:STARTS + 8] + eight[16:STARTS + 16]


class Model:
    """Parameters of the network, and the weight of evidence of hashed words and n-grams."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        e, h = INPUTS, HIDDEN
        draw = lambda *s: (rng.normal(0, 0.3, s)).astype(np.float32)
        self.p = {"out": draw(2 * h), "att": draw(2 * h), "bias": np.zeros(1, np.float32), "word": 0.1 * draw(1 << EMB_BITS, EMB), "char": 0.1 * draw(1 << EMB_BITS, EMB)}
        for d in "fb":
            self.p |= {f"W{d}": draw(e, 3 * h), f"U{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
            self.p[f"W{d}"][:2, 2 * h:2 * h + 2] += 0.5 * np.eye(2, dtype=np.float32)  # evidence starts with a way through
        for k in ("out", "att"):
            self.p[k][[0, 1, h, h + 1]] = 1.0
        self.word_odds = self.gram_odds = np.zeros(1 << BITS, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """A row per word, and one of zeros for a place without a word."""
        if not words:
            return np.zeros((1, INPUTS), np.float32)
        g, owner = _grams(words)
        w = _word_hashes(words)
        odds = _per_word(np.take(self.gram_odds, (g >> np.uint64(64 - BITS)).astype(np.int64)), owner, len(words), np.maximum)
        char = _per_word(np.take(self.p["char"], (g >> np.uint64(64 - EMB_BITS)).astype(np.int64), axis=0), owner, len(words), np.add)
        return _joined(self.word_odds[w >> np.uint32(32 - BITS)], odds, self.p["word"][w >> np.uint32(32 - EMB_BITS)], char, np.bincount(owner, minlength=len(words)))

    def highest(self, x: np.ndarray, flat: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each step, the highest logit of the windows that begin in it (minus infinity where none does) and where
        it begins. x: inputs by word, the last row for no word; ``flat`` and ``last`` as ``_layout`` gives them."""
        h, f32, n_steps = HIDDEN, np.float32, len(last)
        best, where = np.full(n_steps, -np.inf, f32), np.zeros(n_steps, np.int64)
        starts = np.arange(STARTS)[:, None]
        for i in range(0, n_steps, BLOCKS_A_STEP):
            n = min(BLOCKS_A_STEP, n_steps - i)
            ids = flat[i * STARTS:(i + n + 1) * STARTS]
            rows = np.take(x, ids, axis=0)
            live = np.ascontiguousarray((ids < len(x) - 1).reshape(n + 1, STARTS).T).astype(f32)
            at = lambda grid, t, n=n: grid[t][..., :n] if t < STARTS else grid[t - STARTS][..., 1:n + 1]
            alive = np.stack([at(live, t) for t in range(BLOCK)])
            heads = np.zeros((BLOCK, 2, n), f32)
            work = np.empty((2 * h, n), f32)
            for d, order in (("f", range(BLOCK)), ("b", range(BLOCK - 1, -1, -1))):
                own = slice(0, h) if d == "f" else slice(h, 2 * h)
                read = np.stack([self.p["att"][own], self.p["out"][own]])
                given = (rows @ self.p[f"W{d}"] + self.p[f"b{d}"]).astype(f32)
                given = np.ascontiguousarray(given.reshape(n + 1, STARTS, 3 * h).transpose(1, 2, 0))
                turn = np.ascontiguousarray(self.p[f"U{d}"].T)
                turn[2 * h:] *= 0.5
                s, b = np.zeros((h, n), f32), np.empty((3 * h, n), f32)
                for t in order:
                    a = at(given, t)
                    np.matmul(turn, s, out=b)
                    zr, c = b[:2 * h], b[2 * h:]
                    zr += a[:2 * h]
                    _bend(zr, work)
                    zr += 1  # twice the update and reset gates
                    c *= zr[h:]
                    c += a[2 * h:]
                    _bend(c, work[:h])
                    c -= s
                    c *= zr[:h]
                    c *= alive[t] * f32(0.5)
                    s += c
                    heads[t] += read @ s
            pull = heads[:, 0] + (alive - 1) * f32(1e4)
            pull = np.exp((pull - pull.max(axis=0)).astype(np.float64))
            value = _runs(pull * heads[:, 1]) / np.maximum(_runs(pull), 1e-300) + float(self.p["bias"][0])
            value[starts > last[None, i:i + n]] = -np.inf
            where[i:i + n] = value.argmax(axis=0)
            best[i:i + n] = value[where[i:i + n], np.arange(n)]
        return best, where

    def step(self, x: np.ndarray, live: np.ndarray, pool: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the mean cross-entropy for a batch, those of the inputs, and the logits. x: (time, batch, inputs);
        live: (time, batch, 1), places with a word; pool: (time, batch), those of them in the window."""
        h, p, grad, kept = HIDDEN, self.p, {}, {}
        steps, n = x.shape[:2]
        states = np.zeros((steps, n, 2 * h), x.dtype)
        for d in "fb":
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            s, rows = np.zeros((n, h), x.dtype), {}
            given = x @ p[f"W{d}"] + p[f"b{d}"]
            for t in order:
                b = s @ p[f"U{d}"]
                zr = given[t, :, :2 * h] + b[:, :2 * h]
                wide = 1 + np.abs(zr)
                zr = 0.5 + 0.5 * zr / wide
                c = given[t, :, 2 * h:] + zr[:, h:] * b[:, 2 * h:]
                far = 1 + np.abs(c)
                c = c / far
                rows[t] = (s, zr, wide, c, far, b[:, 2 * h:])
                s = s + live[t] * zr[:, :h] * (c - s)
                states[t, :, slice(0, h) if d == "f" else slice(h, 2 * h)] = s
            kept[d] = rows
        e = states @ p["att"] + (pool - 1) * 1e4
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        value = states @ p["out"]
        mean = (alpha * value).sum(axis=0)
        logit = mean + p["bias"][0]
        dlogit = (_sigmoid(logit) - y) / n
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        de = alpha * (value - mean) * dlogit
        ds = alpha[:, :, None] * dlogit[:, None] * p["out"] + de[:, :, None] * p["att"]
        grad |= {"out": dlogit @ pooled, "bias": np.array([dlogit.sum()]), "att": np.einsum("tb,tbh->h", de, states)}
        dx = np.zeros_like(x)
        for d in "fb":
            w, u = p[f"W{d}"], p[f"U{d}"]
            da, dbb = np.zeros((steps, n, 3 * h), x.dtype), np.zeros((steps, n, 3 * h), x.dtype)
            before = np.zeros((steps, n, h), x.dtype)
            back = np.zeros((n, h), x.dtype)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                s, zr, wide, c, far, un = kept[d][t]
                z, r = zr[:, :h], zr[:, h:]
                g = back + ds[t][:, slice(0, h) if d == "f" else slice(h, 2 * h)]
                gl = g * live[t]
                dn = gl * z / (far * far)
                gates = np.concatenate([gl * (c - s), dn * un], axis=1) * 0.5 / (wide * wide)
                da[t] = np.concatenate([gates, dn], axis=1)
                dbb[t] = np.concatenate([gates, dn * r], axis=1)
                before[t] = s
                back = g - gl * z + dbb[t] @ u.T
            dx += da @ w.T
            grad |= {f"W{d}": np.tensordot(x, da, ([0, 1], [0, 1])), f"U{d}": np.tensordot(before, dbb, ([0, 1], [0, 1])), f"b{d}": da.sum(axis=(0, 1))}
        return grad, dx, logit

    def document_logits(self, docs: list[list[bytes]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        words, ids = _ids(docs)
        flat, doc, _, last = _layout(ids, len(words))
        best, _ = self.highest(self.inputs(words), flat, last)
        return np.maximum.reduceat(best, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(logits, np.float64) + self.shift, -50, 50)))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _joined(word_odds, gram_odds, word, char, n_grams) -> np.ndarray:
    """Inputs of words, and a last row of zeros."""
    out = np.zeros((len(word_odds) + 1, INPUTS), np.float32)
    out[:-1, 0], out[:-1, 1], out[:-1, 2:2 + EMB] = word_odds, gram_odds, word
    out[:-1, 2 + EMB:] = char / np.maximum(n_grams, 1)[:, None].astype(np.float32)
    return out


def _odds(pos, neg, n_pos, n_neg):
    """Smoothed log odds, 0 for what no document holds, in units of about one for a word of a few documents."""
    share = n_pos / max(n_pos + n_neg, 1)
    return 0.5 * (np.log((pos + share + 1e-9) / (n_pos + 1)) - np.log((neg + 1 - share) / (n_neg + 1)) - np.log((share + 1e-9) / (n_pos + 1)) + np.log((1 - share) / (n_neg + 1)))


def train(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 5, rounds: int = 3, steps: int = 50, batch: int = 96) -> Model:
    """Fit on labelled texts. ``prior``: the share of toxic rows among all labelled ones, to which scores are set."""
    model, rng = Model(seed), np.random.default_rng(seed)
    y = np.asarray(toxic, np.float32)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if not n_pos or not n_neg:
        model.p = {k: v * 0 for k, v in model.p.items()}
        model.shift = 3.0 if n_pos else -3.0
        return model
    words, ids = _ids(map(tokens, texts))
    parts = [(np.zeros(0, np.int32),) * 3]  # in short runs and small types, for the driver's memory
    for i in range(0, len(words), WORDS_A_RUN):
        g, owner = _grams(words[i:i + WORDS_A_RUN])
        parts.append(((g >> np.uint64(64 - BITS)).astype(np.int32), (g >> np.uint64(64 - EMB_BITS)).astype(np.int32), (owner + i).astype(np.int32)))
    gb, gc, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    wh = _word_hashes(words)
    wb, wc = wh >> np.uint32(32 - BITS), np.append(wh >> np.uint32(32 - EMB_BITS), 0).astype(np.int64)
    first = np.append(np.searchsorted(owner, np.arange(len(words) + 1)), len(owner))
    n_grams = np.diff(first)
    counts = {k: np.zeros(1 << BITS, np.int32) for k in ("w1", "w0", "g1", "g0")}
    for d, t in zip(ids, y, strict=True):
        u = np.unique(d)
        size = n_grams[u]
        counts[f"w{int(t)}"][np.unique(wb[u])] += 1
        counts[f"g{int(t)}"][np.unique(gb[np.repeat(first[u] - np.cumsum(size) + size, size) + np.arange(size.sum())])] += 1
    model.word_odds = _odds(counts["w1"], counts["w0"], n_pos, n_neg).astype(np.float32)
    model.gram_odds = _odds(counts["g1"], counts["g0"], n_pos, n_neg).astype(np.float32)

    def per_word(table, buckets, how):
        """``how`` over the rows of ``table`` that each word's grams fall on."""
        runs = [np.zeros((0, *table.shape[1:]), np.float32)]
        for i in range(0, len(words), WORDS_A_RUN):
            k = slice(first[i], first[min(i + WORDS_A_RUN, len(words))])
            runs.append(_per_word(np.take(table, buckets[k], axis=0), owner[k] - i, min(WORDS_A_RUN, len(words) - i), how))
        return np.concatenate(runs)

    own = {}  # the evidence of words without the label of the document that is read
    for k in (0, 1):
        less = [np.maximum(counts[f"{x}{c}"] - (k == c), 0) for x in "wg" for c in (1, 0)]
        wo, go = _odds(*less[:2], n_pos - (k == 1), n_neg - (k == 0)), _odds(*less[2:], n_pos - (k == 1), n_neg - (k == 0))
        own[k] = np.zeros((len(words) + 1, 2), np.float32)
        own[k][:-1, 0], own[k][:-1, 1] = wo[wb], per_word(go.astype(np.float32), gb, np.maximum)
    del gb, counts, less, wo, go
    flat, doc, _, last = _layout(ids, len(words))
    bound = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])

    def highest():
        char = per_word(model.p["char"], gc, np.add)
        best, where = np.empty(len(last), np.float32), np.empty(len(last), np.int64)
        for k in (0, 1):  # documents of a class, in the layout that they have alone
            f, _, _, ends = _layout([ids[i] for i in np.flatnonzero(y == k)], len(words))
            to = np.flatnonzero(y[doc] == k)
            best[to], where[to] = model.highest(_joined(*own[k][:-1].T, model.p["word"][wc[:-1]], char, n_grams[:-1]), f, ends)
        return best, where

    sums = [own[k].sum(axis=1)[flat[:len(last) * STARTS]].reshape(-1, STARTS) for k in (1, 0)]
    odds = np.where((y[doc] == 1)[:, None], *sums)
    odds[np.arange(STARTS) > last[:, None]] = -np.inf
    best, where = odds.max(axis=1), odds.argmax(axis=1)  # windows that begin at the word of the highest evidence
    memory = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    clock = 0
    for turn in range(rounds):
        if turn:
            best, where = highest()
        order = np.lexsort((-best, doc))
        place = np.arange(len(order)) - bound[doc[order]]
        chosen = {k: order[(y[doc[order]] == k) & (place < (1 if k else 2)) & np.isfinite(best[order])] for k in (0, 1)}  # the worst window; of clean ones, two
        for _ in range(steps):
            at = np.concatenate([rng.choice(chosen[k], batch // 2) for k in (0, 1)])
            w = flat[at * STARTS + np.arange(BLOCK)[:, None]]
            begin = where[at] if turn else np.maximum(where[at] - rng.integers(0, WINDOW, len(at)), 0)
            inside = (np.arange(BLOCK)[:, None] >= begin) & (np.arange(BLOCK)[:, None] < begin + WINDOW)
            live = (w < len(words)).astype(np.float32)
            used, back = np.unique(w, return_inverse=True)
            back = back.reshape(w.shape)
            size = first[used + 1] - first[used]
            of = np.repeat(np.arange(len(used)), size)
            grams = gc[np.repeat(first[used] - np.cumsum(size) + size, size) + np.arange(len(of))]
            shared = np.maximum(size, 1).astype(np.float32)[:, None]
            chars = _per_word(np.take(model.p["char"], grams, axis=0), of, len(used), np.add) / shared
            evidence = np.where((y[doc[at]] == 1)[None, :, None], own[1][w], own[0][w])
            x = np.concatenate([evidence, model.p["word"][wc[w]], chars[back]], axis=2) * live[:, :, None]
            grad, dx, _ = model.step(x, live[:, :, None], inside * live, y[doc[at]])
            dx = (dx * live[:, :, None])[:, :, 2:].reshape(-1, 2 * EMB)
            per = np.zeros((len(used), 2 * EMB), np.float32)
            np.add.at(per, back.ravel(), dx)
            grad["word"], grad["char"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["char"])
            np.add.at(grad["word"], wc[used], per[:, :EMB])
            np.add.at(grad["char"], grams, (per[:, EMB:] / shared)[of])
            clock += 1
            for name, v in grad.items():
                m, s = memory[name]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                if name in ("word", "char"):
                    model.p[name] *= DECAY
                model.p[name] -= (RATE * (m / (1 - 0.9**clock)) / (np.sqrt(s / (1 - 0.999**clock)) + 1e-7)).astype(np.float32)
    top = np.maximum.reduceat(highest()[0].astype(np.float64), bound)
    weight = np.where(y == 1, prior / n_pos, (1 - prior) / n_neg)
    a, b = 1.0, 0.0
    for _ in range(300):  # scale and shift to the prior, by gradient steps
        gap = (1 / (1 + np.exp(-np.clip(a * top + b, -50, 50))) - y) * weight
        a, b = max(a - 0.3 * float(gap @ top), 0.05), b - 0.3 * float(gap.sum())
    model.scale, model.shift = a, b
    return model


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most ``sample`` labelled rows of either class, outside the held-out third. A doc_id labelled more
    than once counts as toxic if any row says so; null labels and ids are left out, and so are labels of documents that
    are missing, null or longer than ``chars``, before the sample is drawn."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    fitting = docs.filter(F.length("text") <= chars).select("doc_id", F.xxhash64("text").alias("own"))
    ranked = known.join(fitting, "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    drawn, shares = [], known.agg(F.avg("toxic")).first()[0]
    if shares is None:
        return train([], np.zeros(0), 0.5)
    for k in (0, 1):  # bounded by the sample: ids and hashes alone
        drawn += ranked.filter(F.col("toxic") == k).orderBy("draw", "doc_id", "own").limit(sample).collect()
    if not drawn:
        return train([], np.zeros(0), 0.5)
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.own, r.toxic) for r in drawn], "doc_id long, own long, toxic int").distinct()
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("own")).join(F.broadcast(wanted), ["doc_id", "own"]).drop("own")
    rows = sorted(found.distinct().collect(), key=lambda r: (r.doc_id, r.text))
    return train([r.text for r in rows], np.array([r.toxic for r in rows]), float(shares))


def _with_scores(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """``docs`` with the score in a column ``name`` that it does not have."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # tables of fixed size, some 9 MB
    where = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        net = Model.__new__(Model)
        vars(net).update(sent.value)
        for b in batches:
            out, pending, size = [], [], 0
            for t in b.column(where):
                pending.append(tokens(t.as_py()))
                size += len(pending[-1])
                if size >= WORDS_A_BATCH:
                    out.append(net.document_logits(pending))
                    pending, size = [], 0
            if pending:
                out.append(net.document_logits(pending))
            value = net.score(np.concatenate(out)) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score: 0 to 1, higher where label 1 is likelier. Null and wordless texts get the score of an empty
    window. Repeated rows score alike; a column named score is replaced; an empty table gives no rows."""
    return _with_scores(docs.drop("score"), model, text, "score")


def below(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold, with its columns, whatever their names."""
    name = unused("_score", docs.columns)
    return _with_scores(docs, model, text, name).filter(F.col(name) < threshold).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
