import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from promptledger.llm import lm


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = Counter()
    for d, t in rows:
        w = tokens(t)
        out[(d, len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    return out


@pytest.mark.parametrize("head", [4, 60, 1000])
def test_base_counts_and_normalised_scores(spark, head):
    rng = random.Random(head)
    sides = [["la", "le", "un", "mot", "rue"], ["the", "a", "one", "word", "road"]]
    rows = [(i, " ".join(rng.choice(sides[i % 2]) if rng.random() < 0.9 else f"x{rng.randrange(300)}" for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "A\tA b \x0b c"), (3, "the the"), (3, "the the"), (None, "la")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as word")
    got = lm.score_documents(docs, lm.fold(docs["doc_id"]) != 2, head=head).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
    out = [r for r in got if r.doc_id is not None and held(r.doc_id) and r.doc_id < 200]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("use", [None, 2])
def test_probabilities_of_all_words_sum_to_one(use):
    counts = Counter({b"": 50, b"a": 40, b"b": 30, b"c": 9, b"d": 2, b"e": 2, b"f": 1, b"g": 1, b"h": 1} | {f"k{i}".encode(): 8 for i in range(90)})
    top = counts.most_common(94)
    rng = np.random.default_rng(1)
    use = use and rng.integers(0, 9, (40, 2 * lm.NEIGHBOURS))
    model = lm.Model([w for w, _ in top], [c for _, c in top], sum(counts.values()), len(counts), 3, use)
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    model.inner_weights = rng.normal(size=model.inner_weights.shape).astype(np.float32)
    head, total = {w for w, _ in top}, 0.0
    for w in [*counts, b"unseen"]:
        p = float(model.log_probs([model.codes([b"a", b"b", w])])[0][0])
        if w not in head:
            c = counts[w]
            p += math.log(10) * (model.log_often + math.log10(c / model.often) if c >= 2 else model.log_once)
        total += math.exp(p)
    first = float(model.log_probs([model.codes([b"a", b"b"])])[0][0])
    assert abs(total / math.exp(first) - 1) < 1e-5


def test_neighbours_are_counted_and_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(lm, "SEEN_A_RUN", 3)
    words = [b"a", b"b", b"c", b""]
    ids = [0, 1, 0, 1, 0, 2, 3]
    got = {r["word"]: r for r in lm._counted(words, np.array(ids)).to_pylist()}
    bucket = [zlib.crc32(w) % lm.NEIGHBOURS for w in words]
    want = np.zeros(2 * lm.NEIGHBOURS, int)
    for i, x in enumerate(ids):
        if x == 0:
            want[bucket[ids[i - 1]] if i else bucket[3]] += 1
            want[lm.NEIGHBOURS + bucket[ids[i + 1]]] += 1
    assert got[b"a"]["c"] == 3 and got[b"a"]["use"] == want.tolist() and got[b"b"]["use"] is None
    rows = [(1, "x y " * 150_000), (2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score_documents(docs, lm.F.lit(True)).collect()}
    assert out[1].n_tokens == out[1].n_known == 300_001 and out[2].n_known == 4
    assert out[1].score > out[1].base_score


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_documents(docs, docs["doc_id"] > 9).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert lm.score_documents(docs.limit(0), docs["doc_id"] > 0).count() == 0


def test_neighbours_count_at_every_place_however_the_texts_are_dealt(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(150)]  # no word 32 times in a task
    monkeypatch.setattr(lm, "KNOWN", 40)
    seen, init = [], lm.Model.__init__
    monkeypatch.setattr(lm.Model, "__init__", lambda self, *a: seen.append(a) or init(self, *a))
    for tasks in (1, 30):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
        lm.score_documents(docs, lm.fold(docs["doc_id"]) != 2, head=45).collect()
    want = {}
    bucket = lambda w: zlib.crc32(w) % lm.NEIGHBOURS
    for d, t in rows:
        w = [] if held(d) else [b"", *tokens(t), b""]
        for k in range(1, len(w) - 1):
            use = want.setdefault(w[k], np.zeros(2 * lm.NEIGHBOURS, int))
            use[bucket(w[k - 1])] += 1
            use[lm.NEIGHBOURS + bucket(w[k + 1])] += 1
    assert len(seen) == 2
    for head, _, _, _, _, use in seen:
        assert len(use) == 40 and all((use[i] == want[head[i]]).all() for i in range(40))
