import random

import numpy as np
import pytest

from promptledger.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 90))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w) + 1), rng.choice(["vilespam", "grunk" + rng.choice(words)]))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*corpus(500, 1), 0.25, rounds=3, steps=60)


def test_held_out_accuracy(model):
    texts, y = corpus(300, 2)
    got = model.score(model.document_logits([toxicity.tokens(t) for t in texts])) >= toxicity.THRESHOLD
    assert (got == y).mean() > 0.95


def forward(model, x, live, pool):
    """Logits of a batch by the plain recurrences."""
    h, p, bend = toxicity.HIDDEN, model.p, lambda v: v / (1 + np.abs(v))
    steps, n = x.shape[:2]
    states = np.zeros((steps, n, 2 * h))
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        s = np.zeros((n, h))
        for t in order:
            a, b = x[t] @ p[f"W{d}"] + p[f"b{d}"], s @ p[f"U{d}"]
            z, r = (0.5 + 0.5 * bend(a[:, i:i + h] + b[:, i:i + h]) for i in (0, h))
            s = s + live[t] * z * (bend(a[:, 2 * h:] + r * b[:, 2 * h:]) - s)
            states[t, :, slice(0, h) if d == "f" else slice(h, 2 * h)] = s
    e = np.where(pool > 0, states @ p["att"], -1e4)
    a = np.exp(e - e.max(axis=0))
    return (a / a.sum(axis=0) * (states @ p["out"])).sum(axis=0) + p["bias"][0]


def test_gradients_against_differences():
    model = toxicity.Model(3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 4, toxicity.INPUTS))
    live, pool = np.ones((6, 4, 1)), np.ones((6, 4))
    live[4:, 1] = pool[4:, 1] = 0
    pool[0] = 0
    y = np.array([0, 1, 1, 0], float)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        return float(np.mean(np.log1p(np.exp(-forward(model, x, live, pool) * (2 * y - 1)))))

    grad, dx, logit = model.step(x, live, pool, y)
    assert np.allclose(logit, forward(model, x, live, pool))

    def slope(flat, i):
        old, side = flat[i], []
        for by in (1e-5, -1e-5):
            flat[i] = old + by
            side.append(loss())
        flat[i] = old
        return (side[0] - side[1]) / 2e-5

    for name in ("Wf", "Wb", "Uf", "Ub", "bf", "bb", "att", "out", "bias"):
        flat = model.p[name].reshape(-1)
        for i in {0, len(flat) // 3, len(flat) // 2, len(flat) - 1}:
            assert abs(slope(flat, i) - grad[name].reshape(-1)[i]) < 1e-6, name
    for i in (0, 77, x.size - 1):
        assert abs(slope(x.reshape(-1), i) - dx.reshape(-1)[i]) < 1e-6


def test_every_window_counts_and_long_texts(model, spark):
    filler = "lo mi na re si " * 20_000
    rows = [(1, filler + "vilespam"), (2, "vilespam " + filler), (3, filler), (4, None), (5, ""), (5, ""), (6, "vilespam")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = toxicity.score_toxicity(docs, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert min(by[1], by[2], by[6]) > 0.7 > max(by[3], by[4], by[5])
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_a_window_starts_at_every_word(model):
    words = toxicity.tokens(" ".join(corpus(9, 4)[0]) + " vilespam")

    def alone(w):
        """The highest window of a text, each read with the block that it lies in."""
        x, size, width = model.inputs(list(w)), len(w), toxicity.WINDOW
        out = []
        for s in range(max(1, size - width + 1)):
            block = s // toxicity.STARTS * toxicity.STARTS
            at = block + np.arange(toxicity.BLOCK)
            live = at < size
            pool = live & (at >= s) & (at < s + width) if size else np.ones(len(at), bool)
            out.append(forward(model, x[np.where(live, at, size)][:, None], live[:, None, None], pool[:, None])[0])
        return max(out)

    for docs in ([words[:n] for n in (0, 1, 23, 24, 25, 40, 41, 57, 64, 65, 66, 105, 106, 147)], [words, words[::-1]]):
        assert np.allclose(model.document_logits(docs), [alone(d) for d in docs], atol=1e-3)


def test_labels_of_long_or_missing_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "vilespam lo" if i % 2 else "mi na" * (9 if i % 4 else 900)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen, old = [], toxicity.train
    toxicity.train = lambda texts, y, prior: seen.append((len(texts), int(y.sum()))) or old([], np.zeros(0), prior)
    try:
        toxicity.fit(docs, labels, sample=8, chars=400)
    finally:
        toxicity.train = old
    assert seen == [(16, 8)]


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, None if i else 0) for i in range(9)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, model).collect())
