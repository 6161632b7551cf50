"""Operators 2 and 7: held-out accuracy, folds, odd rows."""

import random
import zlib

import numpy as np
import pytest

from lattica.llm import toxicity as tox
from lattica.llm.quality_net import Net, quality
from lattica.llm.toxicity import Scorer, fitted, toxicity
from tests.llm.conftest import frame


@pytest.fixture(autouse=True)
def short(monkeypatch):
    """Fewer steps than in production."""
    full = tox.Model.fit
    monkeypatch.setattr(tox.Model, "fit", lambda self, texts, labels: full(self, texts, labels, steps=120))


BAD = ["idiot", "moron", "scum"]


def text(rng, toxic=False, junk=False):
    out = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 80))]
    if toxic:
        for w in rng.sample(BAD, 2):
            out[rng.randrange(len(out))] = w + rng.choice(["", "s", "!", "."])
    if junk:
        out = [w + rng.choice(["###", "$$$", "%%%"]) for w in out]
    return " ".join(out)


def labelled(n, kind):
    rng = random.Random(9)
    return [(k, text(rng, **{kind: k % 3 == 0}), int(k % 3 == 0)) for k in range(n)]


def test_toxicity_by_held_out_rows(spark, odd_rows):
    rows = labelled(500, "toxic")
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(i + 1000 if i is not None else None, t) for i, t in odd_rows])
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd_rows)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (1001, 1002, 1003))
    equal = [r.score for r in got if r.doc_id in (1007, 1008)]
    assert len(set(equal)) == 1 and len(equal) == 3


def test_unseen_misspelling():
    rows = labelled(600, "toxic")
    per_bucket, bias = fitted([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    scorer = Scorer(per_bucket, bias)
    toxic, clean = scorer.scores(["la lo idiotss re", "la lo re to"])
    assert toxic > 0.5 > clean


def plain_odds(per_bucket, bias, text):
    """Windows of words, each the weighted mean over its subwords' values, one after the other."""
    w = text.lower().split()
    found = []
    for begin in range(0, max(len(w) - tox.WINDOW // 2, 1), tox.WINDOW // 2) if w else ():
        total = bag = 0.0
        for x in w[begin : begin + tox.WINDOW]:
            bucket, _ = tox.bags([x])
            z = per_bucket[bucket].astype(float)
            total += z.sum()
            bag += max((z != 0).sum() + tox.UNKNOWN * (z == 0).sum(), 1)
        found.append(total / bag)
    if not found:
        return bias
    share = np.exp(tox.SHARP * (np.array(found) - max(found)))
    return float(share @ np.array(found) / share.sum()) + bias


def test_odds_by_brute_force(odd_rows):
    rng = np.random.default_rng(3)
    per_bucket = np.where(rng.random(tox.BUCKETS) < 0.5, rng.normal(size=tox.BUCKETS), 0).astype(np.float32)
    rows = random.Random(2)
    texts = [t or "" for _, t in odd_rows if len(t or "") < 1000] + [text(rows, toxic=k % 2 == 0) for k in range(30)] + ["a " * k for k in (1, 4, 7, 8, 9, 11, 12, 13, 16, 17)] + ["x" * 5000 + " y"]
    got = Scorer(per_bucket, 0.25, most_words=40).odds(texts)
    assert np.allclose(got, [plain_odds(per_bucket, 0.25, t) for t in texts], atol=1e-6)


def test_training_rows_are_bounded(spark):
    rows = [(k, f"{k} " * (k + 1)) for k in range(40)] + [(7, "another text")] * 50
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    texts, y = tox.training_rows(frame(spark, rows), labels, "toxic", 5, 0, (1000, 1000), 10**6)
    kept = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    assert len(texts) == len(y) == len(kept) and y.tolist() == [k % 2 for k in kept]
    some, _ = tox.training_rows(frame(spark, rows), labels, "toxic", 5, 0, (4, 3), 10**6)
    assert len(some) <= 7
    few, _ = tox.training_rows(frame(spark, rows), labels, "toxic", 5, 0, (1000, 1000), 300)
    assert few and sum(map(len, few)) <= 300


def test_learning_ignores_held_out_labels(spark):
    rows = labelled(60, "toxic")
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    scores = []
    for flip in (False, True):
        y = lambda i, y, flip=flip: 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y
        labels = spark.createDataFrame([(i, y(i, v)) for i, _, v in rows], "doc_id long, toxic int")
        scores.append(sorted((r.doc_id, r.score) for r in toxicity(docs, labels).collect()))
    assert scores[0] == scores[1]


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a"), (2, None)])
    assert [r.score for r in toxicity(docs, labels).collect()] == [0.5, 0.5]
    assert [round(r.score, 6) for r in quality(docs, labels).collect()] == [0.5, 0.5]
    full = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity(frame(spark, []), full).collect() == quality(frame(spark, []), full).collect() == []


def test_kept_columns_with_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a"), (None, None)]).withColumnRenamed("n", "predicted")
    got = toxicity(docs, labels, keep_columns=True)
    assert got.columns == [*docs.columns, "tox_score", "tox_predicted"] and got.count() == 2
    again = toxicity(got, labels, keep_columns=True)
    assert again.columns == [*got.columns, "tox__score", "tox__predicted"] and again.count() == 2


def test_quality_by_held_out_rows(spark, odd_rows):
    rows = [(i, t, 1 - y) for i, t, y in labelled(500, "junk")]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(i + 1000 if i is not None else None, t) for i, t in odd_rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == len(rows) + len(odd_rows)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for y, s in held if y == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def plain_score(net, data):
    """The network's forward pass, one place, chunk and filter after the other."""
    from lattica.llm.quality_net import BLOCK, FILTERS, WIDTH

    if not data:
        return 1 / (1 + np.exp(-float(net.bias[0])))
    padded = data + bytes(WIDTH)
    response = np.array([sum(net.taps[k][padded[i + k]].astype(float) for k in range(WIDTH)) for i in range(len(data))])
    blocks = -(-(len(data) + WIDTH - 1) // BLOCK)
    chunks = []
    for b in range(blocks):
        part = response[b * BLOCK : (b + 2) * BLOCK]
        chunks.append(np.maximum(part.max(0) + net.shift, 0) if len(part) else np.zeros(FILTERS))
    feats = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
    return 1 / (1 + np.exp(-float(feats @ net.out + net.bias[0])))


def test_net_by_brute_force():
    rng = random.Random(4)
    net = Net(seed=2)
    net.shift[:] = np.random.default_rng(1).normal(0, 0.5, len(net.shift))
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 4, 5, 251, 252, 253, 255, 256, 257, 508, 512, 513, 1500, 40_000)]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_net_gradients_and_slicing():
    net = Net(seed=1)
    texts, y = [b"abcdefgh" * 100, b"zzz", b"hello world"], np.array([1, 0, 1])
    grads = net._gradients(texts, y)

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, (param, grad) in enumerate(zip([net.taps, net.shift, net.out, net.bias], grads)):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old = param[at]
        param[at] = old + 1e-2
        high = loss()
        param[at] = old - 1e-2
        low = loss()
        param[at] = old
        assert abs((high - low) / 2e-2 - grad[at]) < 0.1 * abs(grad[at]) + 1e-3, k
    data = [b"x" * n for n in (0, 1, 255, 256, 257, 5000)]
    assert np.allclose(net.score(data), [net.score([d])[0] for d in data])


def test_toxicity_fit_takes_4000_and_2000():
    import inspect

    defaults = inspect.signature(toxicity).parameters
    assert (defaults["most_clean"].default, defaults["most_toxic"].default) == (4000, 2000)
