"""Language-model scores: counts against brute force, probabilities that add up, held-out gain."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomlake.llm import maxent
from loomlake.llm.maxent import lm_scores

SCHEMA = "doc_id long, text string, train boolean, score string, word string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall((text or "").encode())]


def base(rows):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)} by the contract."""
    counts = Counter(w for _, t, train in rows if train for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t, _ in rows:
        own = [*tokens(t), None]
        out[d] = (len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    return out


def scores(spark, rows):
    frame = spark.createDataFrame([(d, t, x, "own", "own") for d, t, x in rows], SCHEMA)
    return {r.doc_id: r for r in lm_scores(frame.repartition(3), F.col("train")).collect()}


def sentences(rng, n):
    """Each word has a few followers, which differ from word to word."""
    vocab = [f"{rng.choice('abcdefgh')}{k}" for k in range(300)]
    after = {w: rng.sample(vocab, 3) for w in vocab}
    out = []
    for _ in range(n):
        w, text = rng.choice(vocab), []
        for _ in range(rng.randrange(5, 60)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.choice(vocab)
        out.append(" ".join(text))
    return out


def test_base_equals_brute_force_and_context_helps(spark):
    rng = random.Random(7)
    texts = [*sentences(rng, 400), None, "", " \n", "never-seen words here", "Ünïcode Ünïcode", "same", "same"]
    rows = [(k, t, rng.random() < 0.8 if k < 400 else k % 2 == 0) for k, t in enumerate(texts)] + [(None, "no id", None)]
    got, want = scores(spark, rows), base(rows)
    for d, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[d][:3]
        assert math.isclose(r.base_score, want[d][3], abs_tol=1e-6)
        assert r.score < 0 and r.word == "own"
    held = [d for d, _, train in rows[:400] if not train]
    gain = sum(got[d].score - got[d].base_score for d in held) / sum(got[d].n_tokens for d in held)
    assert gain > 0.25  # log10 for each token


def test_many_tail_words(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 20)
    rng = random.Random(3)
    rows = [(k, t, k % 3 > 0) for k, t in enumerate(sentences(rng, 60))]
    got, want = scores(spark, rows), base(rows)
    assert all((r.n_tokens, r.n_known, r.train_tokens) == want[d][:3] and math.isclose(r.base_score, want[d][3], abs_tol=1e-6) for d, r in got.items())


def test_repeats_in_training_and_no_training(spark):
    got = scores(spark, [(1, "a b a", True), (1, "a b a", True), (2, "a", False)])
    want = base([(1, "a b a", True), (1, "a b a", True), (2, "a", False)])
    assert math.isclose(got[2].base_score, want[2][3], abs_tol=1e-9) and got[2].train_tokens == 8
    none = scores(spark, [(1, "a b", False), (2, None, None)])
    assert none[1].train_tokens == 0 and none[1].n_known == 0 and none[1].base_score == 0 and none[1].score < 0
    assert lm_scores(spark.createDataFrame([], SCHEMA), F.col("train")).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(500_000))
    got = scores(spark, [(1, text, True), (2, text, False), (3, "w1 w2", False)])
    assert got[2].n_tokens == 500_001 == got[2].n_known


def test_factors_are_probabilities():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent.LEAST_ROWS, maxent.CLASSES)).astype(np.float32)
    rows = rng.integers(0, len(weights), (4, 50))
    assert np.allclose(np.exp(maxent.log_softmax(weights, rows)).sum(axis=1), 1, atol=1e-5)
    sums = {k: (40, 2) for k in range(maxent.CLASSES)}
    top = [(f"w{r}".encode(), 20) for r in range(2 * maxent.GROUPS)]
    first = maxent.first_weights(sums, top, 100)
    assert np.allclose(np.exp(first[1, : maxent.GROUPS]).sum(axis=1), 1, atol=1e-5) and np.isclose(np.exp(first[0, 0]).sum(), 1, atol=1e-5)


def test_update_moves_towards_what_is_drawn():
    weights, squares = np.zeros((64, maxent.CLASSES), np.float32), np.zeros(64, np.float32)
    rows = np.array([[40, 41, 40], [42, 43, 42], [44, 45, 44], [0, 0, 0]])
    drawn = np.array([3, 5, 3])
    before = maxent.log_softmax(weights, rows)[np.arange(3), drawn].sum()
    for _ in range(20):
        maxent.update(weights, squares, rows, drawn)
    assert maxent.log_softmax(weights, rows)[np.arange(3), drawn].sum() > before + 3


def test_tables_grow_with_the_vocabulary():
    assert maxent.table_rows(0) == maxent.LEAST_ROWS < maxent.table_rows(4 * 10**6) < maxent.table_rows(3 * 10**7) <= maxent.MOST_ROWS
