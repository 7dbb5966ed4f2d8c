"""Repeated strings against brute force: bytes of ``length``, passages of words, long groups, long texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomlake.llm import suffix_dedup
from loomlake.llm.suffix_dedup import remove_repeats

from . import brute

SCHEMA = "doc_id long, text string, kept string, n_bytes string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def passage_words(texts, n):
    lists = [WORD.findall(t) for t in texts]
    seen = {}
    for i, w in enumerate(lists):
        for a in range(len(w) - n + 1):
            seen.setdefault(tuple(w[a : a + n]), []).append((i, a))
    hit = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                hit[i] |= set(range(a, a + n))
    return [len(x) for x in hit]


def check(spark, texts, length, passage):
    docs = spark.createDataFrame([(k, t, "mine", "mine") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in remove_repeats(docs, length=length, passage=passage).collect()}
    data = [(t or "").encode() for t in texts]
    assert len(got) == len(texts)
    for k, (b, cover, words) in enumerate(zip(data, brute.repeats(data, length), passage_words(data, passage), strict=True)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_passage_words) == (len(b), sum(cover), words)
        kept = bytes(c for c, gone in zip(b, cover, strict=True) if not gone)
        assert hashlib.sha256(r.kept).digest() == hashlib.sha256(kept).digest()
        assert [(s.start, s.end) for s in r.removed] == [m.span() for m in re.finditer(rb"\x01+", bytes(cover))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"{rng.choice('abcdefghé')}{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [prose(n) for n in (12, 20, 30, 45, 80)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randrange(5, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng.randrange(1, 30))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[1] + " more", "x" * 300, "ab" * 200, None, "", " \n ", "short", shared[4], shared[4] + "\n" + shared[4]]
    return texts


def test_equals_brute_force(spark):
    check(spark, corpus(1), 60, 15)
    check(spark, corpus(2), 41, 10)


def test_long_groups_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", 3)
    check(spark, corpus(3), 60, 15)


def test_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (500, 20, 1000)]
    units = [np.frombuffer(t, np.uint8) for t in texts]
    windows = lambda: sorted({(int(t), s, int(a)) for t, lo, hi, a, *_ in zip(*suffix_dedup.all_anchors(units, 40), strict=True) for s in range(lo, hi + 1)})
    whole = windows()
    monkeypatch.setattr(suffix_dedup, "_PIECE", 128)
    assert windows() == whole and len(whole) == 461 + 961
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 4)
    with pytest.raises(ValueError):
        suffix_dedup.all_anchors(units, 40)


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    docs = spark.createDataFrame([(1, long, "", ""), (2, long[1_000_000:1_000_500], "", ""), (3, long[5:300], "", "")], SCHEMA)
    got = {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()}
    assert got == {1: 500, 2: 500, 3: 0}
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
