"""A family of copies whose members are linked to each other rather than to their original."""

import random

from loomlake.llm.jaccard import jaccard_components

from . import brute


def test_copies_with_common_changes(spark):
    rng = random.Random(5)
    original = [f"w{k}" for k in range(160)]
    changes = [(rng.randrange(160), f"x{k}") for k in range(14)]
    rows = [(0, " ".join(original))]
    for k in range(1, 260):
        text = list(original)
        for at, word in rng.sample(changes, rng.randrange(1, 11)):
            text[at] = word
        for _ in range(rng.randrange(4)):
            text[rng.randrange(160)] = f"y{rng.randrange(1000)}"
        if k % 5 == 0:
            del text[rng.randrange(100) :][: rng.randrange(1, 40)]
        rows.append((k, " ".join(text[: len(text) - rng.randrange(12) * (k % 3 == 0)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute.components(rows)
    assert len({c for _, c in got.values()}) > 3
