"""The chain of stages against brute force, on a fixture with a case for each stage."""

import random
from collections import Counter

import duckdb

import corpus_pipeline
from loomlake.llm import stages
from loomlake.llm.queries import source_quotas
from loomlake.llm.sql import QUALITY_SQL

from . import brute

STOP = "the of and to in is it that was for".split()


def fixture():
    rng = random.Random(12)
    vocab = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(160)]

    def prose(n):
        return " ".join(rng.choice(STOP) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n))

    items = [(k, prose(25)) for k in range(6)]
    rows = []
    for k in range(90):
        text = prose(rng.randrange(60, 200))
        if k % 9 == 0:
            text = f"{text} {items[k % 6][1]} {prose(20)}"
        rows.append([k, text, ["x", "y", None][k % 3]])
        if k % 5 == 0:  # a near copy under a greater id, and an equal one
            rows.append([1000 + k, text + " and more", "y"])
            rows.append([2000 + k, text, "x"])
    rows += [[3000, "too short", "x"], [3001, "the same line\n" * 60, "y"], [3002, None, "x"], [3003, "", "y"], [None, prose(80), "x"], [None, prose(90), "y"], [7, prose(70), "x"]]
    return [(d, t, s, f"u{k}", k, "s", "c") for k, (d, t, s) in enumerate(rows)], items


SCHEMA = "doc_id long, text string, source string, n_words string, component_id int, shard string, copies string"


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"

    # Quality: the SQL on rows numbered apart, as ids repeat.
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(k, r[1]) for k, r in enumerate(rows)])
    verdict = db.sql(QUALITY_SQL)
    names = verdict.columns
    good = {r[names.index("doc_id")] for r in verdict.fetchall() if r[names.index("kept")]}
    kept = [r for k, r in enumerate(rows) if k in good]
    frame = stages.quality(spark, docs, sf)
    assert Counter(map(tuple, frame.collect())) == Counter(kept) and 3 < len(rows) - len(kept) < 40

    # Near duplicates: groups over rows numbered apart; the least id of each stays, null last.
    group = brute.components([(k, r[1]) for k, r in enumerate(kept)])
    best = {}
    for k, r in enumerate(kept):
        best.setdefault(group[k][1], []).append(r)
    got = list(map(tuple, stages.near_duplicates(spark, frame, sf).collect()))
    assert len(got) == len(best) < len(kept)
    for members in best.values():
        least = min((r[0] for r in members if r[0] is not None), default=None)
        assert sum(r in members and r[0] == least for r in got) == 1

    # Benchmark passages.
    found = brute.contamination([(k, r[1]) for k, r in enumerate(got)], items)
    clean = [r for k, r in enumerate(got) if not found[k][1]]
    frame = stages.decontaminate(spark, spark.createDataFrame(got, SCHEMA), sf)
    assert Counter(map(tuple, frame.collect())) == Counter(clean) and 3 < len(got) - len(clean) < 30

    # The mixture: whole documents, once or twice, near the targets of their sources.
    mixed = list(map(tuple, stages.mix(spark, frame, sf).collect()))
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2
    words = Counter()
    for r in clean:
        words[r[2],] += len(r[1].split())
    for source, target in source_quotas(words).items():
        taken = sum(len(r[1].split()) for r in mixed if r[2] == source)
        assert abs(taken - target) <= 250

    # The whole chain, written and read between its stages: the same documents, sharded.
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[: len(rows[0])] == [f.split()[0] for f in SCHEMA.split(", ")]
    ran = [tuple(r) for r in out.collect()]
    assert Counter(r[: len(rows[0])] for r in ran) == Counter(mixed)
    sizes = Counter(r[-2] for r in ran)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all({r[-1] for r in ran if r[-2] == s} == set(range(n)) for s, n in sizes.items())


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0
