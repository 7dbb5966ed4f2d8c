"""Sharding and mixing against exact counts and exhaustive search; decontamination over blocks."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlake.llm import decontaminate
from loomlake.llm.decontaminate import find_contamination
from loomlake.llm.mixing import mix_sources, repeated, route
from loomlake.llm.sharding import communication_matrix, hypergeometric, log_mass, shard_rows, write_shards

from . import brute


def test_mass_is_exact():
    for good, bad, draws in ((5, 7, 6), (40, 3, 20), (300, 500, 123), (1, 1000, 500)):
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            want = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert math.isclose(math.exp(log_mass(k, good, bad, draws)), want, rel_tol=1e-11)
    # At 10**12 rows the masses around the mode still add up.
    good, bad, draws = 10**12 // 8, 7 * 10**12 // 8, 10**6
    mode = draws // 8
    assert math.isclose(sum(math.exp(log_mass(k, good, bad, draws)) for k in range(mode - 4000, mode + 4001)), 1, rel_tol=1e-9)


def test_draws_follow_the_law():
    rng = random.Random(11)
    got = Counter(hypergeometric(rng, 6, 9, 7) for _ in range(20_000))
    for k in range(7):
        want = math.comb(6, k) * math.comb(9, 7 - k) / math.comb(15, 7)
        assert abs(got[k] / 20_000 - want) < 0.012
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 5, 0, 3) == 3


def test_matrix_of_huge_sizes():
    sizes = [10**11 + k for k in range(5)]
    room = [sum(sizes) // 3, sum(sizes) // 3, sum(sizes) - 2 * (sum(sizes) // 3)]
    matrix = communication_matrix(sizes, room, 4)
    assert [sum(r) for r in matrix] == sizes and [sum(c) for c in zip(*matrix, strict=True)] == room


def test_every_arrangement_is_as_likely(spark):
    docs = spark.createDataFrame([(k, "x", "old") for k in range(5)], "doc_id long, text string, shard string")
    seen = Counter()
    for seed in range(40):
        seen.update((r.doc_id, r.shard) for r in shard_rows(docs.drop("shard"), 2, seed=seed).collect())
    assert all(5 < seen[k, 1] < 28 for k in range(5)) and sum(seen[k, 1] for k in range(5)) == 80


def test_one_row_many_times(spark, tmp_path):
    rows = [(None, None)] * 700 + [(k, "t" * (k % 7)) for k in range(100)] + [(5, "z" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shard_rows(docs, 8)
    got = [(r.shard, r.slot) for r in out.collect()]
    sizes = Counter(s for s, _ in got)
    assert len(got) == 801 == len(set(got)) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    assert all({x for s, x in got if s == k} == set(range(n)) for k, n in sizes.items())
    write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    with pytest.raises(ValueError):
        shard_rows(docs, 0)


def exhaustive(patterns, quotas, repeats):
    """(words given at most, least cost at that) over all amounts that the quotas admit."""
    names, sources = list(patterns), list(quotas)
    subsets = [set(c) for n in range(len(sources) + 1) for c in itertools.combinations(sources, n)]

    def fits(gives):  # Hall: what only sources of a set can take is within their quotas
        return all(sum(g for p, g in zip(names, gives, strict=True) if set(p) <= s) <= sum(quotas[x] for x in s) for s in subsets)

    best = (0, 0)
    for gives in itertools.product(*[range(patterns[p] * repeats + 1) for p in names]):
        if fits(gives):
            cost = sum(max(0, g - k * patterns[p]) for p, g in zip(names, gives, strict=True) for k in range(1, repeats))
            best = max(best, (sum(gives), -cost))
    return best[0], -best[1]


def test_flow_over_overlapping_sources_is_the_cheapest():
    rng = random.Random(6)
    choices = [("a",), ("b",), ("a", "b"), ("b", None), ("a", "b", None), (None,)]
    for _ in range(25):
        patterns = {p: rng.randrange(1, 4) for p in rng.sample(choices, 4)}
        quotas = {s: rng.randrange(7) for s in ("a", "b", None)}
        flow = route(patterns, quotas, 2)
        given = {p: sum(flow[p].values()) for p in patterns}
        assert all(given[p] <= 2 * n for p, n in patterns.items())
        assert all(sum(flow[p].get(s, 0) for p in patterns) <= q for s, q in quotas.items())
        cost = sum(max(0, given[p] - n) for p, n in patterns.items())
        assert (sum(given.values()), cost) == exhaustive(patterns, quotas, 2)


def test_mixture_of_overlapping_sources(spark):
    rng = random.Random(8)
    choices = [["a"], ["b"], ["a", "b"], ["b", None], [None], [], None]
    rows = [(k, rng.choice(choices), rng.randrange(1, 50), "mine") for k in range(600)] + [(k, ["a"], 0, "mine") for k in range(5)] + [(None, ["a", "b"], 40, "mine")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, src array<string>, n int, copies string").repartition(4)
    quotas = {"a": 4000, "b": 3000, None: 2500}
    mixed, flow = mix_sources(docs, F.col("src"), F.col("n"), lambda totals: quotas)
    got = mixed.collect()
    again = mix_sources(docs.repartition(2), F.col("src"), F.col("n"), lambda totals: quotas)[0].collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    assert all(r.taken == r.copies * r.n and 0 <= r.copies <= 2 for r in got)
    assert all(r.taken == 0 for r in got if not r.src)
    for pattern, to in flow.items():
        taken = sum(r.taken for r in got if tuple(r.src or ()) == pattern)
        assert abs(taken - sum(to.values())) <= 20 * 40  # equal rows are taken alike
    assert len({r.copies for r in got if r.doc_id is None}) == 1
    assert repeated(mixed).count() == sum(r.copies for r in got)
    empty = mix_sources(docs.limit(0), F.col("src"), F.col("n"), lambda totals: quotas)[0]
    assert empty.count() == 0


def test_blocks_and_locations(spark, monkeypatch):
    rng = random.Random(9)
    vocab = [f"{rng.choice('abcdeé')}{k}" for k in range(40)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.randrange(1, 40))) for k in range(30)] + [(7, "A0 a0"), (None, prose(12)), (99, None), (98, " , ")]
    docs = []
    for k in range(60):
        cut = rng.choice(items)[1] or ""
        docs.append((k, f"{prose(rng.randrange(20))} {cut.upper() if k % 3 else cut} {prose(rng.randrange(20))}", "old", "old"))
    docs += [(100, None, "", ""), (101, "", "", ""), (102, prose(300_000), "", "")]
    named = [("null" if i is None else i, t) for i, t in items]
    want = brute.contamination([(d, t) for d, t, *_ in docs], named)
    frame = spark.createDataFrame(docs, "doc_id long, text string, items string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in find_contamination(frame, bench).collect()}
        assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in got.items()} == want
        assert all(sum(x.end - x.start for x in r.locations) == r.n_hit for r in got.values())
    assert find_contamination(frame.limit(0), bench).count() == 0
    assert find_contamination(frame, bench.limit(0)).where("contaminated").count() == 0
