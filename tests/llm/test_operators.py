import random

import numpy as np
import pytest

from loomlake.llm import html, suffix_dedup
from loomlake.llm.decontaminate import Benchmark, find_contamination, scan
from loomlake.llm.html import main_text
from loomlake.llm.jaccard import jaccard_components
from loomlake.llm.licenses import scan_licenses
from loomlake.llm.license_texts import TEXTS
from loomlake.llm.mixing import mix_sources, route, share_out
from loomlake.llm.quality import quality_rules
from loomlake.llm.sharding import communication_matrix, shard_rows
from loomlake.llm.suffix_dedup import remove_repeats
from loomlake.llm.token_coder import BLOCK, decode, encode

from . import brute

SCHEMA = "doc_id long, text string, shard string, source string"


def some_docs():
    r = random.Random(4)
    vocab = ["the", "of", "und", "alpha", "beta", "gamma", "delta", "straße", "niño"]
    long = " ".join(r.choice(vocab) + str(r.randrange(40)) for _ in range(400))
    texts = [long, long, long.replace("alpha", "ALPHA"), long[:1500] + " new end of it", " ".join(r.choice(vocab) for _ in range(90)), None, "", "  \n", "one two", "one two", "x" * 900]
    return [(k, t, "mine", None if k % 4 == 3 else f"s{k % 3}") for k, t in enumerate(texts)] + [(None, "no id here", None, None)]


def test_matrix_sums():
    m = communication_matrix([5, 0, 12, 7], [8, 8, 8], 3)
    assert [sum(r) for r in m] == [5, 0, 12, 7]
    assert [sum(c) for c in zip(*m, strict=True)] == [8, 8, 8]


def test_sharding(spark):
    rows = some_docs() + [(1, "same", "a", "b")] * 9
    out = shard_rows(spark.createDataFrame(rows, SCHEMA), 4).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(out) == len(rows)
    assert shard_rows(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_share_out_and_route():
    t = share_out({"a": 10, "b": 100, "c": 0}, {"a": 3, "b": 1, "c": 2}, 165, 2)
    assert t == {"a": 20.0, "b": 145.0, "c": 0.0}
    flow = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 20}, 2)
    assert sum(flow["a", "b"].values()) + sum(flow["a",].values()) + sum(flow["b",].values()) == 40


def test_native_edge_cases(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(some_docs(), SCHEMA)
    q = {r.doc_id: r.quality for r in quality_rules(docs).collect()}
    assert q[5].n_words == 0 and not q[5].kept and q[8].n_words == 2
    licence = spark.createDataFrame([(1, TEXTS["MIT"].upper().replace("LICENSE", "LICENCE")), (2, "Copyright (c) 2020 A\n" + TEXTS["ISC"]), (3, None)], "doc_id long, text string")
    assert [r.license_id for r in scan_licenses(licence).orderBy("doc_id").collect()] == ["MIT", "ISC", None]
    mixed, _ = mix_sources(docs, F.array("source"), F.coalesce(F.length("text"), F.lit(0)), lambda t: {p[0]: n for p, n in t.items()})
    assert all(r.taken == (len(r.text) if r.text else 0) for r in mixed.collect())


def test_token_coder_round_trip():
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 50257, BLOCK), np.zeros(0, np.int64), np.full(700, 5), r.integers(0, 9, 33)]
    coded = encode(blocks)
    assert all((a == b).all() for a, b in zip(decode(coded), blocks, strict=True))
    assert len(coded[2]) < 200
    with pytest.raises(ValueError):
        decode([coded[0][:-1]])


def test_contamination_scan():
    docs = [(r[0], r[1]) for r in some_docs()]
    items = [(7, docs[0][1][100:600]), (8, "one two"), (9, None), (7, "one")]
    bench = Benchmark([(str(i), t) for i, t in items], 10)
    hits, n, found, _ = scan([(t or "").encode() for _, t in docs], bench)
    want = brute.contamination(docs, items)
    for (d, _), h, m, f in zip(docs, hits, n, found, strict=True):
        assert (m, h.sum(), sorted({bench.names[i] for i in f})) == want[d]


def test_repeated_starts():
    r = random.Random(2)
    core = bytes(r.randrange(97, 100) for _ in range(60))
    stretches = [bytes(r.randrange(97, 100) for _ in range(9)) + core + bytes(r.randrange(97, 100) for _ in range(9)) for _ in range(40)]
    item, start = suffix_dedup.repeated_starts([np.frombuffer(x, np.uint8) for x in stretches], np.full(40, 39), np.zeros(40, np.int64), 62)
    seen = {}
    for i, s in enumerate(stretches):
        for a in range(len(s) - 61):
            seen.setdefault((39 - a, s[a : a + 62]), []).append((i, a))
    assert sorted(zip(item.tolist(), start.tolist(), strict=True)) == sorted(x for v in seen.values() if len(v) > 1 for x in v)


def test_quality_filter_stays_above_the_features(spark):
    judged = quality_rules(spark.createDataFrame(some_docs(), SCHEMA))
    kept = judged.where("quality.kept").select("doc_id", "text")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.collect() if r.quality.kept)


def test_html():
    page = "<body><nav>a</nav><article><h1>T &amp; x</h1><p>one<br>two <b>bold<p>three</p><form>f</form><div class='comments'>c</div></article><footer>z</footer>"
    assert html.extract("h", page, set()) == "T & x\n\none two bold\n\nthree"
    assert html.extract(None, "", set()) == ""


def test_python_edge_cases(spark):
    docs = spark.createDataFrame(some_docs(), SCHEMA)
    plain = [(r[0], r[1]) for r in some_docs()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    want = brute.components([p for p in plain if p[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want
    cover = brute.repeats([(t or "").encode() for _, t in plain], 400)
    removed = {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()}
    assert removed == {p[0]: sum(c) for p, c in zip(plain, cover, strict=True)}
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/b", "<p>x")], "page_id long, url string, html string")
    assert [r.text for r in main_text(pages).orderBy("page_id").collect()] == ["", "x"]
    bench = spark.createDataFrame([(None, None), (3, "one two")], "item_id long, text string")
    assert find_contamination(docs, bench).where("contaminated").count() == 2
