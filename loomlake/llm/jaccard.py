"""N-gram Jaccard join with skipping by set relations.

Sets of word shingles are indexed by their prefix: of a set of n shingles, those among the first
n - ceil(t n) + 1 in one global order (rare ones first) must hold one that any partner's prefix holds too.
Each index list falls into blocks by set size; only equal and neighbouring blocks can hold partners,
and the places within the prefixes bound the overlap, so that other blocks and entries are skipped.

The first round computes the similarity of each set to the first set of one of its lists, which is the
one of about its size that most lists hold; two more turns compute that to a neighbour on its lists. Sets
that turn out to be linked share a component, and their answers follow from each other: the last round
skips all pairs within a component. Two sets S and T with a common first set H share
|H| - |H-S| - |H-T| shingles and those in which they differ from H in the same way, so that their answer
follows from their differences to H: these are indexed by prefix instead of the sets. If no common
difference is needed, S and T are both linked to H and in its component. All other pairs are compared
unless places in the prefixes or counts rule them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .textbytes import LOWER, PrefixHash, chunks, joined, mixed, table, words
from .util import col, discard, fresh, written

SHINGLE = 5
#: The least similarity of a link, in hundredths.
LEAST = 75
#: A shingle on more index lists than this moves to the end of the order, and the index is built anew.
LONG_LIST = 2000
#: Frequent shingles whose counts go to every task (12 bytes each); the order is right without the rest.
MOST_SENT = 500_000
#: Distinct shingles that a task counts before it gives out those found more than once.
COUNTED = 3_000_000
ROUNDS = 4
#: Turns in which neighbours of different components are compared before the last round.
TURNS = 2
#: A first set must share this many hundredths of the union with a set for their differences to be indexed.
NEAR = 25

IS_WORD = table(r"[^\x20\x09-\x0D]")
_STEPS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(SHINGLE)]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; for short arrays quicker than the library's way."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; one of all words if there are fewer."""
    data, at = joined(texts, b"\n")
    data = LOWER[data]
    starts, ends = words(data, IS_WORD)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    h = PrefixHash(data).of(starts, ends)
    doc = np.searchsorted(starts, at)
    several = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k, step in enumerate(_STEPS):
        several += h[k : k + len(several)] * step
    several = mixed(several)
    out = []
    for a, b in zip(doc[:-1], doc[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(distinct(several[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mixed(whole * _STEPS[1] + h[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles that are indexed, in the global order: by known frequency, then by hash."""
    n = len(s)
    need = n - -(-LEAST * n // 100) + 1
    if len(frequent[0]):
        k = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
        weight = np.where(frequent[0][k] == s, frequent[1][k], 0)
        if weight.any():
            s = s[np.argsort(weight, kind="stable")]
    return s[:need]


def _sets(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    for texts in chunks(batch.column(batch.schema.get_field_index(name))):
        yield from shingle_sets(texts)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def give() -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x[n > 2].view(np.int64)), pa.array(n[n > 2].astype(np.int64))], names=["token", "n"])

    seen: set[bytes] = set()
    for batch in batches:
        keys = batch.column(1)
        for k, s in enumerate(_sets(batch, "text")):
            key = keys[k].as_py()
            if key not in seen:
                seen.add(key)
                held.append(s)
                size += len(s)
        if size > COUNTED:
            yield give()
            held, size = [], 0
            seen.clear()
    yield give()


def _index(sent):
    """Entries (token, key, n, pos) of prefixes, and one at pos -1 for each set, under a token of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(1)
            tokens, sizes, places, rows = [], [], [], []
            for k, s in enumerate(_sets(batch, "text")):
                key = keys[k].as_py()
                if key in seen or not len(s):
                    continue
                seen.add(key)
                p = prefix(s, sent.value)
                tokens += [np.frombuffer(key[:8], np.uint64), p]
                sizes.append(np.full(len(p) + 1, len(s), np.int32))
                places.append(np.arange(-1, len(p), dtype=np.int32))
                rows.append(np.full(len(p) + 1, k, np.int64))
            if len(seen) > 200_000:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "key", "n", "pos"])

    return run


def _compare(differences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            common, n_a, n_b, more, less = [], [], [], [], []
            left = batch.column(batch.schema.get_field_index("a"))
            texts = batch.column(batch.schema.get_field_index("text_a"))
            for k, t in enumerate(_sets(batch, "text_b")):
                key = left[k].as_py()
                if key != last[0]:
                    last = (key, shingle_sets([(texts[k].as_py() or "").encode()])[0])
                s = last[1]
                n = len(np.intersect1d(s, t, assume_unique=True))
                common.append(n)
                n_a.append(len(s))
                n_b.append(len(t))
                near = differences and 100 * n >= NEAR * (len(s) + len(t) - n)
                more.append(_short(np.setdiff1d(t, s, assume_unique=True)) if near else None)
                less.append(_short(np.setdiff1d(s, t, assume_unique=True)) if near else None)
            counts = [pa.array(x, pa.int64()) for x in (common, n_a, n_b)]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (more, less)] if differences else []
            names = ["a", "b", "common", "n_a", "n_b", *(["more", "less"] if differences else [])]
            yield pa.RecordBatch.from_arrays([left, batch.column(batch.schema.get_field_index("b")), *counts, *lists], names=names)

    return run


def _short(s: np.ndarray) -> np.ndarray:
    """32 bits of each hash: two that fall together only add candidates."""
    return (s >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _compared(pairs: DataFrame, some: DataFrame) -> DataFrame:
    """(a, b, common, n_a, n_b) of each pair of keys, on the sets of the whole texts in ``some``.

    ``pairs`` is a written table: where it is small its size is known, and no text moves.
    """
    first = pairs.join(some.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return _differ(first.join(some.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a"), False)


def _differ(both: DataFrame, differences: bool) -> DataFrame:
    """(a, b, common, n_a, n_b) of each row's two whole texts.

    With ``differences`` also the shingles that b has ``more`` than a and ``less`` than a, if they are near.
    """
    schema = "a binary, b binary, common bigint, n_a bigint, n_b bigint" + (", more array<int>, less array<int>" if differences else "")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(differences), schema)


def _by_differences(first: DataFrame, known: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of different components and the same near first set that may be linked; tables read.

    ``first``: each set's comparison with its first set, with differences; ``known``: (node, root).
    """
    near = first.where("more is not null").select(F.col("a").alias("center"), F.col("b").alias("key"), F.col("n_a").alias("n_center"), F.col("n_b").alias("n"), "more", "less")
    near = near.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = near.groupBy("center").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("center")
    near = near.join(several, "center").withColumns({"n_less": F.size("less"), "n_more": F.size("more"), "delta": F.size("more") + F.size("less")})
    near = written(near, "near")
    base = ["center", "key", "n_center", "n", "root", "n_less", "delta"]
    # Shared losses come last in the order. A pair needs them only where neither set loses more than
    # |H| - overlap, which for either set means: losses and three times its gains are within |H|.
    gains = near.select(*base, "n_more", F.explode("more").alias("token"), F.lit(False).alias("lost"))
    losses = near.where("n_less + 3 * n_more <= n_center").select(*base, "n_more", F.explode("less").alias("token"), F.lit(True).alias("lost"))
    on_list = Window.partitionBy("center", "token")
    e = gains.unionByName(losses).withColumns({"of": F.count(F.lit(1)).over(on_list), "lo": F.min("root").over(on_list), "hi": F.max("root").over(on_list)})
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("center", "key").orderBy("lost", "of", "token")) - 1)
    e = written(e.where("lo <> hi").select(*base, "token", "pos"), "differences")
    cols = ("key", "n", "root", "n_less", "delta", "pos")
    left = e.select("center", "token", "n_center", *[F.col(c).alias(f"{c}_a") for c in cols])
    right = e.select("center", "token", *[F.col(c).alias(f"{c}_b") for c in cols])
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * LEAST / (100 + LEAST))
    need = overlap - F.col("n_center") + F.col("n_less_a") + F.col("n_less_b")
    after = F.least(F.col("delta_a") - F.col("pos_a"), F.col("delta_b") - F.col("pos_b"))
    may = (
        (F.col("key_a") < F.col("key_b"))
        & (F.col("root_a") != F.col("root_b"))
        & (100 * F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b"))
        & (after >= need)
    )
    pairs = left.join(right, ["center", "token"]).where(may).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), need.cast("int").alias("need")).distinct()
    # Common differences, all of them, must do.
    lists = near.select("key", F.concat("more", "less").alias("all"))
    both = pairs.join(lists.select(F.col("key").alias("a"), F.col("all").alias("all_a")), "a").join(lists.select(F.col("key").alias("b"), F.col("all").alias("all_b")), "b")
    # Short hashes of one set may fall together; then the count is not to be trusted, and the pair stays.
    alike = (F.size(F.array_intersect("all_a", "all_b")) >= F.col("need")) | (F.size(F.array_distinct("all_a")) < F.size("all_a")) | (F.size(F.array_distinct("all_b")) < F.size("all_b"))
    return both.where(alike).select("a", "b"), [near, e]


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", root_col: str | None = None) -> DataFrame:
    """``docs`` with ``n_shingles`` (long) and ``component_id``, the least id that links can reach.

    Defined cases: null and empty texts, and texts without words, have the empty set and are linked
    with nothing, not even each other; a text of fewer words than a shingle has one shingle of all
    its words; equal texts are one class (ties and repeated rows share a component); a null id is
    passed over when the least is sought, but where all are null; texts count whole; an empty table
    gives no rows; columns named like the outputs are replaced, all others stay. No pair is dropped.
    Ids may be null or repeat over components; ``root_col`` names a further column that never does:
    the key of the component itself, null for the empty set.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_shingles", "component_id")
    kname, found_id, found_root = fresh(docs, "key", "component", "component_root")
    key = F.unhex(F.md5(F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")))
    texts = docs.select(col(text_col).alias("text"), key.alias("key"))

    # Which shingles are frequent; this only orders the index.
    counts = texts.mapInArrow(_frequent, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    heavy = {r[0]: r[1] for r in counts.where("n >= 8").orderBy(F.desc("n"), "token").limit(MOST_SENT).collect()}
    by_token = Window.partitionBy("token")
    for turn in range(ROUNDS):
        tokens = np.array(sorted(heavy, key=lambda x: x % 2**64), np.int64)
        sent = spark.sparkContext.broadcast((tokens.view(np.uint64), np.array([heavy[t] for t in tokens.tolist()], np.int64)))
        entries = texts.mapInArrow(_index(sent), "token bigint, key binary, n int, pos int")
        # Size blocks: partners stand in the same block or the next.
        block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / LEAST))).cast("int")
        index = entries.repartition("token").dropDuplicates(["token", "key"]).withColumn("of", F.count(F.lit(1)).over(by_token)).where("of > 1 or pos < 0").withColumn("block", block)
        # The original of a family of copies has most of its prefix on long lists: it comes first.
        index = index.withColumn("listed", F.sum("of").over(Window.partitionBy("key")))
        head = F.first("key").over(Window.partitionBy("token", F.floor(F.log2(F.col("n").cast("double")))).orderBy(F.desc("listed"), "key"))
        index = written(index.withColumn("head", head), "index")
        more = {r[0]: r[1] for r in index.where(F.col("of") > LONG_LIST).groupBy("token").agg(F.max("of")).limit(MOST_SENT).collect() if heavy.get(r[0], 0) == 0}
        sent.unpersist()
        if not more or turn == ROUNDS - 1 or len(heavy) + len(more) > MOST_SENT:
            break
        heavy |= more
        discard(index)

    # Whole texts of all that stand on a list, once each, with the first set of the block with which
    # each shares most lists; no other text can be linked.
    best = F.max(F.struct("c", "other")).alias("x")
    shared = index.where("head <> key").groupBy("key", F.col("head").alias("other")).agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(best)
    listed = written(index.where("pos >= 0").select("key").distinct().join(shared.select("key", "x.other"), "key", "left"), "listed")
    once = texts.join(listed.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    pool = written(once.join(listed, "key"), "texts")
    discard(listed)

    # First round: each set against its first set. Texts of first sets alone go by their key once more.
    firsts = pool.select(F.col("other").alias("key")).where("key is not null").distinct()
    of_firsts = pool.join(firsts, "key", "left_semi").select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    with_text = pool.where("other is not null").select(F.col("other").alias("a"), F.col("key").alias("b"), F.col("text").alias("text_b"))
    first = written(_differ(with_text.join(of_firsts, "a"), True), "first")
    is_link = F.col("common") * (100 + LEAST) >= (F.col("n_a") + F.col("n_b")) * LEAST
    links = first.where(is_link).select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = components(links)

    # Neighbours on a list that are in different components, likewise; each turn joins components.
    def rooted_index() -> DataFrame:
        return index.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    tried = first.select("a", "b")
    spent = [first]
    for _ in range(TURNS):
        on_list = Window.partitionBy("token", "block").orderBy(F.desc("listed"), "key")
        near = rooted_index().select("key", "root", F.lag("key").over(on_list).alias("other"), F.lag("root").over(on_list).alias("of_other")).where("root <> of_other")
        new = near.select(F.col("other").alias("a"), F.col("key").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
        new = written(new.join(tried, ["a", "b"], "left_anti").groupBy("b").agg(F.max(F.struct("c", "a")).alias("x")).select("x.a", "b"), "new")
        turn_found = written(_compared(new, pool), "turn")
        discard(new)
        spent.append(turn_found)
        tried = tried.unionByName(turn_found.select("a", "b"))
        more_links = turn_found.where(is_link).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if more_links.isEmpty():
            break
        before, known = known, components(known.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more_links))
        discard(before)

    # Last round: across components only. Sets with the same near first set go by their differences to
    # it, all others by their prefixes, where sizes, places and counts allow a link.
    center = first.where("more is not null").select(F.col("a").alias("center"), F.col("b").alias("key"))
    e = rooted_index().join(center, "key", "left")
    e = e.withColumns({"lo": F.min("root").over(by_token), "hi": F.max("root").over(by_token), "c_lo": F.min(F.coalesce("center", "key")).over(by_token), "c_hi": F.max(F.coalesce("center", "key")).over(by_token)})
    e = written(e.where("lo <> hi and c_lo <> c_hi and pos >= 0").select("token", "key", "n", "pos", "root", "block", "center"), "across")
    a = e.select("token", "block", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "pos", "root", "center")], F.lit(True).alias("same"))
    a = a.unionByName(a.withColumns({"block": F.col("block") + 1, "same": F.lit(False)}))
    b = e.select("token", "block", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "pos", "root", "center")])
    bound = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    may = (
        (F.col("root_a") != F.col("root_b"))
        & (~F.col("same") | (F.col("key_a") < F.col("key_b")))
        & (100 * F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b"))
        & ((F.least("pos_a", "pos_b") + bound) * (100 + LEAST) >= LEAST * (F.col("n_a") + F.col("n_b")))
        & ~F.coalesce(F.col("center_a") == F.col("center_b"), F.lit(False))
    )
    # Shared shingles among the first ones, and all that can stand behind them, must do for a link.
    behind = F.greatest(F.ceil(F.col("n_a") * LEAST / 100), F.ceil(F.col("n_b") * LEAST / 100)) - 1
    enough = (F.col("c") + behind) * (100 + LEAST) >= LEAST * (F.col("n_a") + F.col("n_b"))
    counted = a.join(b, ["token", "block"]).where(may).groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    both_ways = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    alike, used = _by_differences(first, known)
    rest = written(counted.where(enough).select("a", "b").unionByName(alike).distinct().join(both_ways, ["a", "b"], "left_anti"), "rest")
    discard(e, *used, *spent)
    second = written(_compared(rest, pool).where(is_link).select(F.col("a").alias("u"), F.col("b").alias("v")), "second")
    discard(rest, pool)
    whole = components(known.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second))
    discard(known, second)

    # The least id of each class of equal texts, then of each component; only keys and ids move.
    classes = docs.select(key.alias("key"), col(id_col).alias("id")).groupBy("key").agg(F.min("id").alias("id"))
    rooted = classes.join(whole.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    sizes = index.where("pos < 0").select("key", F.col("n").cast("long").alias("n_shingles"))
    by_key = written(rooted.join(least, "root").join(sizes, "key").select(F.col("key").alias(kname), "n_shingles", F.col("component_id").alias(found_id), *([F.col("root").alias(found_root)] if root_col else [])), "components")
    discard(whole, index)
    has = F.col("n_shingles").isNotNull()
    roots = [F.col(found_root).alias(root_col)] if root_col else []
    found = docs.withColumn(kname, key).join(by_key, kname, "left")
    own = F.when(has, F.col(found_id)).otherwise(col(id_col)).alias("component_id")
    return found.select(*[col(c) for c in docs.columns], F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), own, *roots)
