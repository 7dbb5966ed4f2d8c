"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each Arrow batch of documents is a shard. Its words become numbers of the benchmark's vocabulary;
runs of vocabulary words too short for any window cannot hold a match and leave. A suffix array over
the rest is built by prefix doubling, and every suffix of every benchmark item is binary-searched in
it, word by word, which gives the longest verbatim match of the suffix, its places, and the places
where its window occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import LOWER, PrefixHash, chunks, joined, table, words
from .util import col, fresh

#: Consecutive words that make a window.
WINDOW = 10
#: Bytes of benchmark texts that go to every task at once; more texts go in several blocks.
BLOCK_BYTES = 16 << 20

IS_WORD = table(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
OUT = ("n_words", "n_hit", "items", "longest", "locations", "contaminated")


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` in the order of their first ``depth`` numbers at least, by prefix doubling."""
    rank = seq.astype(np.int64)
    known, n = 1, len(seq)
    order = np.argsort(rank, kind="stable")
    while known < depth and n:
        later = np.full(n, -1, np.int64)
        later[: max(0, n - known)] = rank[known:]
        order = np.lexsort((later, rank))
        a, b = rank[order], later[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = new
        known *= 2
        if rank.max() == n - 1:
            break
    return order


class Benchmark:
    """One block of items: vocabulary, and all suffixes of all items as patterns."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, at = joined([(t or "").encode() for _, t in items])
        data = LOWER[data]
        starts, ends = words(data, IS_WORD)
        self.names = [i for i, _ in items]
        raw = data.tobytes()
        vocab: dict[bytes, int] = {}
        ids = np.array([vocab.setdefault(raw[s:e], len(vocab) + 1) for s, e in zip(starts, ends, strict=True)], np.int64)
        self.text = [b"", *vocab]
        lengths = np.array([len(w) for w in self.text[1:]], np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
        flat = np.frombuffer(b"".join(self.text), np.uint8)
        h = PrefixHash(flat).of(first, first + lengths) if len(flat) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hash, self.id = h[order], (order + 1).astype(np.int64)
        item = np.searchsorted(at, starts, side="right") - 1
        count = np.bincount(item, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        end_of_item = np.cumsum(count)
        self.seq = np.concatenate((ids, [0]))
        self.start = np.arange(len(ids))
        self.item = item
        self.left = (end_of_item[item] - self.start).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.need = np.minimum(window, count[item]) if len(ids) else np.zeros(0, np.int64)
        self.is_window = self.left >= self.need
        self.shortest = int(self.need.min()) if len(ids) else window
        self.depth = int(count.max()) if len(items) else 0

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of each hash, 0 if it is not there."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[k] == h, self.id[k], 0)


def _narrow(seq, sa, lo, hi, depth, want):
    """Within sa[lo:hi], whose suffixes share ``depth`` numbers, those that go on with ``want``."""
    edges = []
    for beyond in (False, True):
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) // 2
            got = seq[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(seq) - 1)]
            right = open_ & ((got <= want) if beyond else (got < want))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        edges.append(a)
    return edges


def scan(texts: list[bytes], bench: Benchmark) -> tuple[list[np.ndarray], np.ndarray, list[set[int]], np.ndarray]:
    """For each text: which words are hit, how many words, the items, and the longest match in words."""
    data, at = joined(texts)
    data = LOWER[data]
    starts, ends = words(data, IS_WORD)
    doc = np.searchsorted(at, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    hit = np.zeros(len(starts), bool)
    items: list[set[int]] = [set() for _ in texts]
    longest = np.zeros(len(texts), np.int64)
    ids = bench.look_up(PrefixHash(data).of(starts, ends)) if len(starts) else np.zeros(0, np.int64)
    while len(ids):
        # Runs of vocabulary words within one text.
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (ids[1:] == 0) | (ids[:-1] == 0))))
        size = np.diff(np.concatenate((edge, [len(ids)])))
        keep = (size >= bench.shortest) & (ids[edge] != 0)
        edge, size = edge[keep], size[keep]
        if not len(edge):
            break
        # The runs one after another, a 0 after each.
        total = int((size + 1).sum())
        begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        place = np.arange(total) - np.repeat(begin - edge, size + 1)
        seq = ids[np.minimum(place, len(ids) - 1)].copy()
        seq[begin + size] = 0
        sa = suffix_array(seq, bench.depth)
        lo, hi = np.zeros(len(bench.start), np.int64), np.full(len(bench.start), total, np.int64)
        live = np.arange(len(bench.start))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        depth = 0
        while len(live):
            going = bench.left[live] > depth
            live, lo, hi = live[going], lo[going], hi[going]
            if not len(live):
                break
            lo, hi = _narrow(seq, sa, lo, hi, depth, bench.seq[bench.start[live] + depth])
            depth += 1
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            full = bench.is_window[live] & (bench.need[live] == depth)
            long = bench.need[live] <= depth
            if full.any():
                found.append((live[full], lo[full], hi[full], depth))
            if long.any():
                where = np.unique(sa[_ranges(lo[long], hi[long])])
                np.maximum.at(longest, doc[place[where]], depth)
        wrong = []
        hits = []
        for pattern, a, b, size_ in found:
            which = np.repeat(pattern, b - a)
            where = place[sa[_ranges(a, b)]]
            hits.append((which, where))
            for j in range(size_):
                hit[where + j] = True
        # Hashes may collide: the words that are hit are compared as bytes.
        raw = data.tobytes()
        for w in np.flatnonzero(hit):
            if raw[starts[w] : ends[w]] != bench.text[ids[w]]:
                wrong.append(w)
        if wrong:
            ids[wrong] = 0
            hit[:] = False
            longest[:] = 0
            continue
        for which, where in hits:
            for d, i in np.unique(np.stack((doc[where], bench.item[which])), axis=1).T:
                items[d].add(int(i))
        break
    return [hit[first[k] : first[k + 1]] for k in range(len(texts))], n, items, longest


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lo, size)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids as strings), ``longest``, ``locations``, ``contaminated``.

    A word is hit if it stands in an occurrence of a window: ``window`` consecutive words of an item,
    or all words of a shorter one. ``longest``: words of the longest match that holds a window (0: none).
    ``locations``: (start, end) of each run of hit words, counted in words of the document.
    Defined cases: null and empty texts have no words and match nothing; texts of any length are
    searched whole (one text is the least shard, so memory follows the longest text); repeated
    documents are judged alike and repeated items count under each of their ids; a null item id is
    the string ``null``; an empty table on either side gives no rows or no hits. Columns named like
    the outputs are replaced, all others stay. The benchmark goes to the tasks in blocks of
    ``BLOCK_BYTES`` at most, however large it is; documents never move.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OUT)
    bits, names, far, runs = fresh(docs, "bits", "names", "far", "runs")
    of_runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    item = F.coalesce(col(item_col).cast("string"), F.lit("null"))
    bench = benchmark.select(item.alias("i"), col(item_text).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 16)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    out = docs
    schema = T.StructType([*docs.schema.fields, T.StructField(bits, T.BinaryType()), T.StructField(names, T.ArrayType(T.StringType())), T.StructField(far, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField(runs, of_runs)])
    for k in range(blocks):
        part = [(r.i, r.t) for r in bench.where(block == k).orderBy("i", "t").collect()]
        sent = spark.sparkContext.broadcast(part)
        out = out.mapInArrow(_scanner(sent, window, text_col, (bits, names, far, runs), len(docs.columns), k == 0), schema)
    return out.select(*[col(c) for c in docs.columns], "n_words", "n_hit", F.array_sort(F.array_distinct(names)).alias("items"), F.col(far).alias("longest"), F.col(runs).alias("locations"), (F.col("n_hit") > 0).alias("contaminated"))


def _scanner(sent, window: int, text_col: str, cols: tuple[str, str, str, str], width: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(sent.value, window)
        for batch in batches:
            done: list[tuple] = []
            text = batch.column(batch.schema.get_field_index(text_col))
            for texts in chunks(text):
                hits, n, items, longest = scan(texts, bench)
                for hit, m, found, far in zip(hits, n, items, longest, strict=True):
                    k = len(done)
                    names = sorted({bench.names[i] for i in found})
                    if not first:
                        old = np.unpackbits(np.frombuffer(batch.column(width)[k].as_py(), np.uint8), count=int(m)).astype(bool)
                        hit = hit | old
                        names = batch.column(width + 1)[k].as_py() + names
                        far = max(int(far), batch.column(width + 2)[k].as_py())
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)) if hit.any() else ()
                    where = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    done.append((np.packbits(hit).tobytes(), names, int(far), int(m), int(hit.sum()), where))
            more = list(zip(*done, strict=True)) if done else [[], [], [], [], [], []]
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            kinds = (pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.list_(span))
            arrays = [pa.array(list(x), kind) for x, kind in zip(more, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=[*batch.schema.names[:width], *cols[:3], "n_words", "n_hit", cols[3]])

    return run
