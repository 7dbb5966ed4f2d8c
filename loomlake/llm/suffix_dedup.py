"""Removal of long repeated byte strings, by a hash-compared suffix sort.

Any two equal strings of ``length`` bytes share their anchor: the place in them whose gram of half that
length has the least hash. So texts give their anchors (about one in a hundred places), and only
suffixes that begin at anchors with equal grams can share a string of that length. A stretch around an
anchor that recurs as a whole is repeated as a whole, which its gram and a cryptographic digest of its
bytes tell. The different stretches of one gram are compared: the suffixes at their anchors are
mergesorted, where prefix polynomial hashes and a binary search give the common extension of two
suffixes in a logarithmic number of steps. Neighbours in that order give the extensions to the right,
which are verified byte by byte.

Texts go the same way as sequences of words, each a 64-bit hash, which finds repeated passages of
``passage`` words whatever their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .textbytes import PrefixHash, chunks, joined, mixed, table, words
from .util import col, discard, fresh, written

LENGTH = 400
#: Words of a passage that is reported where it recurs: over fifty.
PASSAGE = 51
#: Stretches that are sorted together; whole groups of equal grams but for longer groups.
BATCH = 3000
#: Above so many different stretches of one gram, Spark counts the strings of the group by their hashes.
MOST_STRETCHES = 20_000
#: Places that are numbered at once; longer texts go in overlapping pieces.
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_PIECE = 1 << 26
_OF_WORDS = np.uint64(0xA24BAED4963EE407)

IS_WORD = table(r"[^\x20\x09-\x0D]")


def word_units(texts: list[bytes]) -> list[np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text as 64-bit hashes."""
    data, at = joined(texts, b"\n")
    start, end = words(data, IS_WORD)
    h = PrefixHash(data).of(start, end) if len(start) else np.zeros(0, np.uint64)
    edge = np.searchsorted(start, at)
    return [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def laid_out(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences in one array with a gap of one after each, and where each begins; one more for the end."""
    kind = some[0].dtype if some else np.uint8
    gap = np.zeros(1, kind)
    at = np.zeros(len(some) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in some], out=at[1:])
    return np.concatenate([y for x in some for y in (x, gap)]) if some else np.zeros(0, kind), at


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, first and last window start, anchor (within the text), gram hash, stretch digest.

    ``data`` holds bytes or word hashes of several texts, which begin at ``at`` and end one before the next.
    """
    half = length // 2
    wide = length - half + 1
    n = len(data) - half + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < wide:
        return none
    if n > 1 << _PLACE_BITS:
        raise ValueError("too many places at once")
    h = PrefixHash(data)
    place = np.arange(n)
    gram = h.of(place, place + half)
    v = (gram & ~_PLACE) | place.astype(np.uint64)
    pad = np.full(-n % wide, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((v, pad)).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - wide + 1)
    least = (np.minimum(back[starts], ahead[starts + wide - 1]) & _PLACE).astype(np.int64)
    text = np.searchsorted(at, starts, side="right") - 1
    inside = starts + length <= at[text + 1] - 1
    starts, least, text = starts[inside], least[inside], text[inside]
    if not len(starts):
        return none
    edge = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((edge[1:], [len(starts)])) - 1
    lo, hi, a, t = starts[edge], starts[last], least[edge], text[edge]
    view, unit = memoryview(data).cast("B"), data.itemsize
    digest = b"".join([hashlib.blake2b(view[i * unit : j * unit], digest_size=8, salt=k.to_bytes(8, "little")).digest() for i, j, k in zip(lo.tolist(), (hi + length).tolist(), (a - lo).tolist(), strict=True)])
    return t, lo - at[t], hi - at[t], a - at[t], gram[a], np.frombuffer(digest, np.uint64)


def all_anchors(units: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """The anchors of texts of any length: long ones in pieces, each with the windows that begin in it."""
    out = [anchors(*laid_out([x if len(x) <= _PIECE else x[:0] for x in units]), length)]
    for k, x in enumerate(units):
        for begin in range(0, len(x) if len(x) > _PIECE else 0, _PIECE):
            piece = x[begin : begin + _PIECE + length - 1]
            t, lo, hi, a, gram, whole = anchors(*laid_out([piece]), length)
            out.append((t + k, lo + begin, hi + begin, a + begin, gram, whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _extension(h: PrefixHash, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common bytes of the suffixes at i and j, ``most`` at most, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = h.raw(i, i + mid) == h.raw(j, j + mid)
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def suffix_sort(data: np.ndarray, h: PrefixHash, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the suffixes data[start:end] within their groups, by a bottom-up mergesort.

    Each pass finds the place of every suffix in the neighbouring run by binary search, all at once.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    width = 1
    while width < n:
        place = np.arange(n)
        run = place // width
        mate = np.minimum((run ^ 1) * width, n)
        low, high = mate.copy(), np.minimum(mate + width, n)
        x = order[place]
        first = (run & 1) == 0  # ties: what stands in the left run comes first
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            i, j = x[open_], order[mid]
            less = group[j] < group[i]
            same = group[j] == group[i]
            k = np.flatnonzero(same)
            if len(k):
                a, b = i[k], j[k]
                room_a, room_b = end[a] - start[a], end[b] - start[b]
                common = _extension(h, start[a], start[b], np.minimum(room_a, room_b))
                ended_a, ended_b = common == room_a, common == room_b
                at_a = data[np.minimum(start[a] + common, len(data) - 1)]
                at_b = data[np.minimum(start[b] + common, len(data) - 1)]
                tie = ended_a & ended_b
                less[k] = np.where(tie, ~first[open_][k], np.where(ended_b, True, np.where(ended_a, False, at_b < at_a)))
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        target = np.minimum(run, run ^ 1) * width + (place - run * width) + (low - mate)
        new = np.empty_like(order)
        new[target] = x
        order = new
        width *= 2
    return order


def _verified(data: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The common extension as the bytes have it, where hashes say ``size``."""
    if not len(i):
        return size
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    differ = data[np.repeat(i, size) + within] != data[np.repeat(j, size) + within]
    if differ.any():
        size = size.copy()
        row = np.repeat(np.arange(len(i)), size)[differ]
        np.minimum.at(size, row, within[differ])
    return size


def repeated_starts(stretches: list[np.ndarray], off: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window start within it) of all strings that recur in another stretch of the group.

    ``off``: where the anchor stands in each stretch.
    """
    data, at = laid_out(stretches)
    h = PrefixHash(data)
    lo, end = at[:-1], at[1:] - 1
    anchor = lo + off
    order = suffix_sort(data, h, anchor, end, group)
    i, j = order[:-1], order[1:]
    common = _extension(h, anchor[i], anchor[j], np.minimum(end[i] - anchor[i], end[j] - anchor[j]))
    common = np.where(group[i] == group[j], _verified(data, anchor[i], anchor[j], common), -1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    windows = end - lo - length + 1  # starts within each stretch
    item = np.repeat(np.arange(len(lo)), windows)
    start = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    left = off[item] - start  # bytes of the window before the anchor
    # Suffixes that share what the window has behind its anchor, by runs of the sorted order.
    keys = np.empty(len(item), np.uint64)
    by_left = np.argsort(left, kind="stable")
    edges = np.flatnonzero(np.diff(left[by_left], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(by_left)], strict=True):
        at_left = by_left[a:b]
        d = int(left[at_left[0]])
        run = np.concatenate(([0], np.cumsum(common < length - d)))
        it = item[at_left]
        keys[at_left] = mixed(h.of(anchor[it] - d, anchor[it]) ^ (run[rank[it]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    by_key = np.lexsort((keys, left))
    k, d = keys[by_key], left[by_key]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    # Equal keys are verified where they join: bytes before the anchors, and one run of extensions.
    a, b = item[by_key[:-1][same]], item[by_key[1:][same]]
    size = d[1:][same].astype(np.int64)
    for c in range(0, len(a), 20_000):
        part = slice(c, c + 20_000)
        true = _verified(data, anchor[a[part]] - size[part], anchor[b[part]] - size[part], size[part]) == size[part]
        same[np.flatnonzero(same)[part][~true]] = False
    hit = np.concatenate((same, [False])) | np.concatenate(([False], same))
    where = by_key[hit]
    return item[where], start[where]


def _find(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            k = 0
            for texts in chunks(batch.column(0)):
                keys = batch.column(1).slice(k, len(texts))
                k += len(texts)
                new = []
                for t, x in zip(texts, keys.to_pylist(), strict=True):
                    new.append(t if x not in seen else b"")
                    seen.add(x)
                if len(seen) > 200_000:
                    seen.clear()
                for of_words in (False, True):
                    units = word_units(new) if of_words else [np.frombuffer(t, np.uint8) for t in new]
                    text, lo, hi, a, gram, whole = all_anchors(units, passage if of_words else length)
                    if of_words:
                        gram = gram ^ _OF_WORDS
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(text)), pa.array(np.full(len(text), of_words)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))], names=["key", "w", "lo", "hi", "a", "gram", "whole"])

    return run


def _cut(length: int, passage: int):
    """Stretches out of texts; each text once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for text, key, parts in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                b, parts = text.as_py().encode(), parts.as_py()
                units = word_units([b])[0] if any(p["w"] for p in parts) else None
                for p in parts:
                    cut = units[p["lo"] : p["hi"] + passage].tobytes() if p["w"] else b[p["lo"] : p["hi"] + length]
                    out.append((p["gram"], p["whole"], key, p["w"], p["lo"], p["a"] - p["lo"], p["known"], cut))
            if len(seen) > 200_000:
                seen.clear()
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "whole", "key", "w", "lo", "off", "known", "bytes"])

    return run


def _units(cut: bytes, of_words: bool) -> np.ndarray:
    return np.frombuffer(cut, np.uint64 if of_words else np.uint8)


def _sort(length: int, passage: int):
    """Rows come ordered by gram; whole groups are worked on, several at a time."""

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({r[:5]: r for r in rows}.values())  # tasks may give a stretch twice
        for of_words in (False, True):
            some, size = [r for r in rows if r[3] is of_words], passage if of_words else length
            if not some:
                continue
            gram = np.array([r[0] for r in some], np.int64)
            group = np.unique(gram, return_inverse=True)[1]
            item, start = repeated_starts([_units(r[7], of_words) for r in some], np.array([r[5] for r in some], np.int64), group, size)
            fresh_ = ~np.array([r[6] for r in some], bool)[item]
            item, start = item[fresh_], start[fresh_]
            by = np.lexsort((start, item))
            item, start = item[by], start[by]
            edge = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1)))) if len(item) else np.zeros(0, np.int64)
            last = np.concatenate((edge[1:], [len(item)])).astype(np.int64) - 1 if len(edge) else edge
            base = np.array([r[4] for r in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([some[i][2] for i in item[edge]], pa.binary()), pa.array(np.full(len(edge), of_words)), pa.array(base[item[edge]] + start[edge]), pa.array(base[item[edge]] + start[last] + size)], names=["key", "w", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return run


def _strings(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                of_words = get["w"][k].as_py()
                size = passage if of_words else length
                data = _units(get["bytes"][k].as_py(), of_words)
                start = np.arange(len(data) - size + 1)
                one = PrefixHash(data).of(start, start + size)
                two = PrefixHash(data[::-1].copy()).of(len(data) - start - size, len(data) - start)
                lo = get["lo"][k].as_py()
                same = [get["key"][k].as_py()] * len(start)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(same, pa.binary()), pa.array([of_words] * len(start)), pa.array(lo + start), pa.array([get["known"][k].as_py()] * len(start))], names=["one", "two", "key", "w", "start", "known"])

    return run


def _merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, none beyond ``size``."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        end = min(end, size)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _remove(columns: list[str], text_col: str, spans_col: str, length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sizes, removed, runs, kept, repeated = [], [], [], [], []
            for text, spans in zip(get[text_col], get[spans_col], strict=True):
                b, spans = (text.as_py() or "").encode(), spans.as_py() or ()
                merged = _merged([(x["start"], x["end"]) for x in spans if not x["w"]], len(b)) if len(b) >= length else []
                at, parts = 0, []
                for s, e in merged:
                    parts.append(b[at:s])
                    at = e
                parts.append(b[at:])
                sizes.append(len(b))
                removed.append(sum(e - s for s, e in merged))
                runs.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join(parts))
                of_words = [(x["start"], x["end"]) for x in spans if x["w"]]
                n_words = len(b.split()) if of_words else 0
                repeated.append(sum(e - s for s, e in _merged(of_words, n_words)) if n_words >= passage else 0)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[get[c] for c in columns], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())], names=[*columns, "n_bytes", "n_removed", "removed", "kept", "n_passage_words"])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed`` (long), ``removed`` (array of start, end), ``kept`` (binary)
    and ``n_passage_words`` (long).

    A byte goes if a string of ``length`` bytes over it starts anywhere else too, in the same text or
    another; all strings are judged on the input. ``kept`` may cut a character, as it counts bytes.
    ``n_passage_words`` counts the words that stand in ``passage`` words which start anywhere else too:
    it reports passages that are long in words but short of ``length`` bytes, and removes nothing.
    Defined cases: null texts are empty; texts shorter than ``length`` stay whole; equal texts lose
    all their bytes from ``length`` on, each copy alike (ties, repeated rows); texts of any length are
    taken whole; an empty table gives no rows; columns named like the outputs are replaced, others stay.
    """
    docs = docs.drop("n_bytes", "n_removed", "removed", "kept", "n_passage_words")
    kname, spans_col = fresh(docs, "key", "spans")
    text = F.coalesce(col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.encode(text, "UTF-8")))
    texts = docs.select(text.alias("text"), key.alias("key")).where(F.octet_length("text") >= min(length, 2 * passage - 1))
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.explode(F.array(F.lit(False), F.lit(True))).alias("w"), F.lit(0).cast("long").alias("start"), F.lit(2**40).alias("end"))

    found = texts.mapInArrow(_find(length, passage), "key binary, w boolean, lo int, hi int, a int, gram bigint, whole bigint")
    by_gram, by_whole = Window.partitionBy("gram"), Window.partitionBy("gram", "whole")
    several = found.repartition("gram").dropDuplicates(["gram", "key", "lo"]).withColumn("of_gram", F.count(F.lit(1)).over(by_gram)).where("of_gram > 1")
    several = several.withColumns({"of_whole": F.count(F.lit(1)).over(by_whole), "nth": F.row_number().over(by_whole.orderBy("key", "lo"))})
    several = written(several.withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_gram)), "anchors")
    size = F.when(F.col("w"), passage).otherwise(length)
    whole = several.where("of_whole > 1").select("key", "w", F.col("lo").cast("long").alias("start"), (F.col("hi") + size).cast("long").alias("end"))

    # One stretch of each kind, cut out of its text.
    some = several.where("kinds > 1 AND nth = 1").groupBy("key").agg(F.collect_list(F.struct("gram", "whole", "w", "lo", "hi", "a", (F.col("of_whole") > 1).alias("known"))).alias("parts"))
    cut = texts.join(some, "key").select("text", "key", "parts").mapInArrow(_cut(length, passage), "gram bigint, whole bigint, key binary, w boolean, lo int, off int, known boolean, bytes binary")
    long = several.where(F.col("kinds") > MOST_STRETCHES).select("gram").distinct()
    span = "key binary, w boolean, start bigint, end bigint"
    used = [several]
    if long.isEmpty():
        parts = cut.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort(length, passage), span)
    else:
        cut = written(cut, "stretches")
        used.append(cut)
        parts = cut.join(long, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort(length, passage), span)
        strings = cut.join(long, "gram", "left_semi").dropDuplicates(["gram", "key", "lo"]).mapInArrow(_strings(length, passage), "one bigint, two bigint, key binary, w boolean, start bigint, known boolean")
        again = strings.groupBy("one", "two", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two", "w")
        more = strings.where("NOT known").join(again, ["one", "two", "w"]).select("key", "w", "start", (F.col("start") + size).alias("end"))
        parts = parts.unionByName(more)
    spans = copies.unionByName(whole).unionByName(parts).groupBy("key").agg(F.collect_list(F.struct("start", "end", "w")).alias(spans_col)).withColumnRenamed("key", kname)
    spans = written(spans, "spans")
    discard(*used)
    with_spans = docs.withColumn(kname, key).join(spans, kname, "left").drop(kname)
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    outs = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", runs), T.StructField("kept", T.BinaryType()), T.StructField("n_passage_words", T.LongType())]
    return with_spans.mapInArrow(_remove(docs.columns, text_col, spans_col, length, passage), T.StructType([*docs.schema.fields, *outs]))
