"""Token-id files: whole texts as ids in ascending order of document, in independent coded blocks.

A file set is a Parquet table of (part, seq, block): Spark's committer makes its files appear whole or
not at all, on any store. Each block holds an index of its pieces of documents and the coded ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .token_coder import BLOCK, ID_LIMIT, decode, encode
from .util import col, written

#: Bytes of text for each part, and of texts that are split at once.
PART_BYTES, _AT_ONCE = 10 << 20, 1 << 20
#: Different pre-tokens whose ids a worker keeps, about 50 bytes each, before it starts anew.
_CACHE = 1_000_000
#: Pre-tokens that go to the library as one text, and parts whose sizes one task adds up.
_JOINED, _PARTS = 1000, 1024
_PIECE = np.dtype([("ordinal", "<i8"), ("id", "<i8"), ("n", "<u4"), ("null", "u1"), ("first", "u1"), ("last", "u1")])


#: Where a text may be cut: what stands before white space never changes pre-tokens behind it.
_CUT = re.compile(rb"[!-~](?=[ \n])")
#: Stands behind each text; no UTF-8 holds it.
_STOP = 0xFF
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)


def _classes() -> np.ndarray:
    """The class of each code point in the byte-level pattern."""
    import regex

    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _starts(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in UTF-8 texts with ``_STOP`` behind each; each stop is one by itself.

    By the pattern of ``public_tokenizers.PATTERN``: runs of one class, where a blank before a run
    belongs to it, other white space parts before its last character unless its text ends there, and
    an apostrophe that begins a pre-token takes the letters of a contraction alone.
    """
    kind = classes[:128].take(data & 127)
    stop = np.flatnonzero(data == _STOP)
    lead = np.flatnonzero((data >= 0xC0) & (data != _STOP))
    if len(lead):
        first = data.take(lead).astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            code[more] = code[more] << 6 | (data.take(lead[more] + k) & 0x3F)
        of = classes.take(code)
        kind[lead] = of
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            kind[lead[more] + k] = of[more]
    kind[stop] = _END
    begins = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[stop] = True
    runs = np.flatnonzero(begins)
    after = np.flatnonzero((kind.take(runs[:-1]) == _SPACE) & (kind.take(runs[1:]) != _END))
    behind = runs[after + 1]
    last = behind - 1
    while len(on := np.flatnonzero((data.take(last) & 0xC0) == 0x80)):
        last[on] -= 1
    begins[last] = True
    begins[behind[data.take(last) == 0x20]] = False
    mark = np.flatnonzero((data == 0x27) & begins)
    if len(mark):
        end = len(data) - 1
        one, two = data.take(np.minimum(mark + 1, end)), data.take(np.minimum(mark + 2, end))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[mark[short | long] + 1] = False
        begins[mark[short] + 2] = True
        begins[mark[long] + 3] = True
    return np.flatnonzero(begins)


def _cuts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > _AT_ONCE and (m := _CUT.search(text, at + _AT_ONCE // 2)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class _Known:
    """Ids of pre-tokens by their bytes: up to 16 in a table of two 64-bit numbers, longer in a dict."""

    _UNDER = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, end_id: int):
        self.n = 1  # entry 0 stands for none
        self.low, self.high = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.size, self.at, self.count = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 13, np.uint16), 0
        self.slots = np.zeros(1 << 14, np.int32)
        self.long: dict[bytes, int] = {}
        self.add(np.array([_STOP], np.uint64), np.zeros(1, np.uint64), np.ones(1, np.int64), [np.array([end_id], "<u2").tobytes()])

    @classmethod
    def keys(cls, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the next eight bytes; ``data`` goes on for 16 bytes behind the last start."""
        eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        return eight[start] & cls._UNDER.take(np.minimum(size, 8)), eight[start + 8] & cls._UNDER.take(np.clip(size - 8, 0, 8))

    @staticmethod
    def mixed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)

    def _first(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        slot = self._first(mixed)
        out = self.slots.take(slot).astype(np.int64)
        on = np.flatnonzero((self.low.take(out) != low) | (self.high.take(out) != high) | (self.size.take(out) != size))
        while len(on := on[out[on] != 0]):
            slot[on] = (slot[on] + 1) & (len(self.slots) - 1)
            e = self.slots.take(slot[on])
            out[on] = e
            on = on[(self.low.take(e) != low[on]) | (self.high.take(e) != high[on]) | (self.size.take(e) != size[on])]
        return out

    def _place(self, entries: np.ndarray) -> None:
        slot = self._first(self.mixed(self.low[entries], self.high[entries], self.size[entries]))
        while len(entries):
            free = self.slots.take(slot) == 0
            self.slots[slot[free]] = entries[free]
            on = np.flatnonzero(self.slots.take(slot) != entries)
            entries, slot = entries[on], (slot[on] + 1) & (len(self.slots) - 1)

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Entries of new keys. Sizes over 16 are found by ``long`` alone."""
        new = np.arange(self.n, self.n + len(ids))
        more, joined = self.n + len(ids), np.frombuffer(b"".join(ids), "<u2")
        if more > len(self.low):
            room = 1 << more.bit_length()
            self.low, self.high, self.size, self.at, self.count = (np.concatenate((x, np.zeros(room - len(x), x.dtype))) for x in (self.low, self.high, self.size, self.at, self.count))
        if self.used + len(joined) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool) + len(joined), np.uint16)))
        count = np.array([len(x) // 2 for x in ids], np.int64)
        self.low[new], self.high[new], self.size[new], self.count[new] = low, high, size, count
        self.at[new] = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(joined)] = joined
        self.used, self.n = self.used + len(joined), more
        if 2 * more > len(self.slots):
            self.slots = np.zeros(2 << more.bit_length(), np.int32)
            new_or_all = np.arange(1, more)
        else:
            new_or_all = new
        self._place(new_or_all[self.size[new_or_all] <= 16])
        return new


class Ids:
    """Ids of whole texts, as the library gives them with ``add_special_tokens=False``, an end after each.

    Where the file's pre-tokenizer is the byte-level pattern alone, ids of a text are those of its
    pre-tokens, and the library encodes each once. A text that holds a string of an added token goes
    to the library whole, as do all texts of any other kind of file.
    """

    def __init__(self, path: str, end_id: int):
        # A task has one core: threads of the library would only add to memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > ID_LIMIT:
            raise ValueError(f"the vocabulary has more than {ID_LIMIT} ids")
        plan = json.loads(self.tokenizer.to_str())
        before = plan.get("pre_tokenizer") or {}
        self.by_words = plan.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        self.added = [t["content"].encode() for t in plan.get("added_tokens") or ()]
        # Ids that begin with a blank: of words of a blank and letters, the first has it and no other.
        self.blank = np.zeros(ID_LIMIT, bool)
        self.blank[[k for t, k in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.end_id, self.classes = end_id, _classes()
        self.known = _Known(end_id)

    def _encode(self, new: list[str]) -> list[bytes]:
        """Ids of pre-tokens; those of a blank and letters are joined, as the library parts them again."""
        out: list[bytes] = [b""] * len(new)
        plain = [k for k, p in enumerate(new) if p[0] == " " and p[1:].isalpha()]
        alone = [k for k, p in enumerate(new) if p[0] != " " or not p[1:].isalpha()]
        groups = [plain[a : a + _JOINED] for a in range(0, len(plain), _JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(new[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            starts = np.flatnonzero(self.blank.take(ids))
            if len(starts) != len(group) or starts[0]:
                alone += group
                continue
            coded, starts = ids.tobytes(), [*(starts * 2).tolist(), 2 * len(ids)]
            for k, a, b in zip(group, starts, starts[1:], strict=False):
                out[k] = coded[a:b]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([new[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u2").tobytes()
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts one after the other, and where each text's ids end."""
        whole = [k for k, t in enumerate(texts) if not self.by_words or any(a in t for a in self.added)]
        if not whole and len(texts) == 1:  # a long text, some at a time
            parts = [self._of_words([cut])[0] for cut in _cuts(texts[0])]
            ids = np.concatenate([*(p[:-1] for p in parts[:-1]), parts[-1]])
            return ids, np.array([len(ids)])
        if not whole:
            return self._of_words(texts)
        rest = list(texts)
        for k in whole:
            rest[k] = b""
        ids, ends = self._of_words(rest)
        found = self.tokenizer.encode_batch_fast([texts[k].decode() for k in whole], add_special_tokens=False)
        more = [np.array(e.ids, np.uint16) for e in found]
        longer = np.zeros(len(texts), np.int64)
        longer[whole] = [len(m) for m in more]
        places = np.repeat(ends[whole] - 1, longer[whole])
        return np.insert(ids, places, np.concatenate(more)), ends + np.cumsum(longer)

    def _of_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        stop = bytes([_STOP])
        joined = stop.join([*texts, bytes(16)])
        used = len(joined) - 16
        data = np.frombuffer(joined, np.uint8)
        start = _starts(data[:used], self.classes)
        size = np.diff(start, append=used)
        if self.known.n > _CACHE:
            self.known = _Known(self.end_id)
        known = self.known
        low, high = known.keys(data, start, size)
        mixed = known.mixed(low, high, size)
        entry = known.find(low, high, size, mixed)
        if len(over := np.flatnonzero(size > 16)):
            words = [joined[a : a + n] for a, n in zip(start[over].tolist(), size[over].tolist(), strict=True)]
            if new := list(set(words).difference(known.long)):
                zero = np.zeros(len(new), np.uint64)
                its = known.add(zero, zero, np.array([len(w) for w in new]), self._encode([w.decode() for w in new]))
                known.long.update(zip(new, its.tolist(), strict=True))
            entry[over] = [known.long[w] for w in words]
        # Unlike words of equal hash come one after the other; the table tells them apart by their bytes.
        while len(miss := np.flatnonzero(entry == 0)):
            first = miss[np.unique(mixed[miss], return_index=True)[1]]
            words = [joined[a : a + n].decode() for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True)]
            known.add(low[first], high[first], size[first], self._encode(words))
            entry[miss] = known.find(low[miss], high[miss], size[miss], mixed[miss])
        count = known.count.take(entry)
        ends = np.cumsum(count, dtype=np.int64)
        places = np.repeat(known.at.take(entry) - ends + count, count)
        places += np.arange(len(places))
        stops = ends[data.take(start) == _STOP]
        if len(stops) != len(texts):
            raise ValueError("a text is not UTF-8")
        return known.pool.take(places), stops


#: The encoder of each file; workers that take several tasks keep it.
_encoders: dict[tuple[str, int], Ids] = {}


def _encoder(path: str, end_id: int) -> Ids:
    """A function of the module, for the inner ones go to workers with copies of the globals they name."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Ids(path, end_id)
    return _encoders[path, end_id]


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(path, end_id)
        part, seq, ordinal = 0, 0, 0
        held: list[np.ndarray] = []
        pieces: list[tuple] = []
        used = 0

        def give() -> pa.RecordBatch:
            nonlocal held, pieces, seq, used
            (code,) = encode([np.concatenate(held)])
            block = struct.pack("<I", len(pieces)) + np.array(pieces, _PIECE).tobytes() + code
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([block], pa.binary())], names=["part", "seq", "block"])
            held, pieces, seq, used = [], [], seq + 1, 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            column = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _AT_ONCE, side="right")))
                texts = [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
                ids, ends = ids_of.of(texts)
                at = 0
                for key, end in zip(batch.column(0).slice(a, b - a).to_pylist(), ends.tolist(), strict=True):
                    begin = at
                    while at < end:
                        n = min(BLOCK - used, end - at)
                        held.append(ids[at : at + n])
                        pieces.append((ordinal, key or 0, n, key is None, at == begin, at + n == end))
                        at += n
                        used += n
                        if used == BLOCK:
                            yield give()
                    ordinal += 1
                a = b
        if held:
            yield give()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Writes the ids of every whole text, ``end_id`` after each, in ascending order of ``id_col``.

    Defined cases: a null text is empty and gives the end id alone; null ids come first; equal ids
    (ties, repeated rows) stand next to each other, in the order of a hash of their texts, and may go
    over several parts; texts of any length go over as many blocks as they need; an empty table gives
    an empty file set; other columns are not written, whatever their names. A vocabulary or end id
    that 16 bits do not hold is a ValueError.
    """
    if not 0 <= end_id < ID_LIMIT:
        raise ValueError(f"end_id must be from 0 to {ID_LIMIT - 1}")
    total = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    parts = int(total // PART_BYTES) + 1
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text").asc())
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows.withColumn("part", F.spark_partition_id()).mapInArrow(_writer(tokenizer, end_id), "part int, seq bigint, block binary").write.option("compression", "none").parquet(path)


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                part, seq, block = (c[a].as_py() for c in batch.columns)
                (n,) = struct.unpack_from("<I", block)
                (ids,) = decode([block[4 + n * _PIECE.itemsize :]])
                rows: list[tuple] = []
                at = 0
                for ordinal, key, n, null, _, _ in np.frombuffer(block, _PIECE, n, 4).tolist():
                    data = ids[at : at + n].tobytes()
                    rows.append((part, ordinal, None if null else key, seq, n, zlib.crc32(data), *([data] if with_ids else [])))
                    at += n
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 6 + with_ids]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["part", "ordinal", "id", "seq", "n", "crc", "ids"][: len(kinds)])

    return run


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(part, ordinal, id, seq, n, crc, ids): a row for each piece of a document in a block.

    ``ordinal`` counts documents within the part, ``seq`` its blocks; ``ids`` are little-endian 32-bit
    numbers. An empty file set gives no rows; a block that is cut off or damaged is a ValueError.
    """
    schema = "part int, ordinal bigint, id bigint, seq bigint, n bigint, crc bigint" + (", ids binary" if with_ids else "")
    return spark.read.schema("part int, seq bigint, block binary").parquet(path).mapInArrow(_reader(with_ids), schema)


def _join_crc(pieces: pd.Series) -> pd.Series:
    """The crc32 of a whole from its pieces: appending n bytes acts on the state as n zero bytes do."""
    out = []
    for row in pieces:
        crc = 0
        for p in row:
            zeros = bytes(4 * int(p["n"]))
            crc = int(p["crc"]) ^ zlib.crc32(zeros, crc) ^ zlib.crc32(zeros, 0)
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the decoded ids of the files.

    ``start`` counts the ids of all documents before. Documents of equal or null id have a row each;
    an empty file set gives no rows.
    """
    pieces = read_pieces(spark, path, with_ids=False).select("part", "ordinal", "id", F.struct("seq", "n", "crc").alias("p"))
    docs = pieces.groupBy("part", "ordinal").agg(F.first("id").alias("id"), F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.pandas_udf(_join_crc, T.LongType())
    docs = docs.withColumn("n_tokens", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    docs = written(docs, "pieces")
    # Most documents are one piece, whose checksum is the whole's.
    whole = docs.where(F.size("p") == 1).withColumn("ids_crc32", F.col("p")[0]["crc"])
    more = docs.where(F.size("p") > 1).withColumn("ids_crc32", joined("p"))
    docs = whole.unionByName(more).drop("p")
    # Ids before each part: within its group of parts, and before the group.
    sizes = written(docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.floor(F.col("part") / _PARTS)), "parts")
    groups = sizes.groupBy("g").agg(F.sum("n").alias("of")).withColumn("ahead", F.sum("of").over(Window.orderBy("g")) - F.col("of")).select("g", "ahead")
    within = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    base = sizes.withColumn("base", within).join(groups, "g").select("part", (F.col("base") + F.col("ahead")).alias("base"))
    run = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("ordinal"))
    return docs.join(base, "part").select("id", (F.col("base") + run - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "ids_crc32")
