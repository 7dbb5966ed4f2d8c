"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

log P(word | context) = log P(class | context) + log P(word | class, context). Both factors are
softmaxes over hashed indicator features of the context: the word before, the one before that (a skip),
and, for the class, both together. The most frequent words are dealt to classes of ``MEMBERS`` words each, whose words the
second softmax draws; the end is a class of its own; all other words fall into classes by their last
letters, within which a word has its smoothed share of the training tokens. The tables of weights grow
with the vocabulary.

Training goes in rounds over disjoint parts of the training texts. In each round every task takes the
weights, makes gradient updates on its texts, and gives back its weights, which Spark averages by
tokens. Word counts cover all training texts; the most frequent words' counts go to every task, all
others are joined by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import LOWER, PrefixHash, chunks, joined, mixed, table, words
from .util import col, discard, fresh, written

#: Classes of frequent words, and classes by ending; the end is one more. A class has as many members.
GROUPS, BY_ENDING = 15, 16
CLASSES = MEMBERS = GROUPS + 1 + BY_ENDING
OWN = GROUPS * MEMBERS
END = GROUPS
#: Rows of the two hashed tables: one for so many different words, from the least to the most (16 MB each).
WORDS_PER_ROW, LEAST_ROWS, MOST_ROWS = 256, 1 << 12, 1 << 17
#: The tables travel in blocks of so many rows; so many copies of a block are averaged by one task.
BLOCK_ROWS, AVERAGED = 1 << 10, 32
ROUNDS = 2
#: Bytes of text that a task trains on at least.
TRAIN_BYTES = 12 << 20
STEP, MINIBATCH = 0.7, 4096
#: Words whose counts go to every task, about 10 MB.
HEAD = 100_000
#: Different words that a task counts before it gives them out.
COUNTED = 200_000

IS_WORD = table(r"[^\x20\x09-\x0D]")
_START = np.uint64(0x5851F42D4C957F2D)


def _ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of a word by its last two bytes."""
    last = data[end - 1].astype(np.int64)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)].astype(np.int64), 0)
    return END + 1 + ((last * 131 + before * 31) % 251) % BY_ENDING


class Encoder:
    """Texts to classes, members and hashed context features."""

    def __init__(self, own: list[bytes], rows: int):
        data, at = joined(own, b" ")
        h = PrefixHash(data).of(at[:-1], at[1:] - 1) if own else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hash, self.number = h[order], order
        self.rows = np.uint64(rows - CLASSES)

    def classes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its place there or -1."""
        out = _ends(data, start, end)
        member = np.full(len(out), -1, np.int64)
        if len(self.hash):
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            own = self.hash[k] == h
            rank = self.number[k[own]]
            out[own], member[own] = rank % GROUPS, rank // GROUPS
        return out, member

    def of_words(self, some: list[bytes]) -> np.ndarray:
        data, at = joined(some, b" ")
        start, end = at[:-1], at[1:] - 1
        return self.classes(data, start, end, PrefixHash(data).of(start, end))[0] if some else np.zeros(0, np.int64)

    def row(self, x: np.ndarray) -> np.ndarray:
        """Rows of hashed features; the first ones are for the classes themselves."""
        return (mixed(x) % self.rows).astype(np.int64) + CLASSES

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """text, class, member and three feature hashes of each token; the end of a text is a token.

        And the words alone: text, bytes, start, end, hash.
        """
        data, at = joined(texts, b"\n")
        data = LOWER[data]
        start, end = words(data, IS_WORD)
        doc = np.searchsorted(at, start, side="right") - 1
        n = np.bincount(doc, minlength=len(texts)) + 1
        text = np.repeat(np.arange(len(texts)), n)
        first = np.cumsum(n) - n
        h = np.full(len(text), np.uint64(1), np.uint64)
        k = np.full(len(text), END, np.int64)
        member = np.full(len(text), -1, np.int64)
        where = np.arange(len(start)) + doc
        wh = PrefixHash(data).of(start, end) if len(start) else np.zeros(0, np.uint64)
        if len(start):
            h[where] = wh
            k[where], member[where] = self.classes(data, start, end, wh)
        one = np.concatenate(([_START], h[:-1])).astype(np.uint64)
        one[first] = _START
        two = np.concatenate(([_START], one[:-1])).astype(np.uint64)
        two[first] = _START
        features = np.stack((one, two * np.uint64(3) + np.uint64(7), one * np.uint64(5) + two * np.uint64(11)))
        return text, k, member, features, (doc, data, start, end, wh)

    def examples(self, k: np.ndarray, member: np.ndarray, features: np.ndarray, a: int) -> Iterator[tuple]:
        """Of the tokens from ``a`` on: (which factor, tokens, rows of features, what is to be drawn)."""
        k, member, features = k[a : a + MINIBATCH], member[a : a + MINIBATCH], features[:, a : a + MINIBATCH]
        yield 0, slice(a, a + len(k)), np.concatenate((self.row(features), np.zeros((1, len(k)), np.int64))), k
        own = np.flatnonzero(member >= 0)
        if len(own):
            salt = (k[own] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield 1, a + own, np.concatenate((self.row(features[:2, own] + salt), k[None, own])), member[own]


@np.errstate(over="ignore")
def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    total = np.exp(z).sum(axis=1, keepdims=True)
    if not (np.isfinite(total).all() and total.all()):  # rare: very large weights
        z -= z.max(axis=1, keepdims=True)
        total = np.exp(z).sum(axis=1, keepdims=True)
    z -= np.log(total)
    return z


def update(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, k: np.ndarray) -> None:
    """One adaptive gradient step on the tokens given, in place; ``squares`` has a number for each row."""
    g = log_softmax(weights, rows)
    np.exp(g, out=g)
    np.negative(g, out=g)
    g[np.arange(len(k)), k] += 1
    for flat in (rows[:-1].ravel(), rows[-1]):
        order = np.argsort(flat, kind="stable")
        sorted_, token = flat[order], order % len(k)
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        at, n = sorted_[first], np.diff(first, append=len(flat))
        s = g.take(token[first], axis=0)  # most features stand once in a batch
        several = np.flatnonzero(n > 1)
        if len(several):
            n = n[several]
            g_several = g.take(token[np.repeat(first[several] - np.cumsum(n) + n, n) + np.arange(n.sum())], axis=0)
            s[several] = np.add.reduceat(g_several, np.cumsum(n) - n, axis=0) if len(n) > 1 else g_several.sum(axis=0)
        squares[at] += np.einsum("ij,ij->i", s, s)
        s *= (STEP / np.sqrt(squares[at] + 1))[:, None]  # a feature seen once moves little
        weights[at] += s


def table_rows(n_words: int) -> int:
    """Rows of each table of weights for a vocabulary of so many words."""
    wanted = max(LEAST_ROWS, min(MOST_ROWS, n_words // WORDS_PER_ROW))
    return 1 << (wanted - 1).bit_length()


def first_weights(sums: dict, top: list[tuple], n_words: int) -> np.ndarray:
    """(factor, row, outcome): shares of classes, and of words in their classes; no features yet."""
    weights = np.zeros((2, table_rows(n_words), CLASSES), np.float32)
    total = sum(n for n, _ in sums.values())
    for k in range(CLASSES):
        weights[0, 0, k] = math.log((sums.get(k, (0, 0))[0] + 1) / (total + CLASSES))
    weights[1, :GROUPS] = -30  # where no word stands
    for rank, (_, c) in enumerate(top[:OWN]):
        k = rank % GROUPS
        weights[1, k, rank // GROUPS] = math.log(c / sums[k][0])
    return weights


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for texts in chunks(batch.column(0)):
            for t in texts:
                held.update(t.lower().split())
            if len(held) > COUNTED:
                yield give()
                held = Counter()
    yield give()


def _trainer(sent_weights, own: list[bytes], rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights = np.frombuffer(sent_weights.value, np.float32).reshape(2, rows, CLASSES).copy()
        squares = np.zeros(weights.shape[:2], np.float32)
        encoder = Encoder(own, rows)
        n = 0
        for batch in batches:
            for texts in chunks(batch.column(0)):
                _, k, member, features, _ = encoder.tokens(texts)
                n += len(k)
                for a in range(0, len(k), MINIBATCH):
                    for factor, _, its, drawn in encoder.examples(k, member, features, a):
                        update(weights[factor], squares[factor], its, drawn)
        if n:
            del squares
            flat = weights.reshape(-1, BLOCK_ROWS * CLASSES).astype(np.float16)
            task = TaskContext.get().partitionId()
            for b, x in enumerate(flat):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["task", "block", "weights", "n"])

    return run


def _mean(frame):
    import pandas as pd

    frame = frame.sort_values("task")  # the order of the sums is set
    total = np.zeros(BLOCK_ROWS * CLASSES)
    for w, n in zip(frame["weights"], frame["n"], strict=True):
        total += np.frombuffer(w, np.float16).astype(np.float64) * n
    mean = (total / frame["n"].sum()).astype(np.float16)
    return pd.DataFrame({"task": [frame["task"].iloc[0] // AVERAGED], "block": [frame["block"].iloc[0]], "weights": [mean.tobytes()], "n": [frame["n"].sum()]})


def _averaged(trained: DataFrame, tasks: int) -> DataFrame:
    """One row for each block; no task holds more than ``AVERAGED`` copies of one."""
    while True:
        trained = trained.groupBy("block", F.floor(F.col("task") / AVERAGED)).applyInPandas(_mean, "task int, block int, weights binary, n bigint")
        tasks = -(-tasks // AVERAGED)
        if tasks <= 1:
            return trained


def _classify(own: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(own, LEAST_ROWS)
        for batch in batches:
            k = encoder.of_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int32))], names=["word", "c", "class"])

    return run


def _score(columns: list[str], text_col: str, id_col: str, sent, own: list[bytes], rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, head, share, total, end = sent.value
        weights = np.frombuffer(weights, np.float16).reshape(2, rows, CLASSES).astype(np.float32)
        encoder = Encoder(own, rows)
        # Frequent words by hash: base, and what the softmaxes do not tell, the share in a class by ending.
        data, at = joined([w for w, _, _ in head], b" ")
        hashes = PrefixHash(data).of(at[:-1], at[1:] - 1) if head else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        values = np.array([(math.log10((c + 1) / total), math.log10((c + 1) / share[k]) if k > END else 0.0) for _, c, k in head]).reshape(-1, 2)[order]
        end_base = math.log10((end + 1) / total)
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            done = 0
            for texts in chunks(get[text_col]):
                size = len(texts)
                text, k, member, features, (doc, data, start, stop, h) = encoder.tokens(texts)
                lp = np.zeros(len(k))
                for a in range(0, len(k), MINIBATCH):
                    for factor, tokens, its, drawn in encoder.examples(k, member, features, a):
                        lp[tokens] += log_softmax(weights[factor], its)[np.arange(len(drawn)), drawn]
                score = np.bincount(text, lp, minlength=size) / math.log(10)
                at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                value, of = values[at[hit]] if len(hashes) else np.zeros((0, 2)), doc[hit]
                base = np.bincount(of, value[:, 0], minlength=size) + end_base
                score += np.bincount(of, value[:, 1], minlength=size)
                n_known = np.bincount(of, minlength=size) + int(end > 0)
                # Other words, once for each text, are joined to their counts.
                miss = np.flatnonzero(~hit)
                letters = data.tobytes()
                tail = Counter(zip(doc[miss].tolist(), (letters[a:b] for a, b in zip(start[miss].tolist(), stop[miss].tolist(), strict=True)), strict=True))
                flat = [w for _, w in tail]
                entry = pa.StructArray.from_arrays([pa.array(flat, pa.binary()), pa.array(tail.values(), pa.int64()), pa.array(encoder.of_words(flat).astype(np.int32))], names=["word", "n", "class"])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(np.array([d for d, _ in tail], np.int64), minlength=size)))).astype(np.int32)
                more = [pa.array(np.bincount(text, minlength=size)), pa.array(n_known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), entry)]
                kept = [get[c].slice(done, size) for c in (*columns, id_col)]
                done += size
                yield pa.RecordBatch.from_arrays([*kept, *more], names=[*columns, id_col, "n_tokens", "n_known", "base_score", "score", "tail"])

    return run


def lm_scores(docs: DataFrame, training: Column, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``n_tokens``, ``n_known``, ``train_tokens``
    (long), ``base_score`` and ``score`` (double, log10 of the probability of the whole text).

    ``training`` says which rows the model learns from; null counts as no.
    Defined cases: a null or empty text is the end token alone; texts of any length are scored whole;
    repeated rows train and score each time; without training rows all counts are 0 and the model is
    uniform over classes; an empty table gives no rows; columns named like the outputs are replaced.
    What goes to every task is bounded: ``HEAD`` words, and tables of ``MOST_ROWS`` rows at most.
    """
    spark = docs.sparkSession
    outs = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    (rid,) = fresh(docs, "rid")
    columns = [c for c in (docs.columns if keep is None else keep) if c not in outs]
    train = docs.where(F.coalesce(training, F.lit(False))).select(col(text_col).alias("text"))
    n_texts, n_bytes = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    vocab = written(train.mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    top = [(bytes(r[0]), r[1]) for r in vocab.orderBy(F.desc("c"), "word").limit(HEAD).collect()]
    own = [w for w, _ in top[:OWN]]
    classed = written(vocab.mapInArrow(_classify(own), "word binary, c bigint, class int"), "classed")
    discard(vocab)
    sums = {r[0]: (r[1], r[2]) for r in classed.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).collect()}
    if n_texts:
        sums[END] = (n_texts, 1)
    n_train, n_words = sum(a for a, _ in sums.values()), sum(b for _, b in sums.values())
    total = n_train + n_words + 1
    share = [sums.get(k, (0, 0))[0] + sums.get(k, (0, 0))[1] + 1 for k in range(CLASSES)]

    weights = first_weights(sums, top, n_words)
    rows = weights.shape[1]
    for r in range(ROUNDS if n_texts else 0):
        tasks = max(1, n_bytes // ROUNDS // TRAIN_BYTES)
        part = train.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r).coalesce(tasks)
        sent = spark.sparkContext.broadcast(weights.tobytes())
        trained = part.mapInArrow(_trainer(sent, own, rows), "task int, block int, weights binary, n bigint")
        for x in _averaged(trained, tasks).select("block", "weights").collect():
            weights.reshape(-1, BLOCK_ROWS * CLASSES)[x[0]] = np.frombuffer(x[1], np.float16)
        sent.destroy()

    of_head = Encoder(own, rows).of_words([w for w, _ in top]).tolist()
    head = [(w, c, k) for (w, c), k in zip(top, of_head, strict=True)]
    sent = spark.sparkContext.broadcast((weights.astype(np.float16).tobytes(), head, share, total, n_texts))
    entry = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("class", T.IntegerType())]))
    fields = [docs.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField(rid, T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("tail", entry)])
    scored = written(docs.withColumn(rid, F.monotonically_increasing_id()).mapInArrow(_score(columns, text_col, rid, sent, own, rows), schema), "scored")
    sent.destroy()

    # Words that are not in the head: their counts come by a join on the word.
    tail = scored.select(F.col(rid).alias("r"), F.explode("tail").alias("t")).select("r", "t.word", "t.n", "t.class")
    shares = F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.col("class") + 1)
    rare = classed.select("word", "c")
    count = F.coalesce(F.col("c"), F.lit(0))
    sums_of = (
        tail.join(rare, "word", "left")
        .groupBy("r")
        .agg(
            F.sum(F.col("n") * F.log10((count + 1) / F.lit(float(total)))).alias("b"),
            F.sum(F.col("n") * F.log10((count + 1) / shares)).alias("s"),
            F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("k"),
        )
    )
    out = scored.drop("tail").join(sums_of, F.col(rid) == F.col("r"), "left")
    nil = F.lit(0)
    return out.select(
        *[col(c) for c in columns],
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", nil)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", nil)).alias("base_score"),
        (F.col("score") + F.coalesce("s", nil)).alias("score"),
    )
