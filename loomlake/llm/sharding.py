"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

Rows stand in source partitions (buckets of a whole-row hash). How many rows of each source
partition go to each shard is drawn from the multivariate hypergeometric law on the driver, over
counts only. Each source partition permutes its rows by a seeded hash and cuts the order at the
drawn counts; the cuts are a table of ``partitions x shards`` numbers, so that a row finds its shard
without moving. One exchange then brings the rows to their shards, where a second seeded order gives
the slots.

Only that exchange moves whole rows. Results depend on the rows and the seed alone, so that a task
that runs again after an executor is lost gives the same rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import col, fresh, inline_table, row_hash

#: Source partitions; the matrix on the driver has so many rows.
SOURCE_PARTITIONS = 1024
#: Rows that one task orders when slots are given.
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 64


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula, without the loss of digits that large logarithms bring."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where the two are near each other."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    out, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = out + term / (2 * k + 1)
        if more == out:
            return out
        out, k = more, k + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability of x out of n, exact to a few units in the last place at any n."""
    if x == 0:
        return n * math.log(q)
    if x == n:
        return n * math.log(p)
    out = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return out - 0.5 * (math.log(2 * math.pi * x) + math.log1p(-x / n))


def log_mass(k: int, good: int, bad: int, draws: int) -> float:
    """log of the hypergeometric probability that k of the draws are good."""
    p, q = draws / (good + bad), (good + bad - draws) / (good + bad)
    return _log_binomial(k, good, p, q) + _log_binomial(draws - k, bad, p, q) - _log_binomial(draws, good + bad, p, q)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items drawn without replacement are good, for any size.

    Inversion from the mode outwards: the steps are about the standard deviation. Where rounding has
    eaten the mass that the number drawn points to, it is drawn again.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    start = math.exp(log_mass(mode, good, bad, draws))
    while True:
        left = rng.random() - start
        if left < 0:
            return mode
        down = up = start
        a = b = mode
        while (b < high and up > 0) or (a > low and down > 0):
            if b < high and up > 0:
                up *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
                b += 1
                left -= up
                if left < 0:
                    return b
            if a > low and down > 0:
                down *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
                a -= 1
                left -= down
                if left < 0:
                    return a


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: source partitions, columns: shards; row sums are ``sizes``, column sums ``shard_sizes``."""
    rng = random.Random(seed)
    room = list(shard_sizes)
    matrix = []
    for size in sizes:
        row, left, rest = [], size, sum(room)
        for j, free in enumerate(room):
            rest -= free
            take = hypergeometric(rng, free, rest, left)
            row.append(take)
            left -= take
        room = [free - take for free, take in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_rows(docs: DataFrame, shards: int, seed: int = 17, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    Shard sizes differ by one row at most; each arrangement is as likely as any other over seeds.
    Defined cases: nulls in any column hash like any other value; an empty table gives no rows; empty
    and very long texts are rows like any other; equal rows (ties) share a hash, and where a cut
    falls between them they are told apart by a row number. Columns named like the outputs are
    replaced; all other columns stay.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    docs = docs.drop(shard_col, slot_col)
    p, h, g, n, cuts, b, base, rn = fresh(docs, "part", "order", "second", "n", "cuts", "bucket", "base", "rn")
    keyed = docs.withColumns({
        p: F.pmod(row_hash(docs, seed), F.lit(SOURCE_PARTITIONS)).cast("int"),
        h: row_hash(docs, seed + 1),
        g: row_hash(docs, seed + 2),
    })

    # Exact counts: one row for each source partition comes to the driver.
    counts = sorted((r[0], r[1]) for r in keyed.groupBy(p).agg(F.count(F.lit(1))).collect())
    total = sum(c for _, c in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([c for _, c in counts], sizes, seed)
    ends = []
    for (part, _), row in zip(counts, matrix, strict=True):
        run = 0
        at = []
        for take in row[:-1]:
            run += take
            at.append(run)
        ends.append((part, at))

    # The local permutation, over hashes only: which hash stands at each cut.
    cut_at = inline_table(spark, [(part, at) for part, at in ends], f"{p} int, {cuts} array<bigint>")
    local = Window.partitionBy(p).orderBy(h)
    at_cuts = (
        keyed.select(p, h)
        .withColumns({rn: F.row_number().over(local), n: F.lead(h).over(local)})
        .join(F.broadcast(cut_at), p)
        .where(F.array_contains(cuts, F.col(rn).cast("long")))
        .select(p, rn, h, (F.col(h) == F.col(n)).alias("torn"))
        .collect()
    )
    hash_at = {(r[0], r[1]): r[2] for r in at_cuts}
    torn = sorted({(r[0], r[2]) for r in at_cuts if r[3]})
    limits = [(part, [hash_at.get((part, k)) for k in at]) for part, at in ends]
    table = inline_table(spark, limits, f"{p} int, {cuts} array<bigint>")
    placed = keyed.join(F.broadcast(table), p)
    by_hash = F.size(F.filter(F.col(cuts), lambda t: F.coalesce(F.col(h) > t, F.lit(True)))).cast("int")
    if torn:
        # Equal rows on both sides of a cut: number them, and compare places instead of hashes.
        both = inline_table(spark, torn, f"{p} int, {h} bigint")
        apart = placed.join(F.broadcast(both), [p, h], "left_semi")
        rest = placed.join(F.broadcast(both), [p, h], "left_anti")
        before = keyed.select(p, h).join(F.broadcast(both.withColumnRenamed(h, n)), p).where(F.col(h) < F.col(n)).groupBy(p, n).agg(F.count(F.lit(1)).alias(base)).withColumnRenamed(n, h)
        numbered = apart.join(F.broadcast(before), [p, h], "left").withColumn(rn, F.coalesce(base, F.lit(0)) + F.row_number().over(Window.partitionBy(p, h).orderBy(g))).drop(base)
        ranks = inline_table(spark, [(part, at) for part, at in ends], f"{p} int, {base} array<bigint>")
        numbered = numbered.join(F.broadcast(ranks), p).withColumn(shard_col, F.size(F.filter(F.col(base), lambda k: F.col(rn) > k)).cast("int"))
        placed = rest.withColumn(shard_col, by_hash).drop(cuts).unionByName(numbered.drop(cuts, base, rn))
    else:
        placed = placed.withColumn(shard_col, by_hash).drop(cuts)

    # The exchange, and the second permutation.
    buckets = max(LEAST_BUCKETS, math.ceil(total / shards / ROWS_PER_BUCKET))
    placed = placed.withColumn(b, F.pmod(F.col(g), F.lit(buckets)).cast("int"))
    held = placed.groupBy(shard_col, b).agg(F.count(F.lit(1)).alias(n))
    offsets = held.select(shard_col, b, (F.sum(n).over(Window.partitionBy(shard_col).orderBy(b)) - F.col(n)).alias(base))
    order = Window.partitionBy(shard_col, b).orderBy(g, h)
    moved = placed.join(offsets, [shard_col, b])
    return moved.withColumn(slot_col, (F.col(base) + F.row_number().over(order) - 1).cast("long")).select(*[col(c) for c in docs.columns], shard_col, slot_col)


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder for each shard, rows in slot order within the files."""
    per_file = F.floor(F.col(slot_col) / F.lit(ROWS_PER_BUCKET))
    sharded.repartition(F.col(shard_col), per_file).sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
