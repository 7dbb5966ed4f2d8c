"""Mixing overlapping sources to target weights, by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. The flow runs on the driver, over
patterns and sources only: pattern ``p`` offers its words once at cost 0, once more at cost 1, and so
on (convex costs of repetition); each source takes up to its quota. What a pattern must give becomes
whole repetitions of all its documents and one share of them, which a seeded order selects.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import col, fresh, row_hash

#: Buckets of the seeded order; the driver holds their sums for each pattern.
ORDER_BITS = 12


def share_out(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Targets by weight that sum to ``total``; none above ``most`` times its size, the excess is reshared."""
    target = {s: 0.0 for s in sizes}
    open_ = [s for s in sizes if sizes[s] > 0]
    left = float(total)
    while open_ and left > 0:
        weight = sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * left > most * sizes[s] * weight]
        if not full:
            for s in open_:
                target[s] = weights[s] * left / weight
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


class _Network:
    """Successive shortest paths; small graphs only."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.arcs: list[list[int]] = []  # to, room, cost; the reverse arc is the neighbour by parity

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, room, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, start: int, end: int) -> None:
        while True:
            dist: dict[int, int] = {start: 0}
            via: dict[int, int] = {}
            queue, waiting = deque([start]), {start}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for k in self.out[a]:
                    b, room, cost = self.arcs[k]
                    if room > 0 and dist[a] + cost < dist.get(b, 1 << 60):
                        dist[b], via[b] = dist[a] + cost, k
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if end not in via:
                return
            path, b = [], end
            while b != start:
                path.append(via[b])
                b = self.arcs[via[b] ^ 1][0]
            amount = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount


def route(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, dict]:
    """Words that each pattern (a tuple of sources) gives to each of its sources."""
    names, sources = list(patterns), list(quotas)
    place = {s: 1 + len(names) + j for j, s in enumerate(sources)}
    end = 1 + len(names) + len(sources)
    net = _Network(end + 1)
    gives: dict[tuple, list] = {}
    for i, pattern in enumerate(names):
        for k in range(repeats):
            net.add(0, 1 + i, patterns[pattern], k)
        gives[pattern] = [(s, net.add(1 + i, place[s], patterns[pattern] * repeats, 0)) for s in dict.fromkeys(pattern) if s in place]
    for s in sources:
        net.add(place[s], end, int(round(quotas[s])), 0)
    net.run(0, end)
    return {p: {s: net.arcs[k ^ 1][1] for s, k in arcs} for p, arcs in gives.items()}


def mix_sources(docs: DataFrame, member: Column, size: Column, quotas_of, repeats: int = 2, seed: int = 23, copies_col: str = "copies", taken_col: str = "taken") -> tuple[DataFrame, dict]:
    """``docs`` with ``copies`` (int, at most ``repeats``) and ``taken`` (long, copies times size), and the flow.

    ``member``: array of the sources of a row, null elements allowed (a null source is a source).
    ``size``: words of a row. ``quotas_of`` gets {pattern: words} and returns {source: words}.
    Defined cases: a null or empty array gives the pattern of no source, from which nothing is taken;
    rows of size 0 have one copy and take nothing; an empty table gives no rows; rows that are equal
    in all columns (ties) are taken or left together; texts count whole; other columns stay, and those
    named like the outputs are replaced. Reruns agree, as the order depends on rows and seed alone.
    No whole row moves between tasks; the driver sees sums by pattern and bucket of the order.
    """
    docs = docs.drop(copies_col, taken_col)
    m, n, h, b, run = fresh(docs, "member", "size", "order", "bucket", "run")
    keyed = docs.withColumns({m: F.coalesce(member, F.array().cast("array<string>")), n: size.cast("long"), h: row_hash(docs, seed)}).withColumn(b, F.shiftrightunsigned(h, 64 - ORDER_BITS).cast("int"))
    sums = keyed.groupBy(m, b).agg(F.sum(n).alias(n)).collect()
    totals: dict[tuple, int] = {}
    by_bucket: dict[tuple, dict[int, int]] = {}
    for pattern, bucket, words in sums:
        pattern = tuple(pattern)
        totals[pattern] = totals.get(pattern, 0) + words
        by_bucket.setdefault(pattern, {})[bucket] = words
    flow = route(totals, quotas_of(totals), repeats)

    # For each pattern: whole repetitions, and how far the seeded order goes for one more.
    full: dict[tuple, int] = {}
    edge: dict[tuple, tuple[int, int]] = {}
    for pattern, words in totals.items():
        want = sum(flow[pattern].values())
        full[pattern], rest = divmod(want, words) if words else (0, 0)
        for bucket in sorted(by_bucket[pattern]) if rest else ():  # unsigned order of the hash
            if rest <= by_bucket[pattern][bucket]:
                edge[pattern] = (bucket, rest)
                break
            rest -= by_bucket[pattern][bucket]

    def same(pattern: tuple) -> Column:
        return F.col(m) == F.array(*[F.lit(s).cast("string") for s in pattern]).cast("array<string>")

    def choose(values: dict[tuple, Column], other: Column) -> Column:
        out = None
        for pattern, value in values.items():
            # A comparison of arrays takes null elements as equal.
            out = F.when(same(pattern), value) if out is None else out.when(same(pattern), value)
        return other if out is None else out.otherwise(other)

    cut: dict[tuple, int] = {}
    if edge:
        at = keyed.select(m, n, h, b).where(F.col(b) == choose({p: F.lit(e[0]) for p, e in edge.items()}, F.lit(-1)))
        order = Window.partitionBy(m).orderBy(h)
        tied = at.groupBy(m, h).agg(F.sum(n).alias(n))
        reach = tied.withColumn(run, F.sum(n).over(order)).where(F.col(run) - F.col(n) / 2 <= choose({p: F.lit(e[1]) for p, e in edge.items()}, F.lit(-1)))
        cut = {tuple(r[0]): r[1] for r in reach.groupBy(m).agg(F.max(h)).collect()}
    # Within one bucket the signed order is the unsigned one, as all share their top bits.
    once_more = {p: (F.col(b) < e[0]) | ((F.col(b) == e[0]) & (F.col(h) <= cut[p])) if p in cut else F.col(b) < e[0] for p, e in edge.items()}
    copies = choose({p: F.lit(k) for p, k in full.items()}, F.lit(0)) + choose(once_more, F.lit(False)).cast("int")
    copies = F.when((F.col(n) == 0) & (F.size(m) > 0), F.lit(1)).otherwise(F.least(copies, F.lit(repeats))).cast("int")
    out = keyed.withColumn(copies_col, copies).withColumn(taken_col, (F.col(copies_col) * F.col(n)).cast("long"))
    return out.select(*[col(c) for c in docs.columns], copies_col, taken_col), flow


def repeated(mixed: DataFrame, copies_col: str = "copies", taken_col: str = "taken") -> DataFrame:
    """The mixture itself: each row as often as ``copies`` says."""
    (k,) = fresh(mixed, "copy")
    rows = mixed.where(F.col(copies_col) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies_col))))
    return rows.drop(k, copies_col, taken_col)
