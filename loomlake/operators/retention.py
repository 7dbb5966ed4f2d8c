"""What is kept of chunks, contents and histories within bounds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_MS = 86_400_000


def byte_tail(chunks: DataFrame, cap: int) -> DataFrame:
    """(stream, at, text, gap): the newest chunks of each stream whose bytes fit the cap.

    ``at`` is the byte offset of a chunk in its stream. Where the newest chunk alone is too large, only its
    tail of whole characters stays, after a gap.
    """
    order = Window.partitionBy("stream").orderBy("pos")
    sized = chunks.where("text <> ''").withColumn("bytes", F.octet_length("text").cast("long"))
    sized = sized.withColumns({"at": F.sum("bytes").over(order) - F.col("bytes"), "from_end": F.sum("bytes").over(Window.partitionBy("stream").orderBy(F.desc("pos"))), "nth": F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("pos")))})
    kept = sized.where((F.col("from_end") <= cap) | (F.col("nth") == 1))
    places = F.sequence(F.lit(cap // 4), F.lit(cap))
    n = F.aggregate(F.transform(places, lambda k: F.struct(k.alias("k"), (F.octet_length(F.right("text", k)) <= cap).alias("fits"))), F.lit(0), lambda a, x: F.when(x["fits"], F.greatest(a, x["k"])).otherwise(a))
    cut = F.col("bytes") > cap
    text = F.when(cut, F.right("text", n)).otherwise(F.col("text"))
    return kept.select("stream", "pos", (F.col("at") + F.col("bytes") - F.octet_length(text)).alias("at"), text.alias("text"), cut.alias("gap"))


def read_from(kept: DataFrame, totals: DataFrame, start: int) -> DataFrame:
    """(stream, chunks, next, lossy): retained chunks that end behind ``start``, where to go on, whether any before are gone."""
    parts = kept.withColumn("end", F.col("at") + F.octet_length("text")).groupBy("stream").agg(F.min("at").alias("earliest"), F.transform(F.array_sort(F.collect_list(F.when(F.col("end") > start, F.struct("at", "text")))), lambda x: x["text"]).alias("chunks"))
    return totals.join(parts, "stream", "left").select("stream", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"), F.col("total").alias("next"), (F.lit(start) < F.coalesce("earliest", "total")).alias("lossy"))


def history(deliveries: DataFrame, days: int, records: int) -> DataFrame:
    """(task_id, message_id, delivered_at, nth, pruned): what stays after the newest receipt of each task.

    Records of the last days before that receipt, and of these the last ``records`` in order of appending;
    ``pruned`` tells whether any record of the task has gone.
    """
    newest = Window.partitionBy("task_id").orderBy(F.desc("pos"))
    whole = Window.partitionBy("task_id")
    rows = deliveries.withColumn("floor", F.first("delivered_at").over(newest) - days * DAY_MS)
    rows = rows.withColumns({"all": F.count(F.lit(1)).over(whole), "in_time": F.col("delivered_at") >= F.col("floor")})
    rows = rows.where("in_time").withColumns({"nth": F.row_number().over(newest), "left": F.count(F.lit(1)).over(whole)})
    return rows.where(F.col("nth") <= records).select("task_id", "message_id", "delivered_at", "nth", ((F.col("left") < F.col("all")) | (F.col("left") > records)).alias("pruned"))


def oldest(rows: DataFrame, group: list[str], order: list[str], n: int, taken: Column) -> DataFrame:
    """The first n rows of each group that are not taken yet."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.where(~taken).withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def _fit(text: str, budget: int, tail: bool, per_block: int) -> str:
    """The longest end of a text within a budget of a quarter token for each character and a constant."""
    n = max(0, min(len(text), 4 * (budget - per_block))) if budget > per_block else 0
    return (text[len(text) - n :] if tail else text[:n]) if n else ""


def retain(content: list[tuple[str, str]], budget: int, image: int = 1000, per_block: int = 4) -> tuple[list, list, int, int]:
    """(head, tail, omitted bytes, omitted images) of (type, text) blocks: each end gets half of the budget.

    Images are whole or not at all, and room that one leaves stays empty.
    """
    price = lambda b: image if b[0] == "image" else math.ceil(len(b[1]) / 4) + per_block
    rest = list(content)
    ends: list[list] = []
    for tail, room in ((False, -(-budget // 2)), (True, budget // 2)):
        kept: list = []
        while rest:
            at = -1 if tail else 0
            block = rest[at]
            if price(block) <= room:
                room -= price(block)
                kept.append(rest.pop(at))
                continue
            if block[0] == "text" and (part := _fit(block[1], room, tail, per_block)):
                kept.append(("text", part))
                rest[at] = ("text", block[1][: len(block[1]) - len(part)] if tail else block[1][len(part) :])
            break
        ends.append(kept[::-1] if tail else kept)
    size = sum(len(t.encode()) for k, t in rest if k == "text")
    return ends[0], ends[1], size, sum(k == "image" for k, _ in rest)


def head_and_tail(messages: DataFrame, budget: int, image: int = 1000) -> DataFrame:
    """(message_id, head, tail, omitted_bytes, omitted_images) of messages with ``content`` (array of type, text)."""
    kind = dict(messages.dtypes)["message_id"]

    def run(frames):
        for frame in frames:
            out = [(m, *retain([(b["type"], b["text"] or "") for b in c], budget, image)) for m, c in zip(frame["message_id"], frame["content"], strict=True)]
            yield pd.DataFrame([(m, [t for _, t in a], [t for _, t in b], n, i) for m, a, b, n, i in out], columns=["message_id", "head", "tail", "omitted_bytes", "omitted_images"])

    return messages.select("message_id", "content").mapInPandas(run, f"message_id {kind}, head array<string>, tail array<string>, omitted_bytes bigint, omitted_images bigint")


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """Active tasks that are scheduled by now."""
    return tasks.where((F.col("status") == "active") & (F.col("scheduled_at") <= now))


def deliveries(tasks: DataFrame, now: Column) -> DataFrame:
    """(session_id, tasks): the due tasks of each session together, in their order."""
    return due(tasks, now).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("scheduled_at", "task_id"))), lambda x: x["task_id"]).alias("tasks"))


def next_due(tasks: DataFrame) -> DataFrame:
    """When the one timer must ring next: the earliest of active tasks that have not failed."""
    return tasks.where((F.col("status") == "active") & ~F.coalesce("failed", F.lit(False))).agg(F.min("scheduled_at").alias("next_due"))
