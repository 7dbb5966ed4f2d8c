"""Blocks of a streamed reply, from its chunks; metering claims; model selections; frames and timers.

Chunks: (stream, seq, type, index, block_type, text, call_id, name, final), one row each. All is keyed by
stream, so the same functions serve a batch and, within foreachBatch, a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assembled(chunks: DataFrame) -> DataFrame:
    """(stream, index, pos, type, text, closed): one block for each index, in the order of first sight.

    The first close wins: its block replaces what had come, and later deltas and closes are ignored.
    """
    parts = chunks.where("index is not null")
    delta = F.col("type").endswith("delta")
    per = Window.partitionBy("stream", "index")
    rows = parts.withColumns({"end": F.min(F.when(F.col("type") == "block-end", F.col("seq"))).over(per), "pos": F.min("seq").over(per)})
    used = rows.where((F.col("end").isNull()) | (F.col("seq") <= F.col("end")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(delta, F.struct("seq", "text")))), lambda x: x["text"]), "")
    kind = F.coalesce(F.max(F.when(F.col("type") == "block-end", F.col("block_type"))), F.min_by("block_type", "seq"))
    out = used.groupBy("stream", "index", "pos").agg(kind.alias("type"), F.coalesce(F.max(F.when(F.col("type") == "block-end", F.col("final"))), text).alias("text"), F.max(F.col("type") == "block-end").alias("closed"))
    return out.select("stream", "index", "pos", "type", "text", "closed")


def interrupted(blocks: DataFrame) -> DataFrame:
    """What a broken stream may keep: text and reasoning that is not blank; never a call."""
    return blocks.where(F.col("type").isin("text", "reasoning") & (F.regexp_replace("text", r"(?U)[\s\x{FEFF}]+", "") != ""))


def finished(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The blocks of a whole stream; one that ended at its token limit loses its calls."""
    last = chunks.where("type = 'finish'").groupBy("stream").agg(F.max_by("text", "seq").alias("finish"))
    return blocks.join(last, "stream", "left").where((F.coalesce("finish", F.lit("")) != "max-tokens") | (F.col("type") != "tool-call")).drop("finish")


def shadow_prices(events: DataFrame) -> DataFrame:
    """(session_id, seq, delta, error): what each surface event adds to a token total.

    A metering event (type meter, with start, end, tokens) prices the replacement next to it on the
    surface; one over another range is an error, a replacement without one adds nothing.
    """
    surface = events.where("type = 'meter' or op is not null")
    order = Window.partitionBy("session_id").orderBy("seq")
    lag = lambda c: F.lag(c).over(order)
    rows = surface.withColumns({"_type": lag("type"), "_start": lag("start"), "_end": lag("end"), "_tokens": lag("tokens")}).where("op is not null")
    claimed = F.coalesce(F.col("_type") == "meter", F.lit(False))
    fits = (F.col("_start") == F.col("start")) & (F.col("_end") == F.col("end"))
    replace = F.col("op") == "replace"
    delta = F.when(~replace, F.col("tokens")).when(claimed & fits, F.col("tokens") - F.col("_tokens")).when(~claimed, F.lit(0))
    return rows.select("session_id", "seq", delta.cast("long").alias("delta"), (replace & claimed & ~fits).alias("error"))


def model_selection(events: DataFrame) -> DataFrame:
    """(session_id, pending, last_used): a selection is pending until a request uses the same one."""
    kind, at = F.col("type"), F.col("seq")
    pick = F.max_by("model", F.when(kind == "model/selection", at))
    rows = events.groupBy("session_id").agg(pick.alias("picked"), F.max(F.when(kind == "model/selection", at)).alias("at"), F.max_by("model", F.when(kind == "request/header", at)).alias("last_used"))
    used = events.where("type = 'request/header'").select("session_id", F.col("seq").alias("used_at"), F.col("model").alias("used"))
    cleared = rows.join(used, "session_id").where("used_at > at and used = picked").select("session_id").distinct().withColumn("cleared", F.lit(True))
    return rows.join(cleared, "session_id", "left").select("session_id", F.when(F.col("cleared").isNull(), F.col("picked")).alias("pending"), "last_used")


def coalesced(frames: DataFrame, most: int) -> DataFrame:
    """(stream, frame, text, n): bursts of outputs merged into frames, cut where the running bytes pass a bound."""
    order = Window.partitionBy("stream").orderBy("seq")
    size = F.octet_length("text").cast("long")
    frame = F.floor((F.sum(size).over(order) - size) / F.lit(most)).cast("long")
    rows = frames.withColumn("frame", frame)
    return rows.groupBy("stream", "frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"), F.count(F.lit(1)).alias("n"))


def chunked(values: DataFrame, size: int = 64) -> DataFrame:
    """(list_id, chunk, items): an append-only list in chunks of a fixed size; a full chunk never changes."""
    rows = values.withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))
    return rows.groupBy("list_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))


def driven(tasks: DataFrame, now: Column) -> DataFrame:
    """(task_id, delivered, scheduled_at, status): tasks after one ring of the timer.

    A due recurring task is delivered once and skips to its first occurrence after now; a due task
    without an interval is completed.
    """
    is_due = (F.col("status") == "active") & (F.col("scheduled_at") <= now)
    later = F.col("scheduled_at") + (F.floor((now - F.col("scheduled_at")) / F.col("every")) + 1) * F.col("every")
    at = F.when(is_due & F.col("every").isNotNull(), later).otherwise(F.col("scheduled_at"))
    status = F.when(is_due & F.col("every").isNull(), "completed").otherwise(F.col("status"))
    return tasks.select("task_id", is_due.alias("delivered"), at.cast("long").alias("scheduled_at"), status.alias("status"))


def delivered(events: DataFrame, ids: list[str] | None = None, late: str | None = None, time: str = "time") -> DataFrame:
    """Deliveries as they come: ids are exposed, never deduplicated, unless a caller names them and a lateness."""
    if ids is None:
        return events
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(ids) if late else events.dropDuplicates(ids)
