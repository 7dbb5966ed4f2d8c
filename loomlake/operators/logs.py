"""Event logs of sessions: (session_id, seq, type, time, turn, step, call_id, ...), seq dense from 0.

All windows are keyed by session. The surface fold is the one step that needs an ordered pass over a
session's events; it runs per session over Arrow batches of (seq, op, start, end) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlake.sources.folders import stored


def _session():
    return Window.partitionBy("session_id").orderBy("seq")



def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    """Classes of one session's events, by replaying its surface."""
    frame = frame.sort_values("seq")
    surface: list[int] = []
    kind = {int(s): "log-only" for s in frame["seq"]}
    by: dict[int, int] = {}
    delta: dict[int, int] = {}
    tokens = dict(zip(frame["seq"].astype(int), frame["tokens"].astype(int), strict=True))
    error = None
    for seq, op, start, end in zip(frame["seq"], frame["op"], frame["start"], frame["end"], strict=True):
        seq = int(seq)
        if op is None or pd.isna(op):
            continue
        gone: list[int] = []
        if op == "append":
            surface.append(seq)
        else:
            place = {s: k for k, s in enumerate(surface)}
            a, b = place.get(start), place.get(end)
            if a is None or b is None or a > b:
                error = f"replace at seq {seq} has an invalid range"
                break
            gone = surface[a : b + 1]
            surface[a : b + 1] = [seq]
        kind[seq] = "current"
        for s in gone:
            kind[s], by[s] = "shadowed", seq
        delta[seq] = tokens[seq] - sum(tokens[s] for s in gone)
    position = {s: k for k, s in enumerate(surface)}
    seqs = [int(s) for s in frame["seq"]]
    return pd.DataFrame({
        "session_id": frame["session_id"].to_numpy(),
        "seq": seqs,
        "surface": [kind[s] for s in seqs],
        "replaced_by": pd.array([by.get(s) for s in seqs], dtype="Int64"),
        "position": pd.array([position.get(s) if kind[s] == "current" else None for s in seqs], dtype="Int64"),
        "delta": pd.array([delta.get(s) for s in seqs], dtype="Int64"),
        "error": [error] * len(seqs),
    })


def surface(events: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(session_id, seq, surface, replaced_by, position, delta, error) of every event.

    ``op`` is append, replace (of the nodes from ``start`` to ``end``, both on the surface) or null.
    ``position`` orders the current events as the model sees them; ``delta`` is what an event adds to the
    tokens of the surface. A range that is not on the surface is log corruption: the session's ``error``.
    """
    cut = events.select("session_id", F.col("seq").cast("long").alias("seq"), "op", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), (tokens if tokens is not None else F.lit(0)).cast("long").alias("tokens"))
    kind = dict(events.dtypes)["session_id"]
    return cut.groupBy("session_id").applyInPandas(_fold, f"session_id {kind}, seq bigint, surface string, replaced_by bigint, position bigint, delta bigint, error string")


def replaced(folded: DataFrame) -> DataFrame:
    """(session_id, seq, replaced): the events that each replacement took off the surface."""
    return folded.where("replaced_by is not null").groupBy("session_id", F.col("replaced_by").alias("seq")).agg(F.array_sort(F.collect_list(folded["seq"])).alias("replaced"))


def replacement_chain(folded: DataFrame) -> DataFrame:
    """(session_id, seq, chain): all later replacements of each replaced event, next one first.

    Joins double the known length each time, so that a chain takes a logarithmic number of them.
    """
    step = stored(folded.where("replaced_by is not null").select("session_id", "seq", F.array("replaced_by").alias("chain")), "chains")
    while True:
        ahead = step.select("session_id", F.col("seq").alias("last"), F.col("chain").alias("more"))
        longer = step.withColumn("last", F.element_at("chain", -1)).join(ahead, ["session_id", "last"], "left")
        grown = longer.where("more is not null").limit(1).count()
        if grown:
            step = stored(longer.select("session_id", "seq", F.when(F.col("more").isNotNull(), F.concat("chain", "more")).otherwise(F.col("chain")).alias("chain")), "chains")
        else:
            return step


def records(events: DataFrame, folded: DataFrame) -> DataFrame:
    """One light row for each event with its surface class; log-only where the fold says nothing."""
    return events.join(folded.select("session_id", "seq", "surface"), ["session_id", "seq"], "left").select("session_id", "seq", "type", "time", F.coalesce("surface", F.lit("log-only")).alias("surface"))


def search_documents(events: DataFrame, folded: DataFrame, text: Column) -> DataFrame:
    """Records with their text; events without text are left out."""
    with_text = events.withColumn("text", text).where(F.length("text") > 0)
    return records(with_text, folded).join(with_text.select("session_id", "seq", "text"), ["session_id", "seq"])


def surface_composition(events: DataFrame, folded: DataFrame, tokens: Column) -> DataFrame:
    """Tokens of the current surface: the last system message, the last tools, and all messages."""
    now = events.withColumn("tokens", tokens).join(folded.where("surface = 'current'").select("session_id", "seq", "position"), ["session_id", "seq"])
    last = lambda role: F.coalesce(F.max_by(F.when(F.col("role") == role, F.col("tokens")), F.when(F.col("role") == role, F.col("position"))), F.lit(0)).cast("long")
    rest = F.coalesce(F.sum(F.when(~F.col("role").isin("system", "tools"), F.col("tokens"))), F.lit(0)).cast("long")
    return now.groupBy("session_id").agg(last("system").alias("system"), last("tools").alias("tools"), rest.alias("messages"))


def call_delta(kind: Column, calls: Column) -> Column:
    """What an event adds to the open calls: the calls of a message, less one for a result."""
    return F.when(kind == "assistant/message", F.coalesce(calls, F.lit(0))).when(kind == "tool/result", -1).otherwise(0).cast("long")


def running_balance(events: DataFrame, delta: Column, position: str = "seq") -> DataFrame:
    """(…, balance, corrupt, cut): open calls after each event; negative is corruption, zero a place to cut."""
    order = Window.partitionBy("session_id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("balance", F.sum(delta).over(order))
    return out.withColumns({"corrupt": F.col("balance") < 0, "cut": F.col("balance") == 0})


def _scoped(events: DataFrame) -> DataFrame:
    """Events with the place of the last boundary before them: turn/start, and any that clears calls."""
    upto = _session().rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("type")
    return events.withColumns({
        "scope": F.coalesce(F.sum(F.when(kind.isin("turn/start", "turn/end", "step/end"), 1).otherwise(0)).over(upto), F.lit(0)),
        "boundary": F.last(F.when(kind.isin("turn/start", "turn/end"), kind), ignorenulls=True).over(upto),
        "open_turn": F.last(F.when(kind.isin("turn/start", "turn/end"), F.struct(F.when(kind == "turn/start", F.col("turn")).alias("v"))), ignorenulls=True).over(upto)["v"],
        "open_step": F.last(F.when(kind.isin("turn/start", "turn/end", "step/start", "step/end"), F.struct(F.when(kind == "step/start", F.col("step")).alias("v"))), ignorenulls=True).over(upto)["v"],
    })


def pending_calls(events: DataFrame) -> DataFrame:
    """(session_id, call_id, step, asked, call_seq): calls of the open tail that have no result.

    A message asks for ``calls`` (array of call ids); ``call_seq`` is where the call started, if it did.
    Boundaries of turns and ends of steps clear what is open; a result clears only what was asked before.
    """
    scoped = _scoped(events)
    tail = scoped.groupBy("session_id").agg(F.max("scope").alias("scope"))
    here = scoped.join(tail, ["session_id", "scope"], "left_semi")
    asked = here.where("type = 'assistant/message'").select("session_id", "step", F.col("seq").alias("asked"), F.explode("calls").alias("call_id"))
    asked = asked.groupBy("session_id", "call_id").agg(F.max_by("step", "asked").alias("step"), F.min("asked").alias("first"), F.max("asked").alias("asked"))
    later = here.where("type in ('tool/call', 'tool/result')").select("session_id", "call_id", "type", F.col("seq").alias("at"))
    both = asked.join(later, ["session_id", "call_id"], "left")
    done = F.max(F.when((F.col("type") == "tool/result") & (F.col("at") > F.col("asked")), 1).otherwise(0))
    started = F.max(F.when((F.col("type") == "tool/call") & (F.col("at") > F.col("asked")), F.col("at")))
    out = both.groupBy("session_id", "call_id", "step", "first", "asked").agg(done.alias("done"), started.alias("call_seq"))
    return out.where("done = 0").select("session_id", "call_id", "step", F.col("first").alias("asked"), "call_seq")


def closers(events: DataFrame, cause: str = "interrupted") -> DataFrame:
    """(session_id, seq, type, time, turn, step, call_id, error, reason): events that end an open tail.

    Results for its pending calls in the order in which they were asked, then the end of its step, then of
    its turn, numbered on from the last event and at its time. A log whose last turn has ended has none.
    """
    last = _scoped(events).withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).where("rn = 1")
    open_ = last.where("boundary = 'turn/start'").select("session_id", F.col("seq").alias("last"), "time", F.col("open_turn").alias("turn"), "open_step")
    none = F.lit(None)
    calls = pending_calls(events).join(open_, "session_id").select("session_id", "last", "time", "turn", "step", "call_id", F.when(F.col("call_seq").isNotNull(), "outcome_unknown").otherwise("not_started").alias("error"), F.lit("tool/result").alias("type"), F.lit(0).alias("rank"), "asked")
    steps = open_.where("open_step is not null").select("session_id", "last", "time", "turn", F.col("open_step").alias("step"), none.cast("string").alias("call_id"), none.cast("string").alias("error"), F.lit("step/end").alias("type"), F.lit(1).alias("rank"), none.cast("long").alias("asked"))
    turns = open_.select("session_id", "last", "time", "turn", none.cast("long").alias("step"), none.cast("string").alias("call_id"), none.cast("string").alias("error"), F.lit("turn/end").alias("type"), F.lit(2).alias("rank"), none.cast("long").alias("asked"))
    order = Window.partitionBy("session_id").orderBy("rank", "asked", "call_id")
    out = calls.unionByName(steps).unionByName(turns).withColumn("seq", (F.col("last") + F.row_number().over(order)).cast("long"))
    return out.select("session_id", "seq", "type", "time", "turn", "step", "call_id", "error", F.when(F.col("type") == "turn/end", cause).alias("reason"))


def cold_log(events: DataFrame) -> DataFrame:
    """(session_id, seq, type, time, turn, step, call_id, synthetic): the stored log and, at read only, its closers."""
    cols = ["session_id", "seq", "type", "time", "turn", "step", "call_id"]
    return events.select(*cols, F.lit(False).alias("synthetic")).unionByName(closers(events).select(*cols, F.lit(True).alias("synthetic")))


def fork_seed(events: DataFrame, boundary: Column) -> DataFrame:
    """The events through a boundary, one marker, and closers of what the boundary cut."""
    cols = ["session_id", "seq", "type", "time", "turn", "step", "call_id"]
    kept = events.where(F.col("seq") <= boundary)
    marker = kept.groupBy("session_id").agg((F.max("seq") + 1).alias("seq"), F.max_by("time", "seq").alias("time")).select("session_id", "seq", F.lit("session/end-seed").alias("type"), "time", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("step"), F.lit(None).cast("string").alias("call_id"))
    empty = F.array().cast("array<string>")
    seeded = kept.select(*cols, "calls").unionByName(marker.withColumn("calls", empty))
    return seeded.select(*cols).unionByName(closers(seeded, "forked").select(*cols))


def call_durations(events: DataFrame) -> DataFrame:
    """(session_id, turn, call_id, took): calls with their results in one turn; open ones are dropped."""
    key = ["session_id", "turn", "call_id"]
    calls = events.where("type = 'tool/call'").groupBy(*key).agg(F.min("time").alias("began"))
    results = events.where("type = 'tool/result'").groupBy(*key).agg(F.min("time").alias("ended"))
    return calls.join(results, key).select(*key, F.greatest(F.lit(0), F.col("ended") - F.col("began")).cast("long").alias("took"))


def session_statistics(events: DataFrame) -> DataFrame:
    """Turns, steps, time in tools, time to the first token and of decoding, and output tokens of each session.

    A reading with a missing boundary counts nowhere; negative times count as zero.
    """
    time_of = lambda kind: F.min(F.when(F.col("type") == kind, F.col("time")))
    steps = events.where("step is not null").groupBy("session_id", "turn", "step").agg(time_of("step/start").alias("began"), time_of("assistant/message").alias("first"), time_of("step/end").alias("ended"), F.max("output_tokens").alias("tokens"))
    steps = steps.withColumns({"ttft": F.greatest(F.lit(0), F.col("first") - F.col("began")), "decode": F.greatest(F.lit(0), F.col("ended") - F.col("first"))})
    steps = steps.withColumn("ttft", F.when(F.col("first").isNotNull() & F.col("began").isNotNull(), F.col("ttft"))).withColumn("decode", F.when(F.col("first").isNotNull() & F.col("ended").isNotNull(), F.col("decode")))
    long = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    by_step = steps.groupBy("session_id").agg(F.count("began").alias("steps"), long(F.col("ttft")).alias("ttft_ms"), F.count("ttft").alias("ttft_steps"), long(F.col("decode")).alias("decode_ms"), long(F.when(F.col("decode").isNotNull() & (F.col("tokens") >= 0), F.col("tokens"))).alias("decode_tokens"))
    turns = events.groupBy("session_id").agg(F.count_if(F.col("type") == "turn/start").alias("turns"))
    tools = call_durations(events).groupBy("session_id").agg(F.sum("took").alias("tool_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return turns.join(by_step, "session_id", "left").join(tools, "session_id", "left").select("session_id", "turns", *[zero(c) for c in ("steps", "tool_ms", "ttft_ms", "ttft_steps", "decode_ms", "decode_tokens")])


def derived_events(events: DataFrame) -> DataFrame:
    """(session_id, seq, derived): for each cited event, the later ones that cite it."""
    cited = events.select("session_id", F.col("seq").alias("by"), F.explode("sources").alias("seq")).where("by > seq")
    return cited.groupBy("session_id", "seq").agg(F.array_sort(F.collect_set("by")).alias("derived"))


def remap_references(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """``events`` with ``seq`` and ``sources`` through (session_id, seq, new); ``forward`` marks references that are not to earlier events, ``dangling`` those to none."""
    at = mapping.select("session_id", F.col("seq").alias("source"), F.col("new").alias("to"))
    parts = events.select("session_id", "seq", F.posexplode("sources").alias("k", "source")).join(at, ["session_id", "source"], "left")
    again = parts.groupBy("session_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda x: x["to"]).alias("mapped"), F.max(F.col("source") >= F.col("seq")).alias("forward"), F.max(F.col("to").isNull()).alias("dangling"))
    out = events.join(again, ["session_id", "seq"], "left").join(mapping.select("session_id", "seq", "new"), ["session_id", "seq"])
    return out.withColumns({"sources": F.coalesce("mapped", F.array().cast("array<bigint>")), "forward": F.coalesce("forward", F.lit(False)), "dangling": F.coalesce("dangling", F.lit(False))}).drop("mapped", "seq").withColumnRenamed("new", "seq")


def child_facts(events: DataFrame) -> DataFrame:
    """(session_id, descriptors, first): how many descriptor events a log has, and the data of the first."""
    return events.groupBy("session_id").agg(F.count_if(F.col("type") == "session/descriptor").alias("descriptors"), F.min_by("data", F.when(F.col("type") == "session/descriptor", F.col("seq"))).alias("first"))


def sequence_checks(events: DataFrame) -> DataFrame:
    """(session_id, dense, safe, rising): seq counts from 0 without gaps, times are safe integers, turns only rise."""
    rows = events.withColumns({"rn": F.row_number().over(_session()) - 1, "before": F.max(F.when(F.col("type") == "turn/start", F.col("turn"))).over(_session().rowsBetween(Window.unboundedPreceding, -1))})
    safe = F.col("time").isNotNull() & (F.abs("time") <= 2**53 - 1)
    rising = (F.col("type") != "turn/start") | F.col("before").isNull() | (F.col("turn") > F.col("before"))
    return rows.groupBy("session_id").agg(F.bool_and(F.col("rn") == F.col("seq")).alias("dense"), F.bool_and(safe).alias("safe"), F.bool_and(rising).alias("rising"))


def turn_outline(events: DataFrame, prompt: Column, response: Column) -> DataFrame:
    """(session_id, turn, seq, prompt, response): one row for each turn that advances the number.

    The prompt is the first non-empty preview of the user's messages after it; the response is the last
    non-empty preview of the assistant's that a later turn/end commits.
    """
    upto = _session().rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("type") == "turn/start"
    rows = events.withColumns({"prompt": prompt, "response": response, "before": F.max(F.when(starts, F.col("turn"))).over(_session().rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.withColumn("opens", starts & (F.col("before").isNull() | (F.col("turn") > F.col("before"))))
    rows = rows.withColumn("entry", F.last(F.when(F.col("opens"), F.col("seq")), ignorenulls=True).over(upto)).where("entry is not null")
    ends = Window.partitionBy("session_id", "entry").orderBy("seq")
    rows = rows.withColumn("ended", F.max(F.when(F.col("type") == "turn/end", F.col("seq"))).over(Window.partitionBy("session_id", "entry")))
    said = (F.col("type") == "assistant/message") & (F.col("response") != "") & (F.col("seq") < F.col("ended"))
    asked = (F.col("type") == "user/message") & (F.col("prompt") != "")
    del ends
    nil = F.lit("")
    return rows.groupBy("session_id", F.col("entry").alias("seq")).agg(F.max(F.when(F.col("opens"), F.col("turn"))).alias("turn"), F.coalesce(F.min_by("prompt", F.when(asked, F.col("seq"))), nil).alias("prompt"), F.coalesce(F.max_by("response", F.when(said, F.col("seq"))), nil).alias("response"))


def window_around(events: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """(session_id, target, seq, …): raw events around each target (session_id, seq), by bounds on the dense seq."""
    if not (0 <= before <= 50 and 0 <= after <= 50):
        raise ValueError("windows are of 50 events at most")
    places = targets.select("session_id", F.col("seq").alias("target"), F.explode(F.sequence(F.col("seq") - before, F.col("seq") + after)).alias("seq"))
    return events.join(places, ["session_id", "seq"])


def _tools(frame: pd.DataFrame) -> pd.DataFrame:
    baseline, declared, active = None, {}, set()
    rows = []
    for e in frame.sort_values("seq").itertuples():
        if e.type == "request/header":
            tools = dict(zip(e.names, e.definitions, strict=True))
            again = any(declared.get(n, d) != d for n, d in tools.items())
            if baseline is None or e.series or again:
                baseline, declared, active = int(e.seq), dict(tools), set(tools)
        elif e.type == "developer/message":
            active |= set(e.added)
            active -= set(e.removed)
        else:
            continue
        rows.append((e.session_id, int(e.seq), baseline, sorted(active)))
    return pd.DataFrame(rows, columns=["session_id", "seq", "baseline", "available"])


def tool_history(events: DataFrame) -> DataFrame:
    """(session_id, seq, baseline, available): tools after each header and each message that adds or removes some.

    A header starts anew if it is the first, opens a series, or gives a known tool another definition.
    """
    kind = dict(events.dtypes)["session_id"]
    cut = events.where("type in ('request/header', 'developer/message')").select("session_id", "seq", "type", "names", "definitions", "series", "added", "removed")
    return cut.groupBy("session_id").applyInPandas(_tools, f"session_id {kind}, seq bigint, baseline bigint, available array<string>")


def _steering(frame: pd.DataFrame) -> pd.DataFrame:
    inbox: dict[str, list] = {}
    claimed: set = set()
    rows = []
    for e in frame.sort_values("seq").itertuples():
        if e.type == "inbox/spliced":
            box = inbox.setdefault(e.target, [])
            at = int(e.start)
            gone = box[at : at + int(e.removed)]
            box[at : at + int(e.removed)] = list(e.inserted)
            claimed -= set(e.inserted)
            if e.target == "next-step" and e.outcome != "canceled":
                claimed |= set(gone)
        elif e.type == "user/message":
            mine = e.message_id in claimed
            claimed.discard(e.message_id)
            rows.append((e.session_id, int(e.seq), e.message_id, bool(mine and e.source == "user")))
    return pd.DataFrame(rows, columns=["session_id", "seq", "message_id", "steering"])


def steering_messages(events: DataFrame) -> DataFrame:
    """(session_id, seq, message_id, steering): whether each user message was claimed from the inbox before."""
    kind = dict(events.dtypes)["session_id"]
    cut = events.select("session_id", "seq", "type", "target", "start", "removed", "inserted", "outcome", "message_id", "source")
    return cut.groupBy("session_id").applyInPandas(_steering, f"session_id {kind}, seq bigint, message_id string, steering boolean")


def idle_compressed(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (start, end) moved together by the idle time before them: gaps that no earlier span covers."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = spans.withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("start") - F.coalesce(covered, F.col("start"))))
    removed = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return gap.withColumn("removed", removed).select(*[c for c in spans.columns if c not in ("start", "end")], (F.col("start") - F.col("removed")).alias("start"), (F.col("end") - F.col("removed")).alias("end"))


def sequence_layout(events: DataFrame) -> DataFrame:
    """Unit slots in order, and where each event's turn begins."""
    slot = (F.row_number().over(_session()) - 1).cast("long")
    out = events.withColumn("start", slot)
    return out.withColumns({"end": F.col("start") + 1, "turn_start": F.min("start").over(Window.partitionBy("session_id", "turn"))})


def carried_groups(rows: DataFrame, flagged: Column, order: str = "seq") -> DataFrame:
    """``rows`` with ``group``: flagged rows go with the next one that is not; what is left is one last group."""
    ahead = Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("group", F.coalesce(F.sum(F.when(flagged, 0).otherwise(1)).over(ahead), F.lit(0)).cast("long"))


def first_by(frames: Iterator[DataFrame], key: list[str]) -> DataFrame:
    """The rows of several frames, each key from the first frame that has it."""
    out = None
    for rank, frame in enumerate(frames):
        part = frame.withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    least = F.min("_rank").over(Window.partitionBy(*key))
    return out.withColumn("_least", least).where("_rank = _least").drop("_rank", "_least")
