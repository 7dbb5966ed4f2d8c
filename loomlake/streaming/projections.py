"""Projection units: a fold over a session's events whose versioned state is kept between batches.

A unit says how a state begins, how an event changes it and what of it is shown. In a stream the state
lives in Spark's state store, per session; in batch it is a saved row from which the tail is replayed.
A state of another version is thrown away and folded anew; it is never migrated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Projection:
    """``apply(state, event)`` gives the same object back where nothing changes; states are JSON values."""

    key: str
    version: int
    init: Callable[[], object]
    apply: Callable[[object, dict], object]
    view: Callable[[object], object]


VIEW = "session_id string, seq bigint, view string"
SAVED = "session_id string, version int, seq bigint, state string"


def _folded(unit: Projection, state: object, seq: int, frame: pd.DataFrame) -> tuple[object, int]:
    for event in frame.sort_values("seq").to_dict("records"):
        if event["seq"] > seq:
            state = unit.apply(state, event)
            seq = int(event["seq"])
    return state, seq


def project_stream(events: DataFrame, unit: Projection) -> DataFrame:
    """A stream of (session_id, seq, view): one row for a session whenever a batch changes its view.

    ``events``: a stream with session_id (string) and seq. What a restart delivers twice is passed over,
    as a state knows how far it has come. Write it in update mode with a checkpoint.
    """
    held = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("state", T.StringType()), T.StructField("view", T.StringType())])

    def run(key, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        version, seq, state, shown = store.get if store.exists else (unit.version, -1, json.dumps(unit.init()), None)
        if version != unit.version:
            seq, state, shown = -1, json.dumps(unit.init()), None
        now, seq = _folded(unit, json.loads(state), seq, pd.concat(list(frames)))
        view = json.dumps(unit.view(now), ensure_ascii=False, sort_keys=True)
        store.update((unit.version, seq, json.dumps(now), view))
        if view != shown:
            yield pd.DataFrame({"session_id": [key[0]], "seq": [seq], "view": [view]})

    return events.groupBy("session_id").applyInPandasWithState(run, VIEW, held, "update", "NoTimeout")


def replay(saved: DataFrame, events: DataFrame, unit: Projection) -> DataFrame:
    """``saved`` (session_id, version, seq, state) after ``events``: only events behind a saved seq are folded.

    A stale row costs a longer tail; a row of another version is discarded and the whole log folded.
    """
    good = saved.where(F.col("version") == unit.version)
    done = good.select("session_id", F.col("seq").alias("_done"))
    tail = events.join(done, "session_id", "left").where(F.col("seq") > F.coalesce("_done", F.lit(-1))).drop("_done")

    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        state, seq = (json.loads(old["state"].iloc[0]), int(old["seq"].iloc[0])) if len(old) else (unit.init(), -1)
        state, seq = _folded(unit, state, seq, new)
        return pd.DataFrame({"session_id": [key[0]], "version": [unit.version], "seq": [seq], "state": [json.dumps(state, ensure_ascii=False, sort_keys=True)]})

    return good.groupBy("session_id").cogroup(tail.groupBy("session_id")).applyInPandas(run, SAVED)


def usable(checkpoints: DataFrame, headers: DataFrame, format_version: int) -> DataFrame:
    """Checkpoints that belong to the stored log: same format, creation, workspace and lineage (session_id,
    format, created_at, cwd, seeded, inherited). Without a format none is taken; missing lineage is unseeded."""
    h = headers.select("session_id", F.col("created_at").alias("_at"), F.col("cwd").alias("_cwd"), F.coalesce("seeded", F.lit(False)).alias("_seeded"), F.coalesce("inherited", F.lit(0)).alias("_inherited"))
    same = (F.col("format") == format_version) & (F.col("created_at") == F.col("_at")) & F.col("cwd").eqNullSafe(F.col("_cwd")) & (F.coalesce("seeded", F.lit(False)) == F.col("_seeded")) & (F.coalesce("inherited", F.lit(0)) == F.col("_inherited"))
    return checkpoints.join(h, "session_id").where(same).select(*checkpoints.columns)


def written_once(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch in a folder of its id, so that one that runs again replaces itself.

    A batch is durable when this returns; only then may anything act on it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def _outline(state: dict, event: dict) -> dict:
    turns, draft = state["turns"], state["draft"]
    kind = event["type"]
    if kind == "turn/start":
        if turns and event["turn"] <= turns[-1]["turn"]:
            return state
        return {"turns": [*turns, {"turn": int(event["turn"]), "seq": int(event["seq"]), "prompt": "", "response": ""}], "draft": ""}
    text = " ".join((event.get("text") or "").split())
    if kind == "user/message" and turns and not turns[-1]["prompt"] and text:
        return {"turns": [*turns[:-1], {**turns[-1], "prompt": cut(text, 50)}], "draft": draft}
    if kind == "assistant/message" and text:
        return {"turns": turns, "draft": cut(text, 120)}
    if kind == "turn/end" and draft:
        return {"turns": [*turns[:-1], {**turns[-1], "response": draft}] if turns else turns, "draft": ""}
    return state


def cut(text: str, limit: int) -> str:
    return text if len(text) < limit else text[: limit - 1].rstrip() + "…"


#: One entry for each turn: its prompt and its last committed response.
OUTLINE = Projection("turnOutline", 2, lambda: {"turns": [], "draft": ""}, _outline, lambda state: state["turns"])
