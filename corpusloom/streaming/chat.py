"""Chat cleaning over a stream: the last messages of each conversation, as batches arrive."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import strip, truncated
from corpusloom.operators.chat import CHARS, LAST, ROLES

#: What is kept of a conversation: its last turns in order, each text cut.
STATE = "turns array<long>, roles array<string>, texts array<string>"


def clean_turns(turns: DataFrame, chars: int = CHARS) -> DataFrame:
    """The rules that need one message only: role, content, length. Works on streams without state."""
    kept = turns.where(F.col("role").isin(*ROLES) & (strip(F.col("text")) != ""))
    return kept.select("conv_id", "turn", "role", truncated(strip(F.col("text")), chars).alias("text"))


def histories(turns: DataFrame, last: int = LAST, chars: int = CHARS) -> DataFrame:
    """(conv_id, turn, role, text): the cleaned history of every conversation that a batch of turns (conv_id, turn, role, text) belongs to.

    The state holds the last raw turns of a conversation, cut, whatever their roles; a batch reads its own turns only. Turns may arrive in any order;
    a turn without a number counts as the earliest.
    """
    place = lambda r: (r[0] is not None, r[0] or 0)

    def remember(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState):
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held += [(None if pd.isna(n) else int(n), r, t) for n, r, t in zip(frame["turn"], frame["role"], frame["text"])]
            held = sorted(held, key=place)[-last:]
        state.update(tuple([r[k] for r in held] for k in range(3)))
        columns = {name: pd.Series([r[k] for r in held], dtype=kind) for k, (name, kind) in enumerate((("turn", "Int64"), ("role", "object"), ("text", "object")))}
        yield pd.DataFrame({"conv_id": pd.Series([key[0]] * len(held), dtype="Int64"), **columns})

    cut = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", truncated(strip(F.col("text")), chars).alias("text"))
    kept = cut.groupBy("conv_id").applyInPandasWithState(remember, "conv_id long, turn long, role string, text string", STATE, "update", GroupStateTimeout.NoTimeout)
    return kept.where(F.col("role").isin(*ROLES) & (F.col("text") != ""))


def start_history(turns: DataFrame, path: str, checkpoint: str, last: int = LAST) -> StreamingQuery:
    """Keeps, by batch, the cleaned histories of the conversations of the batch under path/clean.

    A batch that is run again replaces its own folder and starts from the state before it, so each turn counts once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/clean/batch={number}")

    return histories(turns, last).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
