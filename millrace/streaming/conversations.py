"""Conversations as they come in: closed by a timer when they fall silent, and joined with the flags that follow.

Both keep state only as long as the watermark asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.operators.rules import score, with_hits

FLAG = 0.7
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "conv_id long, n_turns long, score double, flagged array<long>, begun timestamp, ended timestamp"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep state where timers can be kept."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _spells(turns: list[tuple], idle_ms: int) -> list[list[tuple]]:
    """Turns (at_ms, turn, score) in order of time, parted where none came for idle_ms."""
    out: list[list[tuple]] = []
    for t in sorted(turns):
        if out and t[0] - out[-1][-1][0] < idle_ms:
            out[-1].append(t)
        else:
            out.append([t])
    return out


class Closing(StatefulProcessor):
    """One conversation: its open turns in a list state, and in a value state the timer for the end of the first of them.

    Turns are parted by their times, not by the batches they come in, so the result is that of a batch query.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "at long, turn long, score double")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, turns: list[tuple]) -> None:
        at = _spells(turns, self.idle_ms)[0][-1][0] + self.idle_ms
        if self.timer.exists():
            if self.timer.get()[0] == at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["ts"].map(lambda t: t.timestamp() * 1000).astype("int64")
            self.turns.appendList(list(zip(at.tolist(), part["turn"].tolist(), part["s"].tolist(), strict=True)))
        self._set_timer([tuple(t) for t in self.turns.get()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spells = _spells([tuple(t) for t in self.turns.get()], self.idle_ms)
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [s for s in spells if s[-1][0] + self.idle_ms <= now]
        left = [t for s in spells if s[-1][0] + self.idle_ms > now for t in s]
        self.timer.clear()
        if left:
            self.turns.put(left)
            self._set_timer(left)
        else:
            self.turns.clear()
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        made = [(key[0], len(s), round(sum(x[2] for x in s), 6), sorted(x[1] for x in s if x[2] >= FLAG), at(s[0][0]), at(s[-1][0])) for s in over]
        yield pd.DataFrame(made, columns=["conv_id", "n_turns", "score", "flagged", "begun", "ended"])

    def close(self) -> None:
        pass


def closed(stream: DataFrame, idle_ms: int, delay: str) -> DataFrame:
    """(conv_id, n_turns, score, flagged, begun, ended) of conversations of a stream (conv_id, turn, ts, text), once no turn
    has come for idle_ms of event time.

    A conversation whose turns are that far apart is closed and begins anew. Turns later than the watermark are dropped.
    Times count to the millisecond. Nothing of a closed conversation stays in the state. Start the query within `timers`, in
    a session whose time zone is UTC.
    """
    scored = with_hits(stream.withWatermark("ts", delay), "text").select("conv_id", "turn", "ts", score().alias("s"))
    return scored.groupBy("conv_id").transformWithStateInPandas(Closing(idle_ms), CLOSED, "Append", "EventTime")


def flags_of(stream: DataFrame) -> DataFrame:
    """(conv_id, flag_turn, flag_ts, flag_score): the turns of a stream that the rules flag."""
    hit = with_hits(stream, "text").select("conv_id", F.col("turn").alias("flag_turn"), F.col("ts").alias("flag_ts"), score().alias("flag_score"))
    return hit.where(F.col("flag_score") >= FLAG)


def followed(turns: DataFrame, flags: DataFrame, within: str, delay: str | None = None) -> DataFrame:
    """Each turn with the flags of its conversation that follow within a time; a turn without any once, with nulls.

    turns (conv_id, turn, ts), flags (conv_id, flag_turn, flag_ts). Batch tables, or two streams with their delay: each side's
    rows stay in the state until the other's watermark rules out a match, and turns without flags are given out then.
    """
    if delay:
        turns, flags = turns.withWatermark("ts", delay), flags.withWatermark("flag_ts", delay)
    other = flags.withColumnRenamed("conv_id", "flag_conv")
    soon = (F.col("flag_ts") > F.col("ts")) & (F.col("flag_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return turns.join(other, (F.col("conv_id") == F.col("flag_conv")) & soon, "left_outer").select("conv_id", "turn", "flag_turn")
