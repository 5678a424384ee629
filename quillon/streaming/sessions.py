"""The engine on streams: detection as a projection, chat as keyed state in event time, and the log as a sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.chat import COLUMNS, LOG, TURN, State, append_log, log_rows, prepared, step, sure
from ..operators.detect import detect
from ..settings import Settings

WAITING = "turn int, text string, primary string, confidence double, multi_intent boolean, protocol int, direct string, sure boolean, ms long"
#: The state store that timers and lists need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def detect_stream(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Row-local, so a streaming source needs nothing else."""
    return detect(messages, settings)


class Session(StatefulProcessor):
    """Turns wait until the watermark has passed them, and are then answered in the order of their numbers.

    State: where the session is (a value), the turns that wait (a list), and timers: one at each micro-batch's last turn, and
    one ``idle`` milliseconds after the last turn that was answered, at which the session is forgotten.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "pending string, step int, turns int, last long")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = -1
        for batch in rows:
            part = batch[[x.split()[0] for x in WAITING.split(", ")]]
            self.waiting.appendList([tuple(r) for r in part.astype(object).itertuples(index=False, name=None)])
            latest = max(latest, int(part["ms"].max()))
        if latest >= 0:
            self.handle.registerTimer(latest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = [r for r in waiting if r[-1] <= now], [r for r in waiting if r[-1] > now]
        pending, done, turns, last = self.at.get() if self.at.exists() else (None, 0, 0, -1)
        state, out = State(pending, done, turns), []
        for turn, text, primary, confidence, multi, protocol, direct, is_sure, ms in sorted(ready, key=lambda r: (r[0] is not None, r[0], r[-1], r[1])):
            index = 2 * state.turns + 1
            strategy, reply, left = step(state, primary, is_sure, protocol, direct)
            out.append((key[0], turn, index, text, primary, confidence, multi, strategy, reply, "text", left))
            last = max(last, ms)
        if ready:
            self.at.update((state.pending, state.step, state.turns, last))
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.handle.registerTimer(last + self.idle)
        elif not rest and self.at.exists() and now >= last + self.idle:
            self.at.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"pending_step": "Int32"})

    def close(self) -> None:
        pass


def chat_stream(messages: DataFrame, settings: Settings = Settings(), lateness: str = "1 minute", idle: int = 24 * 3600 * 1000) -> DataFrame:
    """Answered turns of a stream of session_id, turn, text and at, a timestamp.

    A turn is answered once the watermark (the latest ``at`` less ``lateness``) has passed it, in the order of turn numbers
    among all that wait, so turns may come in any order within that time; later ones are dropped as late data. A session's
    state ends ``idle`` milliseconds, in event time, after its last turn. Needs Spark's RocksDB state store, and asks for it.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # The time of a turn goes through detection as a column of the message.
    turns = prepared(messages, settings, "at").withColumn("sure", sure(settings)).withColumn("ms", F.unix_millis("at"))
    return turns.withWatermark("at", lateness).groupBy("session_id").transformWithStateInPandas(Session(idle), TURN, "append", "EventTime")


def write_log(turns: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the log of a stream of ``TURN`` rows to ``path``, for ``chat.read_log``.

    A micro-batch is a write of its own, named after the stream's checkpoint and the batch's number, so a batch that is replayed
    after a failure replaces what it wrote before.
    """
    spark = turns.sparkSession
    stream = spark.range(1).select(F.substring(F.md5(F.lit(checkpoint)), 1, 12)).first()[0]

    def write(batch: DataFrame, number: int) -> None:
        append_log(log_rows(batch, F.current_timestamp()).select([x.split()[0] for x in LOG.split(", ")]), path, f"{stream}-{number}")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
