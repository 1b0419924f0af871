"""Answers as they are told: parts of a session's answer come as a stream and are put together in state.

A part is (session, seq, delta, error, done, at). Parts are taken in the order of
seq, from 0: one that came before its turn waits in state, and one that comes
again changes nothing. An error ends an answer with its text; so does a part that
is done; an answer to which nothing more comes within the timeout (by event time)
is closed as timed out, with whatever was waiting in order. Parts of a closed
answer are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from marlstone.streaming.usage import to_table

OPEN, CLOSED, FAILED, LATE = "open", "closed", "failed", "timed out"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Answer(StatefulProcessor):
    """One session: its text, the parts that say something, their token estimates, and what still waits."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "text string, parts bigint, tokens bigint, next bigint, status string, due bigint")
        self.early = handle.getMapState("early", "seq bigint", "delta string, error string, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text, parts, tokens, at, status, due = self.told.get() if self.told.exists() else ("", 0, 0, 0, OPEN, 0)
        new, latest = {}, 0
        for frame in rows:
            for seq, delta, error, done, ms in zip(*(frame[c].tolist() for c in ("seq", "delta", "error", "done", "ms")), strict=True):
                latest = max(latest, ms)
                if seq >= at:
                    new.setdefault(seq, (delta, error, bool(done)))
        if status == OPEN:
            if new:
                for seq, part in self.early.iterator():
                    new.setdefault(seq[0], tuple(part))
            taken = []
            while status == OPEN and at in new:
                taken.append(at)
                text, parts, tokens, status = self._add(text, parts, tokens, new.pop(at))
                at += 1
            for seq in taken:
                if self.early.containsKey((seq,)):
                    self.early.removeKey((seq,))
            for seq, part in new.items() if status == OPEN else ():
                self.early.updateValue((seq,), part)
            if due:
                self.handle.deleteTimer(due)
            due = 0
            if status == OPEN:
                due = max(latest + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
                self.handle.registerTimer(due)
            else:
                self.early.clear()
            self.told.update((text, parts, tokens, at, status, due))
        yield self._row(key, text, parts, tokens, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text, parts, tokens, at, status, due = self.told.get()
        if status == OPEN and expiredTimerInfo.getExpiryTimeInMs() == due:
            for _, part in sorted((seq[0], tuple(part)) for seq, part in self.early.iterator()):
                if status == OPEN:
                    text, parts, tokens, status = self._add(text, parts, tokens, part)
            status = LATE if status == OPEN else status
            self.early.clear()
            self.told.update((text, parts, tokens, at, status, 0))
            yield self._row(key, text, parts, tokens, status)

    def close(self) -> None:
        pass

    @staticmethod
    def _add(text: str, parts: int, tokens: int, part: tuple) -> tuple[str, int, int, str]:
        delta, error, done = part
        said = [x for x in (delta, f"Error: {error}" if error is not None else None) if x]
        return text + "".join(said), parts + len(said), tokens + sum(len(x) // 4 for x in said), FAILED if error is not None else CLOSED if done else OPEN

    @staticmethod
    def _row(key, *told) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *told)], columns=["session", "text", "parts", "tokens", "status"])


def answers(parts: DataFrame, late: str = "1 minute", timeout: int = 300) -> DataFrame:
    """Sessions that something came for, as they stand: session, text, parts, tokens, status. timeout in seconds.

    Rows without a session or a seq are left out. A session's text is held in one state.
    """
    known = parts.where("session IS NOT NULL AND seq IS NOT NULL").withWatermark("at", late)
    ready = known.select("session", F.col("seq").cast("bigint").alias("seq"), "delta", "error", F.coalesce("done", F.lit(False)).alias("done"), "at", F.unix_millis("at").alias("ms"))
    kind = parts.schema["session"].dataType.simpleString()
    return ready.groupBy("session").transformWithStateInPandas(
        Answer(timeout * 1000), f"session {kind}, text string, parts bigint, tokens bigint, status string", "Update", "EventTime"
    )


def start(parts: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], **more) -> StreamingQuery:
    """Starts the stream of answers; each batch of sessions that changed goes to write. State is kept in RocksDB, for this stream alone."""
    spark, (name, provider) = parts.sparkSession, _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        return to_table(answers(parts, **more), checkpoint, write, mode="update")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest(stored: DataFrame, batch: str = "batch") -> DataFrame:
    """Each session as the last batch that changed it left it."""
    columns = [c for c in stored.columns if c not in ("session", batch)]
    last = stored.groupBy("session").agg(F.max_by(F.struct(*columns), batch).alias("s"))
    return last.select("session", "s.*")
