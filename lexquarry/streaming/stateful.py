"""Streaming twins of the folds: machines whose state lives in the state store, one for each key."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexquarry.operators.machines import Machine

#: The state store that timers and variables of state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Keyed(StatefulProcessor):
    """One machine for each key. Its state goes when a timer at its end fires, so keys that fall silent take no room."""

    def __init__(self, kind: type[Machine], order: str, names: list[str], timed: bool):
        self.kind, self.order, self.names, self.timed = kind, order, names, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def machine(self) -> Machine:
        return self.kind(json.loads(self.state.get()[0]) if self.state.exists() else None)

    def rows(self, key, at, found: list[tuple]) -> Iterator[Row]:
        for values in found:
            yield Row(**dict(zip(self.names, (key[0], at, *values))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        machine = self.machine()
        for row in sorted((r.asDict() for r in rows), key=lambda r: r[self.order]):
            yield from self.rows(key, row[self.order], machine.take(row))
        self.state.update((machine.dump(),))
        if self.timed and (until := machine.until()) is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(until * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        machine = self.machine()
        yield from self.rows(key, machine.until(), machine.ended())
        self.state.clear()

    def close(self) -> None:
        pass


def run_machine(stream: DataFrame, key: str, order: str, fields: T.StructType, kind: type[Machine], late: str | None = None) -> DataFrame:
    """(key, order, *fields): what the machine of each key gives for the rows of a stream, in order within a micro-batch.

    State is a few numbers or the unfinished text of a key. With `late`, order is seconds since 1970, rows may come that late, and
    a key's state goes (with what it still gives, at the time it ends) once the watermark has passed the machine's until().
    Without it state stays until the query ends. Sets the session's state store to one that keeps timers.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = T.StructType([stream.schema[key], stream.schema[order], *fields])
    if late is not None:
        stream = stream.withColumn("_time", F.timestamp_micros((F.col(order) * 1_000_000).cast("long"))).withWatermark("_time", late)
    processor = Keyed(kind, order, out.names, late is not None)
    return stream.groupBy(key).transformWithState(processor, out, "Append", "None" if late is None else "EventTime")


def event_sessions(events: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, window, n): sessions of events without a gap, closed once the watermark has passed them. Timestamps without a
    zone are taken as the session's zone."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("window")).agg(F.count("*").alias("n"))
