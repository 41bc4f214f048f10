"""Folds in event time: a stream gives what the table gives, in whatever order its events arrive.

Events wait in a list state until the watermark has passed their time, and then
go through the fold by time and number, so the order of arrival shows nowhere as long as
it stays within the watermark's delay; Spark drops and counts what comes later.  A
timer stands at the time of each waiting event, and one where the fold's own
state falls due (a pull, a window of builds): timers of a key fire earliest first.
A key whose fold has no state and whose list is empty keeps nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.folds import Fold

#: When a fold's state falls due, in milliseconds; None if nothing is waited for.
Due = Callable[[object], int | None]


class Ordered(StatefulProcessor):
    """Runs a fold over the events of a key in the order of their times."""

    def __init__(self, key: str, fold: Fold, columns: list[str], due: Due = lambda _: None, end: Callable[[object], list[tuple]] = lambda _: []):
        self.key, self.fold, self.columns, self.due, self.end = key, fold, columns, due, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, event string")
        self.kept = handle.getValueState("kept", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times: set[int] = set()
        for part in rows:
            for event in part.drop(columns=["event_time"]).to_dict("records"):
                event = {k: None if v is None or v != v else v.item() if hasattr(v, "item") else v for k, v in event.items()}
                self.waiting.appendValue((int(event["at"]), int(event["seq"]), json.dumps(event)))
                times.add(int(event["at"]))
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        out: list[tuple] = []
        for _, _, event in (x for x in held if x[0] <= now):
            state, rows = self.fold(state, json.loads(event))
            out += rows
        due = self.due(state)
        if due is not None and due <= now:
            out += self.end(state)
            state, due = None, None
        rest = [x for x in held if x[0] > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.kept.update((json.dumps(state),)) if state is not None else self.kept.clear()
        if due is not None:
            self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, *self.columns])

    def close(self) -> None:
        pass


def ordered(events: DataFrame, key: str, fold: Fold, schema: str, delay: str, due: Due = lambda _: None, end: Callable[[object], list[tuple]] = lambda _: []) -> DataFrame:
    """(key, …) of a stream of events (key, seq, at, …), ``at`` in milliseconds; rows come out as the watermark, ``delay`` behind the latest event, passes what they depend on.

    Needs the RocksDB state store, which Spark asks of all such operators.
    """
    kind = events.schema[key].dataType.simpleString()
    columns = [c.split()[0] for c in schema.split(", ")]
    timed = events.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(Ordered(key, fold, columns, due, end), f"{key} {kind}, {schema}", "Append", "EventTime")
