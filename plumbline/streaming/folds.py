"""Keyed folds over ordered events: open buffers, debounced builds, diagnostics.

A fold is a pure function of (state, event) to (state, outputs); state is JSON
data or None.  ``batch`` runs it over a table, ``stream`` over a stream; both
give the same rows for the same events in the same order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

Fold = Callable[[object, dict], tuple[object, list[tuple]]]


# Open buffers


def utf16_index(text: str, line: int, char: int) -> int:
    """Index of a position given in UTF-16 columns; clamps to the line's end and the text's end, and does not split a pair."""
    start = 0
    for _ in range(line):
        cut = text.find("\n", start)
        if cut < 0:
            return len(text)
        start = cut + 1
    end = text.find("\n", start)
    end = len(text) if end < 0 else end
    if end > start and text[end - 1] == "\r":
        end -= 1
    units = 0
    for i in range(start, end):
        units += 2 if ord(text[i]) > 0xFFFF else 1
        if units > char:
            return i
    return end


def apply_edits(text: str, edits: list[dict]) -> str:
    """Each edit addresses the text that those before it left; without a range it replaces all."""
    for e in edits:
        if e.get("sl") is None:
            text = e["text"]
            continue
        a, b = utf16_index(text, e["sl"], e["sc"]), utf16_index(text, e["el"], e["ec"])
        a, b = min(a, b), max(a, b)
        text = text[:a] + e["text"] + text[b:]
    return text


def buffer_fold(state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]:
    """open sets the text, change edits it, close drops it; a ranged change to a closed buffer is ignored. Out: (seq, version, text)."""
    kind, edits = event["kind"], json.loads(event["edits"] or "[]")
    if kind == "close":
        return None, [(event["seq"], None, None)]
    if kind == "open":
        state = {"version": event["version"], "text": edits[0]["text"] if edits else ""}
    elif kind == "change":
        if state is None and any(e.get("sl") is not None for e in edits):
            return None, []
        state = {"version": event["version"], "text": apply_edits("" if state is None else state["text"], edits)}
    else:
        return state, []
    return state, [(event["seq"], state["version"], state["text"])]


# Builds


def debounce_fold(window_ms: int) -> Fold:
    """A window opens at the first request after idle and is not extended; requests join it, their intents add up. Out, as the next window opens: (opened, n, compile_first)."""

    def fold(state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]:
        at = int(event["at"])
        if state is not None and at < state["opened"] + window_ms:
            return state | {"n": state["n"] + 1, "compile": state["compile"] or bool(event["compile"])}, []
        out = [] if state is None else [(state["opened"], state["n"], state["compile"])]
        return {"opened": at, "n": 1, "compile": bool(event["compile"])}, out

    return fold


def debounce_end(state: dict | None) -> list[tuple]:
    """The window that is still open when a table ends."""
    return [] if state is None else [(state["opened"], state["n"], state["compile"])]


def pull_fold(window_ms: int) -> Fold:
    """A change arms a pull, due after the window and not moved by later changes; a save or close disarms it. Out, as later events show that it was due: (armed, due)."""

    def fold(state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]:
        at, out = int(event["at"]), []
        if state is not None and at >= state["armed"] + window_ms:
            out, state = pull_end(window_ms)(state), None
        if event["kind"] == "change":
            return state or {"armed": at}, out
        return None, out

    return fold


def pull_end(window_ms: int) -> Callable[[dict | None], list[tuple]]:
    """The pull that is still armed when a table ends, or whose time has come."""
    return lambda state: [] if state is None else [(state["armed"], state["armed"] + window_ms)]


# Token results


def cache_fold(cap: int = 32) -> Fold:
    """Latest result of each document of a session, the ``cap`` last used ones; a close drops its own. Out of a request: (seq, result_id, delta): may it be answered as a change to the result that the client names?"""

    def fold(state: list | None, event: dict) -> tuple[list | None, list[tuple]]:
        held = [list(x) for x in state or []]
        mine = next((n for u, n in held if u == event["uri"]), 0)
        held = [x for x in held if x[0] != event["uri"]]
        if event["kind"] == "close":
            return held or None, []
        held.append([event["uri"], mine + 1])
        return held[-cap:], [(event["seq"], mine + 1, bool(mine) and event["previous"] == mine)]

    return fold


# Diagnostics


def router_fold(state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]:
    """Publishes of build targets for one file: reset replaces or removes the target's list, else it grows. Out: (seq, union), the union once empty only after something was shown."""
    state = state or {"targets": [], "shown": False}
    new = json.loads(event["messages"] or "[]")
    names = [t for t, _ in state["targets"]]
    targets = [[t, list(m)] for t, m in state["targets"]]
    k = names.index(event["target"]) if event["target"] in names else None
    if event["reset"] and k is not None and not new:
        del targets[k]
    elif event["reset"] and k is not None:
        targets[k][1] = new
    elif k is not None:
        targets[k][1] += new
    elif new or not event["reset"]:
        targets.append([event["target"], new])
    union = [m for _, ms in targets for m in ms]
    if union:
        return {"targets": targets, "shown": True}, [(event["seq"], json.dumps(union))]
    return None, [(event["seq"], "[]")] if state["shown"] else []


def layers_fold(state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]:
    """Build results before typing results of one file: a build publish drops the typing ones, as save and close do. Out: (seq, union)."""
    state = state or {"build": [], "typing": []}
    if event["kind"] == "build":
        state = {"build": json.loads(event["messages"] or "[]"), "typing": []}
    elif event["kind"] == "typing":
        state = state | {"typing": json.loads(event["messages"] or "[]")}
    else:
        state = state | {"typing": []}
    return state, [(event["seq"], json.dumps(state["build"] + state["typing"]))]


# Running


def batch(events: DataFrame, key: str, order: str, fold: Fold, out: str, end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """The fold over a table: keys are dealt to tasks and read in order, one state is held at a time. out: columns behind the key."""
    kind = events.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in out.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, started = None, None, False

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[key, *names], dtype=object)

        for part in parts:
            rows: list[tuple] = []
            for event in part.to_dict("records"):
                if started and event[key] != last and end:
                    rows += [(last, *x) for x in end(state)]
                if not started or event[key] != last:
                    state, last, started = None, event[key], True
                state, made = fold(state, event)
                rows += [(last, *x) for x in made]
            yield frame(rows)
        if started and end:
            yield frame([(last, *x) for x in end(state)])

    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kind}, {out}")


def stream(events: DataFrame, key: str, order: str, fold: Fold, out: str, end: Callable[[object], list[tuple]] | None = None, after_ms: int | None = None) -> DataFrame:
    """The fold over a stream: one state for each key, as JSON, ordered inside each trigger; a state of None is removed.

    With ``end``, a key without events for ``after_ms`` of processing time gives
    out what its state still holds, as ``batch`` does where a table ends.
    """
    kind = events.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in out.split(",")]

    def run(group: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else None
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(group[0], *x) for x in end(state)], columns=[key, *names], dtype=object)
            return
        rows: list[tuple] = []
        for event in pd.concat(list(parts)).sort_values(order).to_dict("records"):
            state, made = fold(state, event)
            rows += [(group[0], *x) for x in made]
        if state is None:
            if held.exists:
                held.remove()
        else:
            held.update((json.dumps(state),))
            if end:
                held.setTimeoutDuration(after_ms)
        yield pd.DataFrame(rows, columns=[key, *names], dtype=object)

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if end else GroupStateTimeout.NoTimeout)
