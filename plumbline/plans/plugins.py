"""Plug-ins: hooks that turn frames into frames.

A hook that fails while its plan is built disables its plug-in, with the
reason, and the request goes on without it.  Rows that a plug-in adds carry its
id as ``origin``; it cannot pass them off as the workspace's.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Plugin(Protocol):
    """A plug-in has an id and any of the hooks; a hook that it lacks changes nothing.

    initialize(settings); patch_options(target, options); patch_source_path(
    target, paths); synthetic_sources(target) -> (uri, text) rows or None;
    before_request(request, cursors); after_completion(cursors, rows),
    after_hover(cursors, rows) and after_definition(cursors, rows);
    filter_diagnostics(cursors, rows); after(request, rows) for any request.
    """

    id: str


class Overlay(Protocol):
    """Open buffers that a query asks before the index: frames of (uri, dirty) and of occurrences, flagged as from the overlay."""

    contributes: bool

    def dirty(self) -> DataFrame: ...

    def occurrences(self) -> DataFrame: ...


#: Compiles targets before a rename: None if all went well, else the reason.
Compile = Callable[[list[str]], str | None]


@dataclass
class Plugins:
    active: list[Plugin] = field(default_factory=list)
    disabled: dict[str, str] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> None:
        if plugin.id in {p.id for p in self.active}:
            raise ValueError(f"plug-in {plugin.id} is registered already")
        self.active.append(plugin)

    def load(self, names: list[str], settings: dict | None = None) -> None:
        """Registers plug-ins by ``module:class`` and initialises them; one that fails is disabled, with the reason."""
        for name in names:
            module, _, kind = name.partition(":")
            try:
                plugin = getattr(importlib.import_module(module), kind)()
                self.register(plugin)
                if hasattr(plugin, "initialize"):
                    plugin.initialize(settings or {})
            except Exception as e:  # noqa: BLE001  any failure disables it
                self.active = [p for p in self.active if f"{type(p).__module__}:{type(p).__name__}" != name]
                self.disabled[name] = f"{type(e).__name__}: {e}".splitlines()[0]

    def fold(self, hook: str, value, *context):
        """The value after a hook of every plug-in, in order of registration: ``hook(*context, value)``."""
        for plugin in list(self.active):
            run = getattr(plugin, hook, None)
            if run is None:
                continue
            try:
                value = run(*context, value)
            except Exception as e:  # noqa: BLE001  any failure of a hook disables it
                self.active.remove(plugin)
                self.disabled[plugin.id] = f"{type(e).__name__}: {e}".splitlines()[0]
        return value

    def sources(self, target: str) -> list[tuple[str, DataFrame]]:
        """(plug-in, rows) of the synthetic sources of a target."""
        found = []
        for plugin in list(self.active):
            rows = self.fold_one(plugin, "synthetic_sources", target)
            if rows is not None:
                found.append((plugin.id, rows))
        return found

    def fold_one(self, plugin: Plugin, hook: str, *context):
        run = getattr(plugin, hook, None)
        try:
            return run(*context) if run else None
        except Exception as e:  # noqa: BLE001  any failure of a hook disables it
            self.active.remove(plugin)
            self.disabled[plugin.id] = f"{type(e).__name__}: {e}".splitlines()[0]
            return None

    def apply(self, request: str, rows: DataFrame) -> DataFrame:
        """The rows after all plug-ins, each row with its ``origin``."""
        columns = rows.columns
        out = rows.withColumn("origin", F.lit("workspace"))
        for plugin in [p for p in self.active if hasattr(p, "after")]:
            try:
                before = out.select(*columns)
                after = plugin.after(request, before).select(*columns)
                kept = out.join(after.distinct(), [out[c].eqNullSafe(after[c]) for c in columns], "left_semi")
                added = after.exceptAll(before).withColumn("origin", F.lit(plugin.id))
                out = kept.unionByName(added)
            except Exception as e:  # noqa: BLE001  any failure of a hook disables it
                self.active.remove(plugin)
                self.disabled[plugin.id] = f"{type(e).__name__}: {e}".splitlines()[0]
        return out
