"""Stale reads and changed files that start an ingest, as sinks of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.workspace import WATCHED
from plumbline.sources.store import Store

Rebuild = Callable[[], dict[str, DataFrame]]


def reingest(store: Store, rebuild: Rebuild | None) -> dict | None:
    """Publishes the workspace as it is now; nothing without a workspace."""
    return store.publish(rebuild()) if rebuild else None


def on_stale_reads(store: Store, rebuild: Rebuild | None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over reads (uri, stale): one ingest for each batch with a stale read."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.where("stale").isEmpty():
            reingest(store, rebuild)

    return run


def on_watched_files(store: Store, rebuild: Rebuild | None, read_config: Callable[[], None] = lambda: None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over file events (path): changed facts start an ingest, a changed configuration is read again."""

    def run(batch: DataFrame, _: int) -> None:
        hit = batch.agg(*(F.coalesce(F.bool_or(F.rlike("path", F.lit(p))), F.lit(False)).alias(k) for k, p in WATCHED.items())).first()
        if hit["facts"]:
            reingest(store, rebuild)
        if hit["config"]:
            read_config()

    return run
