"""Session helpers: sessions for tests, and tables that cut a lineage.

Intermediate tables live under ``spark.checkpoint.dir``, the folder that a
cluster shares between the driver and its executors, so a lost executor loses
nothing that was written.  Only a local session may fall back to a folder of
its own, and only where that setting is absent.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "plumbline", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/plumbline-checkpoints"


_roots: list[str] = []
_made: list[Scratch] = []


class Scratch:
    """Tables of one run, written as Parquet in the shared folder.

    ``save`` writes a frame and returns it as a scan; ``drop`` removes tables
    that no later step reads.  The tables that a returned frame still reads
    stay until ``close``, until the ``workspace`` around it ends, or until
    ``close_all``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{_roots[-1] if _roots else shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        if not _roots:
            _made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def workspace(spark: SparkSession, label: str) -> Iterator[Scratch]:
    """Every scratch table that operators make inside lies in one folder, which goes at the end: for callers that have written what they want by then."""
    own = Scratch(spark, label)
    _roots.append(own.path)
    try:
        yield own
    finally:
        _roots.pop()
        own.close()
        if own in _made:
            _made.remove(own)


def close_all() -> None:
    """Removes all scratch tables of this process; frames that read them are of no use afterwards."""
    while _made:
        _made.pop().close()
