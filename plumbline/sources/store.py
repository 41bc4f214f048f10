"""Versioned tables: one folder for each generation, one manifest that names the current one.

A generation is written to a folder of its own, the manifest is written beside
the old one and renamed over it; a reader that has opened a generation keeps
reading it until the janitor removes it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class Store:
    """A store at a root; with ``readonly`` it publishes and removes nothing."""

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly
        self.pinned: Counter[str] = Counter()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The manifest, or None before the first publish; another version is refused."""
        if not self._files.exists(self._path(f"{self.root}/manifest.json")):
            return None
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest.json").collect()))
        if found["version"] != VERSION:
            raise ValueError(f"version {found['version']} of the store is not known")
        return found

    def publish(self, tables: dict[str, DataFrame], fail: Callable[[str], None] = lambda _: None, rules: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> dict:
        """Writes a generation and makes it current; ``fail`` is called with each step, for tests.

        ``rules`` gives (rule, broken) for the tables as written; a generation
        that breaks one is removed and never becomes current.
        """
        if self.readonly:
            raise PermissionError("the store was opened to be read")
        now = self.manifest()
        n = 1 + (now["generation"] if now else 0)
        folder = f"{self.root}/generation-{n}"
        self._files.delete(self._path(folder), True)  # left by a publish that did not end
        for name, df in tables.items():
            fail(name)
            df.write.parquet(f"{folder}/{name}")
        counts = {name: self.spark.read.parquet(f"{folder}/{name}").count() for name in tables}
        if rules:
            broken = rules({name: self.spark.read.parquet(f"{folder}/{name}") for name in tables}).where("broken > 0").collect()  # one row for each rule
            if broken:
                self._files.delete(self._path(folder), True)
                raise ValueError("; ".join(f"{r['rule']}: {r['broken']} rows" for r in broken))
        found = {"version": VERSION, "generation": n, "folder": f"generation-{n}", "tables": counts}
        fail("manifest")
        out = self._files.create(self._path(f"{self.root}/manifest.new"), True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        fail("rename")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(f"{self.root}/manifest.new"), self._path(f"{self.root}/manifest.json"), option)
        return found

    def tables(self) -> dict[str, DataFrame]:
        """The current generation's tables."""
        now = self.manifest()
        return {name: self.spark.read.parquet(f"{self.root}/{now['folder']}/{name}") for name in now["tables"]} if now else {}

    @contextmanager
    def pin(self) -> Iterator[dict[str, DataFrame]]:
        """The current generation's tables, which no later publish changes and this store's janitor keeps until the end."""
        now = self.manifest()
        folder = now["folder"] if now else ""
        self.pinned[folder] += 1
        try:
            yield {name: self.spark.read.parquet(f"{self.root}/{folder}/{name}") for name in now["tables"]} if now else {}
        finally:
            self.pinned[folder] -= 1

    def dump(self) -> str:
        """The current generation as text: its number, and the rows of each table."""
        now = self.manifest()
        if not now:
            return "no generation"
        return "\n".join([f"generation {now['generation']}", *(f"{name}: {n} rows" for name, n in sorted(now["tables"].items()))])

    def janitor(self) -> list[str]:
        """Removes all generations but the current one and those that are pinned."""
        now, gone = self.manifest(), []
        if self.readonly:
            return gone
        for s in self._files.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("generation-") and now and name != now["folder"] and not self.pinned[name]:
                self._files.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def facts(self) -> DataFrame:
        """(table, rows) of the current generation."""
        now = self.manifest() or {"tables": {}}
        return self.spark.createDataFrame(sorted(now["tables"].items()), "table string, rows long")


def validate(postings: DataFrame, docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rule, broken): how many rows break each rule of a snapshot."""
    rules = {
        "span is not inverted": postings.where("pe < ps"),
        "document exists": postings.join(docs, "doc_ord", "left_anti"),
        "symbol exists": postings.join(symbols, "symbol_ord", "left_anti"),
        "symbol is unique": symbols.groupBy("semantic_symbol").agg(F.count("*").alias("n")).where("n > 1"),
        "document is unique": docs.groupBy("uri").agg(F.count("*").alias("n")).where("n > 1"),
        "one definition": postings.where("is_def").groupBy("symbol_ord").agg(F.count("*").alias("n")).where("n > 1"),
    }
    if "flags" in postings.columns:
        rules |= {"position is not negative": postings.where("ps < 0"), "flags are known": postings.where("flags < 0 or flags > 31"), "definitions are flagged": postings.where("is_def <> (flags % 2 = 1)")}
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, df in rules.items()))
