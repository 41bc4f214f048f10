"""Build-server tables to targets, sources and dependencies.

The build server's answers are input tables; talking to it is not a task for
Spark.  targets: (uri, language_ids, scala_version, deps); sources: (target,
uri, directory); options: (target, options, class_directory).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.uris import normalize_path, uri_to_path

# Compiler flags.
ENABLE, TARGET, SOURCE = ("-Xsemanticdb", "-Ysemanticdb"), "-semanticdb-target", "-sourceroot"


def connections(spark: SparkSession, root: str) -> DataFrame:
    """(file, name, argv, error) of connection files, valid ones by name first; a broken file is a row with its error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/.bsp")
    text = F.decode("content", "UTF-8")
    found = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.from_json(text, "name string, argv array<string>").alias("j"))
    name, argv = F.col("j.name"), F.col("j.argv")
    error = F.when(name.isNull() & argv.isNull(), "malformed JSON").when(F.coalesce(name, F.lit("")) == "", "missing required field 'name'").when(argv.isNull() | (F.size(argv) == 0), "missing required field 'argv'")
    return found.select("file", name.alias("name"), argv.alias("argv"), error.alias("error")).orderBy(F.col("error").isNotNull(), "name", "file")


def last_value(options: Column, flag: str) -> Column:
    """The last value of a flag, as ``-flag:value`` or ``-flag value``; a value is not read as a flag itself."""
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("next"))

    def step(s: Column, o: Column) -> Column:
        inline = F.startswith(o, F.lit(f"{flag}:")) & (F.length(o) > len(flag) + 1)
        value = F.when(s.next, o).when(inline, F.substring(o, F.lit(len(flag) + 2), F.length(o))).otherwise(s.value)
        return F.struct(value.alias("value"), (~s.next & (o == flag)).alias("next"))

    return F.aggregate(options, start, step, lambda s: s.value)


def fact_roots(options: DataFrame, workspace: str) -> DataFrame:
    """(target, semanticdb_root, sourceroot): the root is null where facts are off."""
    place = lambda v: normalize_path(F.when(F.startswith(v, F.lit("/")), v).otherwise(F.concat(F.lit(f"{workspace}/"), v)))
    on = F.exists("options", lambda o: o.isin(*ENABLE))
    root = F.when(on, F.coalesce(place(last_value(F.col("options"), TARGET)), F.col("class_directory")))
    return options.select("target", root.alias("semanticdb_root"), F.coalesce(place(last_value(F.col("options"), SOURCE)), F.lit(workspace)).alias("sourceroot"))


def load(targets: DataFrame, options: DataFrame, workspace: str) -> DataFrame:
    """(bsp_id, scala_version, semanticdb_root, sourceroot, direct_deps, indexable) of targets of the language's third version."""
    third = (F.col("scala_version") == "3") | F.startswith("scala_version", F.lit("3."))
    rows = targets.where(F.array_contains("language_ids", "scala") & third)
    answered = fact_roots(options, workspace).withColumnRenamed("target", "uri").withColumn("answered", F.lit(True))
    rows = rows.join(answered, "uri", "left")
    # A build server answers for every target: one without options is a fault of the project, not a target without facts.
    lost = F.raise_error(F.concat(F.lit("no options for target "), F.coalesce("uri", F.lit("null"))))
    rows = rows.withColumn("sourceroot", F.when(F.col("answered").isNull(), lost.cast("string")).otherwise(F.col("sourceroot")))
    ready = F.col("semanticdb_root").isNotNull() & F.col("sourceroot").isNotNull()
    return rows.select(F.col("uri").alias("bsp_id"), "scala_version", "semanticdb_root", "sourceroot", F.col("deps").alias("direct_deps"), ready.alias("indexable"))


def dependency_edges(model: DataFrame) -> DataFrame:
    """(target, dep) inside the model."""
    known = model.select(F.col("bsp_id").alias("dep"))
    return model.select(F.col("bsp_id").alias("target"), F.explode("direct_deps").alias("dep")).join(known, "dep", "left_semi").select("target", "dep")


def expand_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(target, path), distinct: source files, and the files of listed directories; files: (path)."""
    rows = sources.select("target", "directory", uri_to_path(F.col("uri")).alias("at")).where("at is not null")
    own = rows.where(~F.col("directory") & F.endswith("at", F.lit(".scala"))).select("target", F.col("at").alias("path"))
    # A file lies in each directory of its path: an equi join on the directories.
    parts = F.split("path", "/")
    ways = files.where(F.endswith("path", F.lit(".scala"))).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("at"))
    below = rows.where("directory").select("target", F.regexp_replace("at", "/$", "").alias("at")).join(ways, "at").select("target", "path")
    return own.union(below).distinct()


def owner_of(expanded: DataFrame, order: DataFrame) -> DataFrame:
    """(path, target): the first target in workspace order; order: (target, n)."""
    return expanded.join(order, "target").groupBy("path").agg(F.min_by("target", F.struct("n", "target")).alias("target"))
