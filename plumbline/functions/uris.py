"""File uris and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GOOD = r"^(?:[^%]|%[0-9A-Fa-f]{2})*$"


def normalize_path(path: Column) -> Column:
    """Without ``.``, ``..`` and empty parts; the file system is not asked."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def path_to_uri(path: Column) -> Column:
    """Percent-codes every byte but letters, digits and ``-._~/``."""
    coded = F.regexp_replace(F.url_encode(path), r"\+", "%20")
    for a, b in (("%2F", "/"), ("%7E", "~"), (r"\*", "%2A")):
        coded = F.regexp_replace(coded, a, b)
    return F.concat(F.lit("file://"), coded)


def uri_to_path(uri: Column) -> Column:
    """Null unless it is a file uri with a path, no authority, and whole percent codes."""
    path = F.coalesce(F.nullif(F.regexp_extract(uri, "^file://(/.*)$", 1), F.lit("")), F.nullif(F.regexp_extract(uri, "^file:(/(?!/).*)$", 1), F.lit("")), F.when(uri == "file:/", "/"))
    return F.when(F.rlike(path, F.lit(_GOOD)), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def normalize_uri(uri: Column) -> Column:
    """One spelling for one path; what is no file uri stays."""
    return F.coalesce(path_to_uri(normalize_path(uri_to_path(uri))), uri)


SUFFIX = ".semanticdb"


def fact_file(root: Column, source: Column) -> Column:
    """The fact file of a source path below a root; null for empty and absolute paths and those that lead out of the root."""
    clean, path = normalize_path(root), normalize_path(F.concat_ws("/", root, F.concat(source, F.lit(SUFFIX))))
    return F.when((source != "") & ~F.startswith(source, F.lit("/")) & contains(clean, path), path)


def source_of(root: Column, file: Column) -> Column:
    """The source path of a fact file; null if it does not lie below the root or has another suffix."""
    clean, path = normalize_path(root), normalize_path(file)
    rest = F.substring(path, F.length(clean) + 2, F.length(path))
    return F.when(contains(clean, path) & (path != clean) & F.endswith(rest, F.lit(SUFFIX)) & (F.length(rest) > len(SUFFIX)), F.substring(rest, F.lit(1), F.length(rest) - len(SUFFIX)))


def contains(root: Column, path: Column) -> Column:
    """Is the path the root or below it?"""
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))
