"""The grammar of global symbols, by anchored patterns.

A symbol is a chain of descriptors: ``pkg/``, ``Type#``, ``term.``,
``method(+1).``, ``(parameter)`` and ``[TypeParameter]``; names with other
characters stand in back-ticks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"(?:`[^`]*`|[^/#.()\[\]`]+)"
_LAST = rf"^(.*?)(?:({NAME})(/|#|\([^()]*\)\.|\.)|\(({NAME})\)|\[({NAME})\])$"
EACH = rf"{NAME}(?:/|#|\([^()]*\)\.|\.)|\({NAME}\)|\[{NAME}\]"
# Words and marks that are no plain identifiers.
KEYWORDS = """abstract case catch class def do else enum export extends false final finally for given if implicit import lazy match new null object override
package private protected return sealed super then this throw trait true try type val var while with yield _ : = <- => <: >: # @ =>> ?=>""".split()
# A constructor's name, and the packages that have none.
CONSTRUCTOR, NO_PACKAGES = "<init>", ("_root_", "_empty_")
_OPERATOR = r"[!#%&*+\-/:<=>?@\\^|~]"
_PLAIN = rf"^(?:{_OPERATOR}+|[\p{{IsAlphabetic}}_$](?:[\p{{IsAlphabetic}}\p{{N}}_$]*|[\p{{IsAlphabetic}}\p{{N}}_$]*(?<=_){_OPERATOR}+|(?<=_){_OPERATOR}+))$"


def is_local(s: Column) -> Column:
    return F.rlike(s, F.lit(r"^local[^/.#()\[\]`]+$"))


def is_global(s: Column) -> Column:
    return (s != "") & ~is_local(s)


def is_package(s: Column) -> Column:
    return F.endswith(s, F.lit("/"))


def split_last(s: Column) -> Column:
    """(owner, kind, name, disambiguator); null for local and malformed symbols."""
    part = lambda n: F.regexp_extract(s, _LAST, n)
    end, name = part(3), F.coalesce(*(F.nullif(part(n), F.lit("")) for n in (2, 4, 5)))
    kind = F.when(end == "/", "package").when(end == "#", "type").when(end == ".", "term").when(end != "", "method").when(part(4) != "", "parameter").otherwise("type_parameter")
    more = F.when(F.length(end) > 1, F.substring(end, 1, F.length(end) - 1))
    found = F.struct(part(1).alias("owner"), kind.alias("kind"), F.regexp_replace(name, "^`|`$", "").alias("name"), more.alias("disambiguator"))
    return F.when(~is_local(s) & F.rlike(s, F.lit(_LAST)), found)


def owner_chain(s: Column) -> Column:
    """All owners from the outermost, the symbol itself last."""
    parts = F.regexp_extract_all(s, F.lit(EACH), F.lit(0))
    return F.when(is_local(s) | (F.size(parts) == 0), F.array().cast("array<string>")).otherwise(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "")))


def companion(s: Column) -> Column:
    """Type to term of the same name and back; null for others."""
    stem = F.substring(s, 1, F.length(s) - 1)
    kind = split_last(s)["kind"]
    return F.when(kind == "type", F.concat(stem, F.lit("."))).when(kind == "term", F.concat(stem, F.lit("#")))


def _around(s: Column) -> Column:
    """The owners of a symbol from the outermost."""
    chain = owner_chain(s)
    return F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0)))


def package_name(s: Column) -> Column:
    """Dotted packages around a symbol; null where none has a name of its own."""
    names = F.transform(F.filter(_around(s), is_package), lambda o: split_last(o)["name"])
    return F.nullif(F.array_join(F.filter(names, lambda n: ~n.isin(*NO_PACKAGES)), "."), F.lit(""))


def owner_name(s: Column) -> Column:
    """Name of the nearest owner that is no package; null for what sits in a package, and for locals."""
    return split_last(F.try_element_at(F.filter(_around(s), lambda o: ~is_package(o)), F.lit(-1)))["name"]


def enclosing_top_level(s: Column) -> Column:
    """The outermost symbol of the chain that is no package, the symbol itself included."""
    return F.get(F.filter(owner_chain(s), lambda o: ~is_package(o)), F.lit(0))


def is_companion_pair(a: Column, b: Column) -> Column:
    return F.coalesce(companion(a) == b, F.lit(False))


def is_constructor(s: Column) -> Column:
    last = split_last(s)
    return F.coalesce((last["kind"] == "method") & (last["name"] == CONSTRUCTOR), F.lit(False))


def setter_target(s: Column) -> Column:
    """x of a setter x_=; null for others."""
    last = split_last(s)
    return F.when((last["kind"] == "method") & F.rlike(last["name"], F.lit("(?s)^.+_=$")), F.regexp_replace(last["name"], "_=$", ""))


def is_setter(s: Column) -> Column:
    return setter_target(s).isNotNull()


def descriptor_split(s: Column) -> Column:
    """(owner, suffix): the last descriptor as it is written; null for local and malformed symbols."""
    owner = split_last(s)["owner"]
    return F.when(owner.isNotNull(), F.struct(owner.alias("owner"), F.substring(s, F.length(owner) + 1, F.length(s)).alias("suffix")))


def encode_name(name: Column) -> Column:
    """In back-ticks unless it is a plain identifier."""
    return F.when(F.rlike(name, F.lit(r"^[\p{IsAlphabetic}_$][\p{IsAlphabetic}\p{N}_$]*$")), name).otherwise(F.concat(F.lit("`"), name, F.lit("`")))


def is_plain_identifier(name: Column) -> Column:
    """Letters, digits, ``_`` and ``$`` from a letter on, with operator characters behind a last ``_``; or operator characters alone."""
    return F.rlike(name, F.lit(_PLAIN))


def rename_token(name: Column) -> Column:
    """What a new name is written as; null if no token can hold it."""
    plain = is_plain_identifier(name) & ~name.isin(*KEYWORDS)
    return F.when(plain, name).when((name != "") & ~F.rlike(name, F.lit(r"[`\r\n]")), F.concat(F.lit("`"), name, F.lit("`")))


def local_key(s: Column, doc: Column) -> Column:
    """local0 in document 42 is local0@42; global symbols stay."""
    return F.when(is_local(s), F.concat(s, F.lit("@"), doc.cast("string"))).otherwise(s)


def decode_key(key: Column) -> Column:
    """(symbol, doc) of a local's key; other keys are symbols, without a document."""
    pattern = r"^(local[^@]*)@\+?([0-9]+)$"
    doc = F.regexp_extract(key, pattern, 2).try_cast("decimal(20,0)")
    whole = F.rlike(key, F.lit(pattern)) & (doc <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"))
    return F.struct(F.when(whole, F.regexp_extract(key, pattern, 1)).otherwise(key).alias("symbol"), F.when(whole, doc).alias("doc"))
