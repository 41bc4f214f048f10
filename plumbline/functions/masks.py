"""Flag words, unsafe-reason masks, checksums and code tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of an occurrence.
DEFINITION, EDITABLE, GENERATED, READONLY, SYNTHETIC = 1, 2, 4, 8, 16
# Reasons against a rename, in the order of their bits.
EXTERNAL, OF_GENERATED, OF_READONLY, OVERRIDE_FAMILY, SYNTHETIC_ONLY, PC_ONLY, DISAGREEMENT, UNSUPPORTED_FAMILY, OF_DEPENDENCY, OPAQUE_TYPE = (1 << k for k in range(10))
REASONS = {
    EXTERNAL: "symbol is defined outside the workspace",
    OF_GENERATED: "symbol has occurrences in generated sources",
    OF_READONLY: "symbol has occurrences in readonly sources",
    OVERRIDE_FAMILY: "symbol participates in an override family that cannot be renamed safely",
    SYNTHETIC_ONLY: "symbol only has synthetic occurrences",
    PC_ONLY: "symbol is provided by a PC-only plugin and is not present in fresh SemanticDB",
    DISAGREEMENT: "targets sharing this source disagree on the rename group",
    UNSUPPORTED_FAMILY: "symbol family (e.g. apply/unapply, exported symbol) is not safely renameable",
    OF_DEPENDENCY: "symbol has occurrences in dependency sources",
    OPAQUE_TYPE: "opaque type rename is not supported (conservative policy)",
}
# Build severities are the protocol's; anything else counts as information.
SEVERITIES = (1, 2, 3, 4)


def flag_word(is_def: Column, editable: Column, generated: Column, readonly: Column) -> Column:
    one = lambda c, bit: F.when(c, bit).otherwise(0)
    return one(is_def, DEFINITION) + one(editable, EDITABLE) + one(generated, GENERATED) + one(readonly, READONLY)


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def explain(mask: Column) -> Column:
    """The reasons in a mask, in the order of their bits."""
    table = F.array(*(F.struct(F.lit(b).cast("long").alias("bit"), F.lit(t).alias("text")) for b, t in REASONS.items()))
    return F.transform(F.filter(table, lambda r: mask.cast("long").bitwiseAND(r.bit) != 0), lambda r: r.text)


def severity(code: Column) -> Column:
    return F.when(code.isin(*SEVERITIES), code).otherwise(3)


def checksum(text: Column) -> Column:
    return F.upper(F.md5(text))


def freshness(text: Column, md5: Column) -> Column:
    """Fresh, MissingMd5 or Stale; case does not matter."""
    return F.when(md5.isNull() | (md5 == ""), "MissingMd5").when(checksum(text) == F.upper(md5), "Fresh").otherwise("Stale")


# Kind codes of the fact files, and the protocol's symbol kinds for them.
KINDS = {19: 13, 20: 13, 3: 6, 21: 9, 6: 6, 7: 5, 8: 13, 17: 13, 9: 26, 10: 19, 11: 4, 12: 19, 13: 5, 14: 11, 18: 11, 15: 8}
NO_KIND = 21


def protocol_kind(code: Column) -> Column:
    """The protocol's kind of a fact file's kind; unknown codes have none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[code], F.lit(NO_KIND))
