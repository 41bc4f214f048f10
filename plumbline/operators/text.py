"""Operators on lines and tokens: runs, regions, offsets, delta encoding, splices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block of a group; blocks, under 100 bytes each, that are broadcast at most: more are joined by a shuffle.
WIDTH, BROADCAST_BLOCKS = 1024, 200_000


def runs(lines: DataFrame, least: int) -> DataFrame:
    """Islands of consecutive lines (doc_id, line, kind) of one kind: (doc_id, kind, first_line, last_line)."""
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line"))
    grouped = lines.withColumn("island", island).groupBy("doc_id", "kind", "island").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n"))
    return grouped.where(F.col("n") >= least).drop("island", "n")


def line_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start): where each line starts, in characters."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).select("doc_id", F.col("line").cast("long").alias("line"), F.length("content").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "line", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("long").alias("start"))


def region_pairs(marks: DataFrame) -> DataFrame:
    """Markers (conv_id, turn, step of 1 or -1) paired as by a stack: (conv_id, open_turn, close_turn); unmatched ones are ignored.

    A closing marker on an empty stack does not count, so the level is the
    running sum less its lowest value so far; a pair is an opening marker and
    the next closing one at its level.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.withColumn("sum", F.sum("step").over(up_to))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(up_to))).withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("step") < 0, 1).otherwise(0))
    lost = (F.col("step") < 0) & (F.col("sum") < F.coalesce(F.lag("low").over(order), F.lit(0)))
    rows = rows.withColumn("lost", lost).where("not lost")
    at = Window.partitionBy("conv_id", "level").orderBy("turn")
    rows = rows.withColumn("before", F.lag("turn").over(at)).withColumn("opened", F.lag("step").over(at) == 1)
    return rows.where("step < 0 and opened").select("conv_id", F.col("before").alias("open_turn"), F.col("turn").alias("close_turn"), "level")


def delta_encode(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, line, start_char, length) with the distance to the one before; columns count from 0 on a new line."""
    order = Window.partitionBy("doc_id").orderBy("line", "start_char", "length")
    last_line, last_char = F.coalesce(F.lag("line").over(order), F.lit(0)), F.coalesce(F.lag("start_char").over(order), F.lit(0))
    rows = tokens.withColumn("delta_line", (F.col("line") - last_line).cast("int"))
    return rows.withColumn("delta_char", F.when(F.col("line") == last_line, F.col("start_char") - last_char).otherwise(F.col("start_char")).cast("int"))


def following(rows: DataFrame, group: str, order: str, value: str, parts: int) -> DataFrame:
    """The rows with ``next``: the value of the next row of the group by an integer; null at the end of a group, null numbers last.

    A group may be as large as the table, so it is taken in blocks of
    ``WIDTH`` numbers; the first row of a block stands at the end of the block
    before, too.  Only first numbers, one of each block, meet by group.
    """
    rows = rows.withColumn("#block", F.coalesce(F.floor(F.col(order) / WIDTH), F.lit((1 << 63) - 1)))
    firsts = rows.groupBy(group, "#block").agg(F.min(order).alias("#first"))
    firsts = firsts.withColumn("#before", F.lag("#block").over(Window.partitionBy(group).orderBy("#block"))).where(F.col("#before").isNotNull())
    firsts = firsts.select(F.col(group).alias("#group"), "#first", "#before")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_BLOCKS else firsts
    rows = rows.join(firsts, F.col(group).eqNullSafe(F.col("#group")) & F.col(order).eqNullSafe(F.col("#first")), "left").drop("#group", "#first")
    more = [c for c in rows.columns if c not in ("#block", "#before")]
    stands = F.array(F.struct(F.col("#block"), F.lit(True).alias("#own")), F.struct(F.col("#before").alias("#block"), F.lit(False).alias("#own")))
    rows = rows.select(*more, F.inline(F.filter(stands, lambda x: x["#block"].isNotNull())))
    at = Window.partitionBy(group, "#block").orderBy(F.asc_nulls_last(order), F.desc("#own"))
    return rows.repartition(parts, group, "#block").withColumn("next", F.lead(value).over(at)).where(F.col("#own")).drop("#block", "#own")


def splice(pairs: DataFrame) -> DataFrame:
    """One edit from list a to list b: (doc_id, start, removed, added) after the common prefix and before the common suffix; none if they are equal."""

    def same(x: str, y: str):
        """Length of the common prefix: elements until the first that differs."""
        first = F.array_position(F.zip_with(F.col(x), F.col(y), lambda p, q: ~p.eqNullSafe(q)), True)
        least = F.least(F.size(x), F.size(y))
        return F.when(first == 0, least).otherwise(F.least(first - 1, least)).cast("int")

    rows = pairs.where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("start", same("a", "b"))
    rest = lambda c: F.reverse(F.slice(c, F.col("start") + 1, F.size(c)))
    rows = rows.withColumn("ra", rest("a")).withColumn("rb", rest("b")).withColumn("tail", same("ra", "rb"))
    added = F.array_join(F.slice("b", F.col("start") + 1, F.size("b") - F.col("start") - F.col("tail")), " ")
    return rows.select("doc_id", "start", (F.size("a") - F.col("start") - F.col("tail")).cast("int").alias("removed"), added.alias("added"))


def tokens_in(tokens: DataFrame, start: tuple[int, int], stop: tuple[int, int]) -> DataFrame:
    """Tokens that overlap [start, stop) of (line, column) positions, whole."""
    before = (F.col("line") < stop[0]) | (F.col("line") == stop[0]) & (F.col("start_char") < stop[1])
    end = F.col("start_char") + F.col("length")
    after = (F.col("line") > start[0]) | (F.col("line") == start[0]) & (end > start[1])
    return tokens.where(before & after)
