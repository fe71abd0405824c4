"""Running sums, counts and extremes of each key, in parallel within a key.

The rows of a key are cut into blocks of time. Blocks are aggregated, and what stands before a block is scanned among its
1,024 neighbours, those groups among their neighbours, and so on. Each block then starts from what was before it. No task holds more
of a key than one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAN = 10  # bits of a block's place in each level
SECONDS = 1 << 39  # years 1 to 9999 and some more, in seconds
HOW = {"sum": (F.sum, lambda x, y: F.coalesce(x + y, x, y)), "count": (F.count, lambda x, y: F.coalesce(x + y, x, y)), "max": (F.max, F.greatest), "min": (F.min, F.least)}
MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(rows: DataFrame, keys: list[str], time: str, order: list[str], values: dict[str, tuple[str, Column]], block: int = 86_400) -> DataFrame:
    """``rows`` with a column for each of ``values`` (name: how, of what; how is sum, count, max or min) over the rows of the same
    keys up to this one, in order of ``time`` and ``order``, which together should have no ties.

    ``block``: seconds of a block; where ``time`` is an integer, its values of a block. A null time comes first; null values don't count; a key may be null. Rows stay as often as
    they are there."""
    whole = dict(rows.dtypes)[time] in ("tinyint", "smallint", "int", "bigint")
    span = 1 << 64 if whole else SECONDS
    lift, bits = span // block // 2 + 1, (span // block).bit_length() + 1
    floor = F.expr(f"CAST(`{time}` AS BIGINT) div {block} - CAST(`{time}` % {block} < 0 AS INT)")
    place = floor if whole else F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(block * 1_000_000))
    at = F.coalesce(place + F.lit(lift), F.lit(0)).cast("long")
    kept = [f"__k{i}" for i in range(len(keys))]
    d = rows.withColumns({"__block": at, **{k: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("")) for k, c in zip(kept, keys, strict=True)}, **{f"__{n}": x for n, (_, x) in values.items()}})
    level = d.groupBy(*kept, "__block").agg(*(HOW[how][0](f"__{n}").alias(n) for n, (how, _) in values.items()))
    carry, shift = None, 0
    while True:
        upper = F.shiftright("__block", FAN)
        before = Window.partitionBy(*kept, "__upper").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        own = level.withColumn("__upper", upper).select(*kept, F.col("__block").alias("__at"), *(MERGE[how](n).over(before).alias(f"__b{n}") for n, (how, _) in values.items()))
        if carry is None:
            carry = own.withColumnRenamed("__at", "__block").select(*kept, "__block", *(F.col(f"__b{n}").alias(f"__c{n}") for n in values))
        else:
            joined = carry.withColumn("__at", F.shiftright("__block", shift)).join(own, [*kept, "__at"])
            carry = joined.select(*kept, "__block", *(HOW[how][1](F.col(f"__c{n}"), F.col(f"__b{n}")).alias(f"__c{n}") for n, (how, _) in values.items()))
        shift += FAN
        if shift >= bits:
            break
        level = level.groupBy(*kept, upper.alias("__block")).agg(*(MERGE[how](n).alias(n) for n, (how, _) in values.items()))
    inside = Window.partitionBy(*kept, "__block").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(carry, [*kept, "__block"])
    out = {n: HOW[how][1](F.col(f"__c{n}"), HOW[how][0](f"__{n}").over(inside)) for n, (how, _) in values.items()}
    return d.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def paged(rows: DataFrame, keys: list[str], at: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ordinal (from 1 within the keys, in order of ``at``, an integer, and ``order``) and page (from 1, of ``size`` rows)."""
    d = running(rows.withColumn("__one", F.lit(1)), keys, at, order, {"ordinal": ("count", F.col("__one"))}, block=1024).drop("__one")
    return d.withColumn("page", F.expr(f"(ordinal - 1) div {size} + 1"))


def levels(nodes: DataFrame, edges: DataFrame, written) -> DataFrame:
    """node and level of every row of ``nodes`` (node) in a graph of ``edges`` (node, needs): 0 without needs, else one more than the
    highest level among them. Nodes on a cycle, or behind one, have a null level. Edges to nodes that aren't there don't count.

    Peels one level a round: what needs nothing that is left goes. ``written`` keeps a round's result (see sources.snapshot), so rounds
    don't recompute each other; there are as many as the longest path."""
    left = written(nodes.select("node").distinct())
    e = written(edges.select("node", "needs").distinct().join(left, "node", "left_semi").join(left.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node", "needs"))
    done, level = [], 0
    while True:
        free = written(left.join(e.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done.append(free)
        left = written(left.join(free, "node", "left_anti").select("node"))
        e = written(e.join(free.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"))
        level += 1
    return reduce(DataFrame.unionByName, done, left.withColumn("level", F.lit(None).cast("int")))
