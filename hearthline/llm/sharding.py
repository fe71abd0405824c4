"""Sharding over fixed virtual slots.

Every record hashes into one of ``slots`` virtual slots; bytes are summed per slot; a versioned map says which shard
holds each slot. A rebalance or a new shard edits the map (a new version) and moves whole slots, never single records.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import shared_dir, table, text_only

MAP = T.StructType([T.StructField(n, t, False) for n, t in (("version", T.IntegerType()), ("vslot", T.IntegerType()), ("shard", T.IntegerType()), ("bytes", T.LongType()), ("rows", T.LongType()), ("first_slot", T.LongType()))])


def with_slots(docs: DataFrame, slots: int = 8192) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32 and vslot of each document.

    A null text has size 16 and the checksum of no bytes; a null doc_id hashes by its text. Repeated rows stay.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    return text_only(docs).select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(key, F.lit(slots)).cast("int").alias("vslot"))


def slot_stats(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; as many rows as slots at most."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _assign(stats: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for vslot, size, _ in sorted(stats, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[vslot] = shard
        heapq.heappush(heap, (total + size, shard))
    return out


def edited(slot_map: list[dict], stats: list[tuple[int, int, int]], shards: int) -> list[dict]:
    """The next version of a map: slots move one by one from the fullest shard to the emptiest while that evens them out.

    Slots that already have a shard below ``shards`` move only for that; a slot new to the map goes to the emptiest.
    """
    size = {v: b for v, b, _ in stats}
    shard_of = {m["vslot"]: m["shard"] for m in slot_map if m["vslot"] in size and m["shard"] < shards}
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for v, s in shard_of.items():
        held[s].append((size[v], v))
    total = [sum(b for b, _ in h) for h in held]
    for v in sorted((v for v in size if v not in shard_of), key=lambda v: (-size[v], v)):
        s = min(range(shards), key=lambda s: (total[s], s))
        shard_of[v], total[s] = s, total[s] + size[v]
        held[s].append((size[v], v))
    for _ in range(len(size)):
        full, least = max(range(shards), key=lambda s: (total[s], s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[full] - total[least]
        best = min((x for x in held[full] if 0 < 2 * x[0] <= gap), key=lambda x: (abs(gap - 2 * x[0]), x[1]), default=None)
        if best is None:
            break
        held[full].remove(best)
        held[least].append(best)
        total[full], total[least] = total[full] - best[0], total[least] + best[0]
        shard_of[best[1]] = least
    return _rows(max((m["version"] for m in slot_map), default=0) + 1, shard_of, stats)


def _rows(version: int, shard_of: dict[int, int], stats: list[tuple[int, int, int]]) -> list[dict]:
    """Map rows; first_slot: where the rows of a virtual slot start in their shard."""
    at: dict[int, int] = {}
    out = []
    for vslot, size, rows in sorted(stats):
        s = shard_of[vslot]
        out.append({"version": version, "vslot": vslot, "shard": s, "bytes": size, "rows": rows, "first_slot": at.get(s, 0)})
        at[s] = at.get(s, 0) + rows
    return out


def load_map(spark: SparkSession, path: str) -> list[dict]:
    """The newest version of the slot map stored below ``path``, one row a slot; none where there is no map yet."""
    try:
        stored = spark.read.schema(MAP).parquet(path)
        newest = stored.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r.asDict() for r in stored.filter(F.col("version") == newest).collect()] if newest is not None else []


def build_map(records: DataFrame, shards: int, path: str) -> DataFrame:
    """Writes the next version of the slot map to ``path``/version=N and returns it: the stored map edited, or the first one.

    Only the per-slot sums come to the driver: as many rows as there are virtual slots, whatever the corpus.
    """
    spark = records.sparkSession
    stats = [tuple(r) for r in slot_stats(records).select("vslot", "bytes", "rows").collect()]
    previous = load_map(spark, path)
    rows = edited(previous, stats, shards) if previous else _rows(1, _assign(stats, shards), stats)
    version = rows[0]["version"] if rows else 1
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version}")
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def shard(docs: DataFrame, shards: int = 40, slots: int = 8192, map_path: str | None = None) -> DataFrame:
    """Every document with its shard and its place there. ``map_path``: where the versions of the slot map are; a map that is stored
    there is edited, so that only whole slots move.

    Returns doc_id, size, text_crc32, law ("bytes"), shard (from 0), slot (place in the shard, gapless from 0),
    grown_shard (null under this law) and vslot. Empty input gives no rows; equal rows get places of their own.
    """
    records = with_slots(docs, slots)
    slot_map = build_map(records, shards, map_path or shared_dir(docs.sparkSession, "slot-map"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    held = F.broadcast(slot_map.select("vslot", "shard", "first_slot"))  # one row a slot: at most ``slots`` rows
    return records.withColumn("place", place).join(held, "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=40)
