"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form a group that stays together. Groups, largest first, go into the shard whose
remaining room is the tightest that still holds them; shards are kept in a balanced tree by remaining room.

To run on many machines the packing has two steps. Groups above 1/`large_groups` of all bytes are packed by one
task; there are fewer than `large_groups` of them, however large the corpus is. The others are dealt to buckets
by hash. Each bucket gets its share of every shard's remaining room and packs its own groups into it.

A group that is larger than a shard cannot be kept together: it is divided into the fewest pieces that fit.
Null texts count 16 bytes and form one group, apart from empty texts. Repeated rows are separate documents of
one group. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents, stage

OVERHEAD = 16
GROUP = ["hash", "crc", "length", "piece"]


@dataclass(frozen=True)
class ShardSettings:
    """shards        number of shards; or None, and `capacity` (bytes) decides it
    large_groups    bound on the groups packed by one task (at least 50 for each shard, so that the others are
                    small beside a shard)
    bucket_groups   about how many of the other groups a bucket holds (at least 20 for each shard)
    slot_rows       about how many documents are numbered together
    """

    shards: int | None = 40
    capacity: int | None = None
    large_groups: int = 50_000
    bucket_groups: int = 50_000
    slot_rows: int = 1_000_000


class RoomTree:
    """Bins by remaining room, as a treap: a search tree on (room, bin) balanced by random priorities."""

    def __init__(self) -> None:
        self.random, self.root = random.Random(1), None

    def _split(self, node, key):
        """Into the nodes below `key` and the others. A node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, name: int) -> None:
        below, above = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(below, [(room, name), self.random.random(), None, None]), above)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove the bin with the least room that is at least `size`; without any, None."""
        below, above = self._split(self.root, (size, -1))
        if above is None:
            self.root = below
            return None
        first, path = above, None
        while first[2] is not None:
            path, first = first, first[2]
        if path is None:
            above = first[3]
        else:
            path[2] = first[3]
        self.root = self._merge(below, above)
        return first[0]

    def take_roomiest(self) -> tuple[int, int]:
        """Remove the bin with the most room."""
        last, path = self.root, None
        while last[3] is not None:
            path, last = last, last[3]
        if path is None:
            self.root = last[2]
        else:
            path[3] = last[2]
        return last[0]


def best_fit_decreasing(sizes: list[int], rooms: list[int], new_bin: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of each size (sizes must not increase), and the bins' remaining rooms.

    What fits nowhere opens a bin with room `new_bin`; without `new_bin` it goes into the bin with the most room.
    """
    rooms, tree, out = list(rooms), RoomTree(), []
    for name, room in enumerate(rooms):
        tree.add(room, name)
    for size in sizes:
        found = tree.take(size)
        if found is None and new_bin is not None:
            rooms.append(new_bin)
            found = (new_bin, len(rooms) - 1)
        elif found is None:
            found = tree.take_roomiest()
        room, name = found[0] - size, found[1]
        rooms[name] = room
        tree.add(room, name)
        out.append(name)
    return out, rooms


def _pack_buckets(rooms: list[int], capacity: int, small_bytes: int, may_open: bool):
    """Packs one bucket of small groups into its share of the shards' rooms."""
    positive = [max(0, x) for x in rooms]

    def pack(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", *GROUP], ascending=[False, *[True] * len(GROUP)])
        share = int(groups["bytes"].sum()) / max(1, small_bytes)
        if may_open:  # strictly within the share: what does not fit is left over
            own = [int(x * share) for x in positive] + [1 << 62]
        else:
            own = [round(x * share) for x in rooms]
        groups["shard"] = best_fit_decreasing(groups["bytes"].tolist(), own)[0]
        return groups[[*GROUP, "bytes", "shard"]]

    return pack


def _large_table(spark: SparkSession, large: list[Row], placed: list[int]) -> DataFrame:
    """The large groups with their shards. By way of Arrow: a list of tuples would start Python workers to read it."""
    kinds = [*[pa.int64()] * 3, *[pa.int32()] * 2]
    columns = [*[[x[name] for x in large] for name in GROUP], placed]
    table = pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds)], [*GROUP, "shard"])
    return spark.createDataFrame(table, "hash long, crc long, length long, piece int, shard int")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    return documents(docs).select(
        "doc_id",
        F.xxhash64("text").alias("hash"),
        F.crc32(text).alias("crc"),
        # A null text is told from an empty one by its length.
        F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("length"),
    )


def assign_shards(docs: DataFrame, settings: ShardSettings = ShardSettings()) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard and slot (place within its shard, from 0, without gaps)."""
    spark = docs.sparkSession
    rows = stage(_measured(docs), "shard-rows")
    size = F.greatest(F.col("length"), F.lit(0)) + OVERHEAD
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = settings.shards or max(1, -(-total // settings.capacity))
    capacity = settings.capacity if settings.shards is None else max(1, -(-total // shards))

    large_groups = max(settings.large_groups, 50 * shards)
    bucket_groups = max(settings.bucket_groups, 20 * shards)
    groups = rows.groupBy("hash", "crc", "length").agg((F.count("*") * F.first(size)).alias("bytes"))
    groups = stage(groups, "shard-groups")
    # Groups that no shard can hold: fewer than there are shards, as each is larger than total / shards.
    too_large = F.broadcast(
        groups.filter((F.col("bytes") > capacity) & (F.col("bytes") > F.col("length") + OVERHEAD))
        .withColumn("pieces", (F.col("bytes") / capacity).cast("long") + 1)
        .drop("bytes")
    )
    rows = rows.join(too_large, ["hash", "crc", "length"], "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int")
    )
    whole = groups.join(too_large, ["hash", "crc", "length"], "left_anti").withColumn("piece", F.lit(0))
    pieces = (
        rows.filter("pieces IS NOT NULL").groupBy(*GROUP).agg((F.count("*") * F.first(size)).alias("bytes"))
    )
    units = whole.select(*GROUP, "bytes").unionByName(pieces)

    is_large = F.col("bytes") * large_groups > total
    large = sorted(
        units.filter(is_large).select("bytes", *GROUP).collect(),  # fewer than large_groups rows
        key=lambda x: (-x.bytes, *x[1:]),
    )
    new_bin = capacity if settings.shards is None else None
    placed, rooms = best_fit_decreasing([x.bytes for x in large], [capacity] * shards, new_bin)
    large_shards = F.broadcast(_large_table(spark, large, placed))

    others = units.filter(~is_large)
    n_small, small_bytes = others.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-n_small // bucket_groups))
    packed = others.groupBy(F.pmod("hash", F.lit(buckets)).alias("bucket")).applyInPandas(
        _pack_buckets(rooms, capacity, small_bytes, new_bin is not None), "hash long, crc long, length long, piece int, bytes long, shard int"
    )
    if new_bin is not None:
        packed = stage(packed, "shard-packed")
        packed = _place_rest(packed, len(rooms), capacity)
    by_unit = (
        rows.join(large_shards, GROUP, "left")
        .filter("shard IS NULL")
        .drop("shard")
        .join(packed.select(*GROUP, "shard"), GROUP)
        .unionByName(rows.join(large_shards, GROUP))
    )
    return _with_slots(
        by_unit.select("doc_id", size.alias("size"), F.col("crc").alias("text_crc32"), "hash", "shard"), n, settings
    )


def _place_rest(packed: DataFrame, bins: int, capacity: int) -> DataFrame:
    """Give what fitted nowhere (shard = `bins`) new shards: by hash into enough of them, sized by the rest's bytes."""
    rest = F.col("shard") == bins
    left = packed.filter(rest).agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    more = -(-left[0] // max(1, capacity - left[1])) if left[0] else 0
    upto = F.sum("bytes").over(Window.partitionBy("part").orderBy("hash", "crc", "length", "piece"))
    parts = max(1, more)
    placed = packed.filter(rest).withColumn("part", F.pmod("hash", F.lit(parts))).withColumn("upto", upto)
    extra = placed.withColumn(
        "shard", (F.lit(bins) + F.col("part") + parts * ((F.col("upto") - 1) / capacity).cast("int")).cast("int")
    )
    return packed.filter(~rest).unionByName(extra.select(*packed.columns))


def _with_slots(rows: DataFrame, n: int, settings: ShardSettings) -> DataFrame:
    """Number the documents of each shard without bringing a shard into one task.

    Documents are dealt to parts by hash; a part's numbers start after those of the earlier parts of its shard.
    """
    parts = max(64, -(-n // settings.slot_rows))
    rows = stage(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(parts)).cast("int")), "shard-docs")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "part")
        .agg(F.count("*").alias("rows"))
        .withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .drop("rows")
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "hash", "size")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the documents, one folder per shard, in slot order. `doc_id` must identify a document."""
    assigned = assigned.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    (
        docs.select(F.struct("*").alias("doc"), "doc_id")
        .join(assigned, F.col("doc_id").eqNullSafe(F.col("_id")))
        .repartitionByRange("_shard", "_slot")
        .sortWithinPartitions("_shard", "_slot")
        .select("doc.*", F.col("_shard").alias("shard"))
        .write.partitionBy("shard")
        .parquet(path)
    )
