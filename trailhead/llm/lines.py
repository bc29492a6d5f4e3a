"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without spaces at both ends, A-Z in lower case. Lines whose key is found in many documents
are boilerplate and lose all their occurrences. Key hashes are counted by document and those found often enough
are indexed: each shard of hashes gets a minimal perfect hash function, a cascade of bit arrays that gives every
key a number of its own, with which arrays of fingerprints and counts are read. Documents then look their lines
up in these arrays, which are sent to the executors; lines are never joined.

The arrays take about 25 bytes a key. If all shards together exceed `most_bytes`, they are sent in several
rounds of at most that many bytes, each with a pass over the documents, whose dropped lines are then put together
by document. Keys are 128-bit hashes: the first half places a key, the second is the fingerprint that is checked.

A null or empty text has one empty line. An empty line has no key and always stays. Repeated rows count as
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents, row_key, stage
from .textops import U64, chunks, mix

SPACES = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class LineSettings:
    min_documents: int = 10
    shard_keys: int = 1 << 18
    most_bytes: int = 256 << 20


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACES).lower() for line in text.split(b"\n")]


def key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in chunks(batches):
        pairs: list[tuple[int, int]] = []
        for i in range(len(texts)):
            pairs += [key_hash(x) for x in set(line_keys(texts.text(i))) if x]
        halves = np.array(pairs, U64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_pydict({"place": halves[:, 0], "print": halves[:, 1]})


def line_counts(docs: DataFrame) -> DataFrame:
    """Number of documents that hold each line key: place, print (the halves of its hash), n."""
    lines = documents(docs).select("text").mapInArrow(_distinct_lines, "place long, print long")
    return lines.groupBy("place", "print").agg(F.count("*").alias("n"))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys.

    Level i hashes the keys into an array of bits; a key alone on its bit is settled there, the others go on to
    the next level. A key's number is the rank of its bit among all set bits.
    """

    SPACE = 2

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            counts = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(n + np.concatenate(([0], counts)))
            n += int(counts[-1]) if len(counts) else 0
        self.n = n

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-len(keys) * cls.SPACE // 64) * 64
            bit = cls._bit(keys, len(levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(U64))
            keys = keys[~alone[bit]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key that was built in; any other key gets some number or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            bit = self._bit(keys[open_], level, len(bits) * 64)
            word, shift = bits[bit >> 6], (bit & 63).astype(U64)
            hit = (word >> shift) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << shift) - U64(1)))
            out[open_[hit]] = (ranks[bit >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


@dataclass
class Shard:
    function: PerfectHash
    prints: np.ndarray
    counts: np.ndarray

    def look_up(self, places: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 for keys that are not indexed."""
        if self.function.n == 0:
            return np.zeros(len(places), np.int64)
        at = self.function.number(places)
        return np.where((at >= 0) & (self.prints[at] == prints), self.counts[at], 0).astype(np.int64)


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    places = keys["place"].to_numpy(np.int64).view(U64)
    function = PerfectHash.build(np.unique(places))  # of keys that share the first half, one is kept
    at = function.number(places)
    prints, counts = np.zeros(function.n, np.int64), np.zeros(function.n, np.int64)
    prints[at], counts[at] = keys["print"], keys["n"]
    return pd.DataFrame(
        {
            "shard": [keys["shard"].iloc[0]],
            "levels": [[x.tobytes() for x in function.levels]],
            "prints": [prints.tobytes()],
            "counts": [counts.astype(np.int32).tobytes()],
            "bytes": [sum(x.nbytes * 2 for x in function.levels) + 12 * function.n],
        }
    )


def build_index(docs: DataFrame, settings: LineSettings) -> tuple[DataFrame, int]:
    """A row per shard with its arrays, and the number of shards. Shards hold the lines of `min_documents` or more."""
    often = stage(line_counts(docs).filter(F.col("n") >= settings.min_documents), "line-keys")
    shards = max(1, -(-often.count() // settings.shard_keys))
    index = (
        often.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(_build_shard, "shard int, levels array<binary>, prints binary, counts binary, bytes long")
    )
    return stage(index, "line-index"), shards


def _loaded(rows: list) -> dict[int, Shard]:
    return {
        x.shard: Shard(
            PerfectHash([np.frombuffer(bytes(y), U64) for y in x.levels]),
            np.frombuffer(bytes(x.prints), U64),
            np.frombuffer(bytes(x.counts), np.int32),
        )
        for x in rows
    }


def _dropped(text: bytes, index: dict[int, Shard], shards: int) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text, and which of them the index lists."""
    lines = text.split(b"\n")
    keys = line_keys(text)
    halves = np.array([key_hash(x) for x in keys], U64).reshape(-1, 2)
    shard_of = halves[:, 0].view(np.int64) % shards
    drop = np.zeros(len(lines), bool)
    for shard in np.unique(shard_of).tolist():
        if shard in index:
            here = shard_of == shard
            drop[here] = index[shard].look_up(halves[here, 0], halves[here, 1]) > 0
    return lines, drop & np.array([bool(x) for x in keys])


def _clean_pass(index, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = index
        for texts in chunks(batches):
            out: dict[str, list] = {"clean": [], "n_lines": [], "n_dropped": []}
            for i in range(len(texts)):
                lines, drop = _dropped(texts.text(i), loaded, shards)
                out["clean"].append(b"\n".join(x for x, gone in zip(lines, drop) if not gone))
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(int(drop.sum()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": texts.rows.column("doc"),
                    "clean": pa.array(out["clean"], pa.binary()).cast(pa.string()),
                    "n_lines": pa.array(out["n_lines"], pa.int64()),
                    "n_dropped": pa.array(out["n_dropped"], pa.int64()),
                }
            )

    return run


def _drops_pass(index, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = index
        for texts in chunks(batches):
            found = [np.flatnonzero(_dropped(texts.text(i), loaded, shards)[1]) for i in range(len(texts))]
            some = pa.array([len(x) > 0 for x in found])
            yield pa.RecordBatch.from_pydict(
                {"key": texts.rows.column("key"), "dropped": pa.array(found, pa.list_(pa.int64()))}
            ).filter(some)

    return run


def _apply_drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in chunks(batches):
        out: dict[str, list] = {"clean": [], "n_lines": [], "n_dropped": []}
        for i, dropped in enumerate(texts.rows.column("dropped").to_pylist()):
            lines, gone = texts.text(i).split(b"\n"), set(dropped or ())
            out["clean"].append(b"\n".join(x for j, x in enumerate(lines) if j not in gone))
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(gone))
        yield pa.RecordBatch.from_pydict(
            {
                "doc": texts.rows.column("doc"),
                "clean": pa.array(out["clean"], pa.binary()).cast(pa.string()),
                "n_lines": pa.array(out["n_lines"], pa.int64()),
                "n_dropped": pa.array(out["n_dropped"], pa.int64()),
            }
        )


def drop_common_lines(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """Per document: doc_id, clean (the text without its common lines), n_lines (before) and n_dropped."""
    docs = documents(docs)
    index, shards = build_index(docs, settings)
    sizes = index.select("shard", "bytes").orderBy("shard").collect()  # a row per shard
    rounds: list[list[int]] = [[]]
    room = settings.most_bytes
    for x in sizes:
        if rounds[-1] and x.bytes > room:
            rounds.append([])
            room = settings.most_bytes
        rounds[-1].append(x.shard)
        room -= x.bytes

    def sent(part: list[int]) -> dict[int, Shard]:
        return _loaded(index.filter(F.col("shard").isin(part)).collect()) if part else {}

    schema = "doc struct<doc_id: {}>, clean string, n_lines long, n_dropped long".format(docs.schema["doc_id"].dataType.simpleString())
    rows = docs.select(F.struct("doc_id").alias("doc"), row_key().alias("key"), "text")
    if len(rounds) == 1:
        cleaned = rows.drop("key").mapInArrow(_clean_pass(sent(rounds[0]), shards), schema)
    else:
        found = None
        for part in rounds:
            probe = _drops_pass(sent(part), shards)
            one = stage(rows.select("key", "text").mapInArrow(probe, "key long, dropped array<long>"), "line-drops")
            found = one if found is None else found.unionByName(one)
        lists = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("dropped"))).alias("dropped"))
        cleaned = rows.join(lists, "key", "left").select("doc", "text", "dropped").mapInArrow(_apply_drops, schema)
    return cleaned.select("doc.doc_id", "clean", "n_lines", "n_dropped")
