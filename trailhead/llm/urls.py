"""URL filters by a Bloom filter cascade.

A list of rules (host, path prefix, allow or block) is applied to all URLs. Every URL has a bounded number of keys
that could be a rule: each suffix of its host with each prefix of its path whose length occurs in the list. The
distinct keys of the whole corpus are the universe. A cascade tells exactly which keys of the universe are listed:
level 1 is a Bloom filter of the listed keys; level 2 holds the universe's keys that level 1 passes wrongly; level 3
the listed keys that level 2 passes; and so on, until a level passes nothing wrongly. URLs are judged with the
cascades of both lists, without a join.

A cascade takes a few bytes for each listed key that occurs in the corpus. If it would exceed `most_bytes`, the keys of
the URLs are joined with the list by shuffle instead, with the same result.

A null URL or one without `://` has an empty host and path. A key in both lists is blocked. Repeated rows get equal
verdicts; an empty table gives an empty result, and an empty list leaves all to `default`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import BITS_PER_BITMAP, stage
from .textops import U64, mix

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP_BYTES = BITS_PER_BITMAP // 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlSettings:
    default: str = "allow"
    bits_per_key: int = 8
    n_hashes: int = 4
    most_bytes: int = 64 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass(frozen=True)
class Shape:
    """What keys a URL can have: path lengths in the list (characters), and the most labels of a listed host."""

    lengths: tuple[int, ...]
    labels: int

    def keys(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.labels), len(labels))]
        return [x + path[:n] for x in hosts for n in self.lengths if n <= len(path)]


def halves(keys: list[str]) -> np.ndarray:
    """128-bit hashes as two columns."""
    found = [xxhash.xxh3_128_intdigest(x) for x in keys]
    return np.array([(x >> 64, x & 0xFFFFFFFFFFFFFFFF) for x in found], U64).reshape(-1, 2)


def places(keys: np.ndarray, level: int, n_hashes: int, size: int) -> np.ndarray:
    """Bits of each key in a filter of `size` bits; other levels use other hashes."""
    first = mix(keys[:, 0] + U64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
    second = mix(keys[:, 1] ^ U64(level)) | U64(1)
    steps = np.arange(n_hashes, dtype=U64)
    return ((first[:, None] + steps * second[:, None]) % U64(size)).astype(np.int64)


@dataclass
class Level:
    bits: np.ndarray
    n_hashes: int

    def passes(self, keys: np.ndarray, level: int) -> np.ndarray:
        at = places(keys, level, self.n_hashes, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def listed(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is in the list the cascade was built from."""
    out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for i, level in enumerate(levels):
        hit = level.passes(keys[open_], i)
        # Not passing an odd level means unlisted, not passing an even one means listed.
        out[open_[~hit]] = i % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def _bitmaps(level: int, n_hashes: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy().view(U64) for x in ("high", "low")], axis=1)
            at = places(keys, level, n_hashes, size).ravel()
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = bits.reshape(-1, BITMAP_BYTES)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(used, pa.int64()), "bitmap": pa.array([parts[x].tobytes() for x in used], pa.binary())}
        )

    return run


def build_level(keys: DataFrame, n: int, level: int, settings: UrlSettings) -> Level:
    size = -(-n * settings.bits_per_key // BITS_PER_BITMAP) * BITS_PER_BITMAP
    maps = (
        keys.select("high", "low")
        .mapInArrow(_bitmaps(level, settings.n_hashes, size), "part long, bitmap binary")
        .groupBy("part")
        .agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        .collect()  # at most `most_bytes` in all
    )
    bits = np.zeros((size // BITS_PER_BITMAP, BITMAP_BYTES), np.uint8)
    for part, bitmap in maps:
        bits[part] = np.frombuffer(bytes(bitmap), np.uint8)
    return Level(bits.ravel(), settings.n_hashes)


def _passing(level: Level, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy().view(U64) for x in ("high", "low")], axis=1)
            yield batch.filter(pa.array(level.passes(keys, number)))

    return run


def build_cascade(universe: DataFrame, keys: DataFrame, settings: UrlSettings) -> list[Level] | None:
    """Levels that tell the listed `keys` from all other keys of the universe; None if they would be too large.

    Both tables have columns high and low. Only building joins, and only what level 1 passes.
    """
    inside = stage(universe.join(keys, ["high", "low"], "left_semi"), "url-listed")
    levels: list[Level] = []
    current, other = inside, None
    room = settings.most_bytes
    while n := current.count():
        room -= -(-n * settings.bits_per_key // BITS_PER_BITMAP) * BITMAP_BYTES
        if room < 0:
            return None
        levels.append(build_level(current, n, len(levels), settings))
        wrongly = _passing(levels[-1], len(levels) - 1)
        if other is None:
            passed = universe.mapInArrow(wrongly, universe.schema).join(inside, ["high", "low"], "left_anti")
        else:
            passed = other.mapInArrow(wrongly, universe.schema)
        current, other = stage(passed.select("high", "low"), "url-passed"), current
    return levels


def _keys(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[str] = set()
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                seen.update(shape.keys(host, path))
            found = halves(list(seen)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"high": found[:, 0], "low": found[:, 1]})

    return run


def _judge(shape: Shape, cascades: dict[str, list[Level]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                shape.keys(host, path)
                for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            ]
            flat = [x for keys in rows for x in keys]
            found = halves(flat)
            hits = {verdict: listed(levels, found) for verdict, levels in cascades.items()}
            rules, verdicts, at = [], [], 0
            for keys in rows:
                # The longest key; of one in both lists, the blocking side.
                best = max(
                    ((len(x), verdict == "block", x, verdict) for i, x in enumerate(keys) for verdict in hits if hits[verdict][at + i]),
                    default=(0, False, None, None),
                )
                rules.append(best[2])
                verdicts.append(best[3])
                at += len(keys)
            yield pa.RecordBatch.from_pydict(
                {
                    "page": batch.column("page"),
                    "host": batch.column("host"),
                    "path": batch.column("path"),
                    "rule": pa.array(rules, pa.string()),
                    "verdict": pa.array(verdicts, pa.string()),
                }
            )

    return run


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(x.verdict, x.host, x.path) for x in rules], "verdict string, host string, path string"
    )


def judge_urls(pages: DataFrame, rules: DataFrame, settings: UrlSettings = UrlSettings(), key: str = "page_id") -> DataFrame:
    """Per page: its key column, host, path, rule (the longest that fits, else null) and verdict.

    `rules` has columns verdict (allow or block), host and path. A rule fits its host and all subdomains, if the
    path starts with the rule's.
    """
    spark = pages.sparkSession
    rules = stage(rules.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path")).distinct(), "url-rules")
    lengths = [x[0] for x in rules.select(F.length("path")).distinct().orderBy(F.length("path")).collect()]
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    shape = Shape(tuple(lengths), labels)
    parsed = pages.select(F.struct(key).alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = parsed.select("host", "path").distinct().mapInArrow(_keys(shape), "high long, low long").distinct()
    universe = stage(universe, "url-universe")
    cascades: dict[str, list[Level]] | None = {}
    for verdict in ("allow", "block"):
        keys = rules.filter(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key"))
        hashed = keys.mapInArrow(_hash_keys, "high long, low long")
        levels = build_cascade(universe, hashed, settings)
        if levels is None:
            cascades = None
            break
        cascades[verdict] = levels
    if cascades is None:
        judged = _judge_by_join(parsed, rules, shape)
    else:
        page = parsed.schema["page"].dataType.simpleString()
        judged = parsed.mapInArrow(
            _judge(shape, cascades), f"page {page}, host string, path string, rule string, verdict string"
        )
    return judged.select("page.*", "host", "path", "rule", F.coalesce("verdict", F.lit(settings.default)).alias("verdict"))


def _hash_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = halves(batch.column("key").to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_pydict({"high": found[:, 0], "low": found[:, 1]})


def _judge_by_join(parsed: DataFrame, rules: DataFrame, shape: Shape) -> DataFrame:
    """The same verdicts for lists too large for a cascade: distinct (host, path) pairs are joined with the list."""
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(0), F.size(labels) - shape.labels)
    hosts = F.transform(
        F.sequence(first, F.size(labels) - 1),
        lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in shape.lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    longest = F.max(F.struct(F.length("key"), F.col("verdict") == "block", "key", "verdict"))
    urls = parsed.select("host", "path").distinct()
    found = (
        urls.withColumn("rule_host", F.explode(hosts))
        .withColumn("rule_path", F.explode(prefixes))
        .join(
            rules.select("verdict", F.concat("host", "path").alias("key")),
            F.concat("rule_host", "rule_path") == F.col("key"),
        )
        .groupBy("host", "path")
        .agg(longest.alias("best"))
    )
    return parsed.join(found, ["host", "path"], "left").select(
        "page", "host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("verdict")
    )
