"""Removal of long repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a `length`-byte string that also starts somewhere else, in this or any other document. The
suffixes of all documents are ranked by prefixes of growing length: Spark sorts (rank, next block) pairs, equal pairs
share a new rank, and a position whose rank is unique is dropped, until the prefixes are long enough.

Not every position has to be ranked. In any `length`-byte string, the smallest 16-gram hash among its first `window`
positions marks an anchor, found from those bytes alone, so the string has its anchor at the same offset
wherever it occurs. Only anchors are ranked, by the length - window bytes that follow them. For an anchor with a rank
that is not unique, what surrounds it (window - 1 bytes before, `length` after) decides:

* if the whole surroundings occur twice, every string around the anchor repeats;
* else the strings at each offset are compared among the anchors of the rank. All of them contain the anchor, so the
  bytes to remove around an anchor are one interval. A rank's distinct surroundings meet in one task up to
  `rank_contexts` of them, and are otherwise spread out as one row for each string.

A text that makes up more than 1/`hot_texts` of all rows is ranked once and removed as a whole.
Hashes have 64 bits (see textops). Null texts are empty. Repeated rows repeat each other. Documents are
identified by id and text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import documents, row_key, small, stage
from .textops import BYTE_CODES, STEP, U64, Texts, chunks, mix, span_hashes

GRAM = 16
PIECE = 1 << 22
LOW_BITS = U64((1 << 24) - 1)
HAS_TWIN, SETTLED = 1, 2


@dataclass(frozen=True)
class RepeatSettings:
    length: int = 400
    window: int = 200
    hot_texts: int = 1_000
    hot_least: int = 100
    rank_contexts: int = 100_000
    batch_contexts: int = 20_000

    @property
    def after(self) -> int:
        """Bytes from an anchor on that are in every string of that anchor."""
        return self.length - self.window


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from running minima of blocks in both directions."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, np.iinfo(U64).max, U64)]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(texts: Texts, prefix: np.ndarray, settings: RepeatSettings) -> np.ndarray:
    """Places of the anchors of all `length`-byte strings, sorted."""
    n, width = len(texts.data), settings.window
    if n < settings.length:
        return np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(texts.bounds))
    found = []
    last = n - settings.length + 1
    for at in range(0, last, PIECE):
        to = min(at + PIECE, last)
        starts = np.arange(at, to + width - 1)
        grams = span_hashes(prefix, starts, starts + GRAM)
        # Of equal hashes the last one counts.
        keys = (grams & ~LOW_BITS) | (LOW_BITS - (starts - at).astype(U64))
        least = _sliding_least(keys, width)
        inside = text_of[at:to] == text_of[at + settings.length - 1 : to + settings.length - 1]
        found.append(at + np.unique(LOW_BITS - (least[inside] & LOW_BITS)).astype(np.int64))
    return np.unique(np.concatenate(found))


def _ranked_anchors(settings: RepeatSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = settings.after // 4, settings.after // 2
        for texts in chunks(batches):
            prefix = texts.prefix_hashes()
            at = anchors(texts, prefix, settings)
            text_of = np.searchsorted(texts.bounds, at, "right") - 1
            begin, end = texts.bounds[text_of], texts.bounds[text_of + 1]
            low, high = np.maximum(begin, at - settings.window + 1), np.minimum(end, at + settings.length)
            half = [span_hashes(prefix, at + a, at + b) >> U64(32) for a, b in ((first, second), (second, settings.after))]
            around = mix(span_hashes(prefix, low, high) + (at - low).astype(U64) * STEP)
            rank, rest = span_hashes(prefix, at, at + first), (half[0] << U64(32)) | half[1]
            # Of equal surroundings within these texts one goes on with its rank. The others are settled: they get a
            # rank of their own, so that text repeated over and over does not meet in one task.
            _, one, of, n = np.unique(mix(mix(rank + rest * STEP) + around), return_index=True, return_inverse=True, return_counts=True)
            copies = np.where(n[of] > 1, SETTLED, 0)
            copies[one[n > 1]] = HAS_TWIN
            own = mix(texts.rows.column("key").to_numpy().view(U64)[text_of] * STEP + at.astype(U64))
            yield pa.RecordBatch.from_pydict(
                {
                    "rank": np.where(copies == SETTLED, own, rank).view(np.int64),
                    "rest": rest.view(np.int64),
                    "around": around.view(np.int64),
                    "copies": copies,
                    "key": texts.rows.column("key").take(pa.array(text_of)),
                    "position": at - begin,
                    "length": end - begin,
                }
            )

    return run


def _not_unique(rows: DataFrame, rank: list[str]) -> DataFrame:
    """Sort by rank and drop the rows that have one of their own, unless they are known to repeat."""
    by_rank = Window.partitionBy(*rank).orderBy("key", "position")
    return (
        rows.withColumns({"before": F.lag("position").over(by_rank), "after": F.lead("position").over(by_rank)})
        .filter("before IS NOT NULL OR after IS NOT NULL OR copies > 0")
        .drop("before", "after")
    )


def repeated_anchors(rows: DataFrame, settings: RepeatSettings) -> DataFrame:
    """Anchors whose following bytes occur at another anchor too.

    Columns: rank, key, position, length (of the text), twin (the whole surroundings repeat), first (of those with
    equal surroundings) and mixed (the rank has different surroundings, some without a twin).
    """
    ranked = rows.mapInArrow(
        _ranked_anchors(settings), "rank long, rest long, around long, copies long, key long, position long, length long"
    )
    # Each round doubles the prefix: the rank so far and the next block. The new rank is the pair itself, so all
    # rounds work on the partitions of the first.
    ranked = _not_unique(ranked, ["rank"])
    ranked = _not_unique(ranked.withColumn("block1", F.shiftrightunsigned("rest", 32)), ["rank", "block1"])
    ranked = _not_unique(
        ranked.withColumn("block2", F.col("rest").bitwiseAND(0xFFFFFFFF)), ["rank", "block1", "block2"]
    )
    full = ["rank", "block1", "block2"]
    same = Window.partitionBy(*full, "around").orderBy("key", "position")
    of_rank = Window.partitionBy(*full)
    flagged = ranked.withColumns(
        {"earlier": F.lag("position").over(same).isNotNull(), "later": F.lead("position").over(same).isNotNull()}
    ).withColumn("twin", F.col("earlier") | F.col("later") | (F.col("copies") > 0))
    flagged = flagged.withColumns(
        {
            "low": F.min("around").over(of_rank),
            "high": F.max("around").over(of_rank),
            "all_twins": F.min("twin").over(of_rank),
        }
    )
    return flagged.select(
        F.xxhash64(*full).alias("rank"),
        "key",
        "position",
        "length",
        "twin",
        (~F.col("earlier")).alias("first"),
        ((F.col("low") != F.col("high")) & ~F.col("all_twins")).alias("mixed"),
    )


def _surroundings(settings: RepeatSettings):
    """The bytes around listed anchors: `left` (nearest first) and `right` (behind the ranked ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches):
            out: dict[str, list] = {x: [] for x in ("rank", "key", "position", "twin", "left", "right")}
            keys = texts.rows.column("key").to_pylist()
            for i, listed in enumerate(texts.rows.column("anchors").to_pylist()):
                text = texts.text(i)
                for x in listed:
                    at = x["position"]
                    out["rank"].append(x["rank"])
                    out["key"].append(keys[i])
                    out["position"].append(at)
                    out["twin"].append(x["twin"])
                    out["left"].append(text[max(0, at - settings.window + 1) : at][::-1])
                    out["right"].append(text[at + settings.after : at + settings.length])
            types = {"twin": pa.bool_(), "left": pa.binary(), "right": pa.binary()}
            yield pa.RecordBatch.from_pydict({x: pa.array(y, types.get(x, pa.int64())) for x, y in out.items()})

    return run


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes of each value in a row of `width`, zeros behind its end; and the lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)] = data[offsets[0] : offsets[-1]]
    return out, lengths


def string_hashes(rows: pa.RecordBatch, settings: RepeatSettings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset o: which rows have a string that starts o bytes before the anchor, and its hash with the rank."""
    width = settings.window
    left, n_left = _padded(rows.column("left"), width)
    right, n_right = _padded(rows.column("right"), width)
    power = np.cumprod(np.full(width + 1, 0x9E3779B97F4A7C15, U64), dtype=U64)
    before, behind = np.zeros(len(rows), U64), np.zeros(len(rows), U64)
    for j in range(width):
        behind += BYTE_CODES[right[:, j]] * power[j]
    rank = mix(rows.column("rank").to_numpy().view(U64))
    for o in range(width):
        # `before` covers o bytes, `behind` covers width - o.
        valid = (n_left >= o) & (n_right >= width - o)
        yield o, valid, mix(mix(before + rank) * STEP + behind)
        before = before + BYTE_CODES[left[:, o]] * power[o]
        behind = behind - BYTE_CODES[right[:, width - o - 1]] * power[width - o - 1]


def _intervals(rows: pa.RecordBatch, settings: RepeatSettings) -> pa.RecordBatch:
    """Removed interval around each anchor without a twin; all anchors of each rank must be in `rows`."""
    n = len(rows)
    least, most = np.full(n, settings.window, np.int64), np.full(n, -1, np.int64)
    for o, valid, hashes in string_hashes(rows, settings):
        at = np.flatnonzero(valid)
        order = at[np.argsort(hashes[at], kind="stable")]
        same = hashes[order][1:] == hashes[order][:-1]
        hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
    position = rows.column("position").to_numpy()
    use = (most >= 0) & ~rows.column("twin").to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_pydict(
        {
            "key": rows.column("key").filter(pa.array(use)),
            "start": (position - most)[use],
            "stop": (position - least + settings.length)[use],
        }
    )


def _compare_ranks(settings: RepeatSettings):
    """Rows sorted by rank; ranks are gathered to batches that never cut one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < settings.batch_contexts:
                continue
            ranks = held.column("rank").to_numpy()
            cut = int(np.searchsorted(ranks, ranks[-1]))
            if cut:
                yield _intervals(held.slice(0, cut).combine_chunks().to_batches()[0], settings)
                held = held.slice(cut)
        if held is not None and len(held):
            yield _intervals(held.combine_chunks().to_batches()[0], settings)

    return run


def _spread_strings(settings: RepeatSettings):
    """One row for each string around each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, valid, hashes in string_hashes(batch, settings):
                valid = pa.array(valid)
                yield pa.RecordBatch.from_pydict(
                    {
                        "string": pa.array(hashes.view(np.int64)).filter(valid),
                        "key": batch.column("key").filter(valid),
                        "position": batch.column("position").filter(valid),
                        "twin": batch.column("twin").filter(valid),
                        "offset": pa.array(np.full(len(batch), o, np.int64)).filter(valid),
                    }
                )

    return run


def _compare_spread(contexts: DataFrame, settings: RepeatSettings) -> DataFrame:
    """The same intervals for ranks with too many surroundings for one task."""
    strings = stage(
        contexts.mapInArrow(
            _spread_strings(settings), "string long, key long, position long, twin boolean, offset long"
        ),
        "repeat-strings",
    )
    place = F.struct("key", "position")
    twice = strings.groupBy("string").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high")
    return (
        strings.filter("NOT twin")
        .join(twice.select("string"), "string", "left_semi")
        .groupBy("key", "position")
        .agg(F.min("offset").alias("least"), F.max("offset").alias("most"))
        .select(
            "key",
            (F.col("position") - F.col("most")).alias("start"),
            (F.col("position") - F.col("least") + settings.length).alias("stop"),
        )
    )


def _merged(intervals: DataFrame) -> DataFrame:
    """Per key, its maximal runs as an array of (start, stop)."""
    in_order = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return (
        intervals.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(in_order))
        .groupBy("key", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in chunks(batches):
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i, spans in enumerate(texts.rows.column("spans").to_pylist()):
            text, kept, at = texts.text(i), [], 0
            for x in spans or ():
                kept.append(text[at : x["start"]])
                at = x["stop"]
            kept = b"".join([*kept, text[at:]])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(spans or ()))
            out["kept"].append(kept)
        types = {"kept": pa.binary()}
        yield pa.RecordBatch.from_pydict(
            {"doc": texts.rows.column("doc")} | {x: pa.array(y, types.get(x, pa.int64())) for x, y in out.items()}
        )


def removed_spans(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """key (see tables.row_key) and spans (array of start, stop in bytes) of every text that loses something."""
    rows = documents(docs).select(row_key().alias("key"), F.xxhash64("text").alias("content"), "text")
    long = rows.filter(F.octet_length("text") >= settings.length)
    counted = long.groupBy("content").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    counted = stage(counted, "repeat-texts")
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most hot_texts of them.
    hot = F.broadcast(counted.filter(F.col("n") > max(settings.hot_least, n / settings.hot_texts)).select("content"))
    once = (
        long.join(hot, "content").groupBy("content").agg(F.min("key").alias("key"), F.first("text").alias("text"))
    )
    corpus = long.join(hot, "content", "left_anti").select("key", "text").unionByName(once.select("key", "text"))

    found = stage(repeated_anchors(corpus, settings), "repeat-anchors")
    whole = found.filter("twin").select(
        "key",
        F.greatest(F.lit(0), F.col("position") - settings.window + 1).alias("start"),
        F.least("length", F.col("position") + settings.length).alias("stop"),
    )
    whole = whole.filter(F.col("stop") - F.col("start") >= settings.length)

    listed = found.filter("mixed AND first").groupBy("key").agg(F.collect_list(F.struct("rank", "position", "twin")).alias("anchors"))
    listed = stage(listed, "repeat-listed")
    anchors_of = corpus.join(small(listed, listed.count()), "key").dropDuplicates(["key"])
    contexts = stage(
        anchors_of.select("key", "text", "anchors").mapInArrow(
            _surroundings(settings), "rank long, key long, position long, twin boolean, left binary, right binary"
        ),
        "repeat-contexts",
    )
    sizes = contexts.groupBy("rank").agg(F.count("*").alias("n"))
    large = stage(sizes.filter(F.col("n") > settings.rank_contexts).select("rank"), "repeat-large")
    n_large = large.count()
    rest = contexts.join(small(large, n_large), "rank", "left_anti") if n_large else contexts
    parts = (
        rest.repartition("rank")
        .sortWithinPartitions("rank")
        .mapInArrow(_compare_ranks(settings), "key long, start long, stop long")
    )
    intervals = whole.unionByName(parts)
    if n_large:
        intervals = intervals.unionByName(_compare_spread(contexts.join(small(large, n_large), "rank"), settings))
    hot_rows = long.join(hot, "content").select("key", F.octet_length("text").cast("long").alias("stop")).distinct()
    hot_spans = hot_rows.select("key", F.array(F.struct(F.lit(0).cast("long").alias("start"), "stop")).alias("spans"))
    hot_keys = hot_rows.select("key")
    merged = _merged(intervals).join(hot_keys, "key", "left_anti")
    return stage(merged.unionByName(hot_spans), "repeat-spans")


def remove_repeats(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    spans = removed_spans(docs, settings)
    docs = documents(docs)
    schema = "doc struct<doc_id: {}>, n_bytes long, n_removed long, n_spans long, kept binary".format(
        docs.schema["doc_id"].dataType.simpleString()
    )
    rows = docs.select(F.struct("doc_id").alias("doc"), row_key().alias("key"), "text")
    joined = rows.join(small(spans, spans.count()), "key", "left").select("doc", "text", "spans")
    return joined.mapInArrow(_cut, schema).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
