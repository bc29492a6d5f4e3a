"""Quality rules with thresholds that adapt to each language and source.

Every document is measured (words, symbols, repeated lines and word windows). The measures of each language and
source go into DDSketch quantile sketches: counts by logarithmic bucket, kept as ordinary rows, which merge by
adding counts. Upper and lower fences come from the quartiles; a group with few documents takes those of its
language, and a language with few those of all documents. Documents are then filtered by a join with the fences.

Null texts are empty. A null language or source is a group of its own. Every row is judged by itself, so
repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import documents, in_batches, packed, small, stage, unpacked
from .textops import PIECE_BYTES, Texts, chunks, mix, shingles, span_hashes, word_hashes, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Fence:
    """Limits a value to quartile +- `spread` interquartile ranges, at least `slack` away from the quartile.

    `low` says whether small values are refused as well as large ones.
    """

    value: str
    slack: float
    spread: float = 6.0
    low: bool = False


@dataclass(frozen=True)
class QualitySettings:
    """growth      ratio of a sketch bucket's bounds; quantiles are right within (growth - 1) / 2
    least_rows  a group needs this many documents for fences of its own
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    growth: float = 1.02
    least_rows: int = 200
    broadcast_rows: int = 100_000
    fences: tuple[Fence, ...] = field(
        default=(
            Fence("n_symbols / word_chars", 0.04),
            Fence("n_dup_lines / n_lines", 0.5),
            Fence("n_repeat_words / n_words", 0.3),
            Fence("word_chars / n_words", 2.0, low=True),
        )
    )


def _repeats(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its text holds it twice or more, and whether an earlier one is equal."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    keys = mix(values + text_of * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    again, repeated = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order] = same
    repeated[order] = same | np.concatenate((same[1:], [False]))[: len(same)]
    return repeated, again


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def measure_texts(texts: Texts) -> dict[str, np.ndarray]:
    data = texts.data
    words = words_of(texts)
    prefix = texts.prefix_hashes()
    hashes = span_hashes(prefix, words.starts, words.ends)
    windows, first = shingles(hashes, words.first, 3, short=False)
    repeated, _ = _repeats(windows, first)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    at = (words.first[text_of] + np.arange(len(windows)) - first[text_of])[repeated]
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[at + i] = True

    in_word = np.zeros(len(data) + 1, np.int8)
    np.add.at(in_word, words.starts, 1)
    np.add.at(in_word, words.ends, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)

    # Lines with a word in them. A line ends at \n or where its text ends.
    breaks = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.union1d(breaks[:-1] + 1, texts.bounds[:-1])
    starts = starts[starts < len(data)]
    text_ends = texts.bounds[np.searchsorted(texts.bounds, starts, "right")]
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], text_ends)
    solid = np.concatenate(([0], np.cumsum(in_word, dtype=np.int64)))
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    line_first = np.searchsorted(starts, texts.bounds)
    _, again = _repeats(span_hashes(prefix, starts, ends), line_first)
    return {
        "n_words": words.counts,
        "word_chars": texts.per_text(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(SYMBOLS[data]),
        "n_lines": np.diff(line_first),
        "n_dup_lines": _sums(again, line_first),
        "n_repeat_words": _sums(covered, words.first),
    }


def _measure(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, limit=PIECE_BYTES):
            measures = measure_texts(texts)
            columns = {name: texts.rows.column(name) for name in texts.rows.schema.names}
            if not keep_text:
                del columns["text"]
            yield pa.RecordBatch.from_pydict(columns | {x: pa.array(measures[x], pa.int64()) for x in MEASURES})

    return run


def measured(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Columns of `docs` (with or without `text`) and the measures."""
    kept = [x for x in docs.schema if keep_text or x.name != "text"]
    schema = T.StructType(kept + [T.StructField(x, T.LongType()) for x in MEASURES])
    return in_batches(docs, _measure(keep_text), schema)


def base_failed(settings: QualitySettings) -> Column:
    return (F.col("n_words") < settings.min_words) | (
        100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words")
    )


def _value(fence: Fence) -> Column:
    above, below = (F.col(x.strip()) for x in fence.value.split("/"))
    return F.when(below > 0, above / below).otherwise(F.lit(0.0))


def sketches(measures: DataFrame, settings: QualitySettings) -> DataFrame:
    """Quantile sketches as rows: lang, source, fence (its place in the settings), bucket, n."""
    values = F.array(*[_value(x) for x in settings.fences])
    # Bucket b holds growth**(b-1) < value <= growth**b; 0 has a bucket below all others.
    log = F.ceil(F.log(F.col("value")) / F.log(F.lit(settings.growth)))
    return (
        measures.filter(~base_failed(settings))
        .select("lang", "source", F.posexplode(values).alias("fence", "value"))
        .select("lang", "source", "fence", F.when(F.col("value") > 0, log).otherwise(-100_000).cast("int").alias("bucket"))
        .groupBy("lang", "source", "fence", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str], settings: QualitySettings) -> DataFrame:
    merged = sketch.groupBy(*keys, "fence", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "fence")
    upto = F.sum("n").over(group.orderBy("bucket"))
    g = settings.growth
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(F.pow(F.lit(g), F.col("bucket")) * (2 / (g + 1)))
    return (
        merged.withColumns({"upto": upto, "rows": F.sum("n").over(group), "value": value})
        .groupBy(*keys, "fence")
        .agg(
            F.max("rows").alias("rows"),
            F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("value"))).alias("q1"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("value"))).alias("q3"),
        )
    )


def fences(sketch: DataFrame, settings: QualitySettings) -> DataFrame:
    """A row per language and source: `lows` and `highs`, the limits in the order of the settings' fences."""
    enough = F.col("rows") >= settings.least_rows
    own = _quartiles(sketch, ["lang", "source"], settings)
    by_lang = _quartiles(sketch, ["lang"], settings).select(
        F.col("lang").alias("_lang"), F.col("fence").alias("_fence"), F.when(enough, F.struct("q1", "q3")).alias("of_lang")
    )
    overall = F.broadcast(  # one row per fence
        _quartiles(sketch, [], settings).select(F.col("fence").alias("_all"), F.struct("q1", "q3").alias("of_all"))
    )
    joined = own.join(
        by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("fence") == F.col("_fence")), "left"
    ).join(overall, F.col("fence") == F.col("_all"), "left")
    q = F.coalesce(F.when(enough, F.struct("q1", "q3")), "of_lang", "of_all")
    joined = joined.withColumn("q", q)

    def by_fence(make) -> Column:
        return F.element_at(F.array(*[make(x) for x in settings.fences]), F.col("fence") + 1)

    reach = by_fence(
        lambda x: F.greatest(F.lit(x.slack), x.spread * (F.col("q.q3") - F.col("q.q1")))
    )
    low = F.when(by_fence(lambda x: F.lit(x.low)), F.col("q.q1") - reach).otherwise(F.lit(float("-inf")))
    return (
        joined.select("lang", "source", "fence", low.alias("low"), (F.col("q.q3") + reach).alias("high"))
        .groupBy("lang", "source")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("fence", "low"))).alias("lows"),  # one entry per fence
            F.map_from_entries(F.collect_list(F.struct("fence", "high"))).alias("highs"),
        )
    )


def judge(rows: DataFrame, limits: DataFrame, n_limits: int, settings: QualitySettings) -> DataFrame:
    """Add base_failed and kept to measured rows. A group without fences has no row that passes the base rules."""
    limits = small(limits, n_limits, settings.broadcast_rows).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(
        limits,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    fits = F.lit(True)
    for i, x in enumerate(settings.fences):
        value = _value(x)
        fits = fits & (value >= F.col("lows")[F.lit(i)]) & (value <= F.col("highs")[F.lit(i)])
    return joined.withColumn("base_failed", base_failed(settings)).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(fits, F.lit(True)))
    ).drop("_lang", "_source", "lows", "highs")


def _limits(measures: DataFrame, settings: QualitySettings) -> tuple[DataFrame, int]:
    limits = stage(fences(stage(sketches(measures, settings), "quality-sketches"), settings), "quality-fences")
    return limits, limits.count()


def judged(docs: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """Per document: doc_id, lang, source, the measures, base_failed and kept."""
    measures = stage(measured(documents(docs, "lang", "source"), keep_text=False), "quality-measures")
    return judge(measures, *_limits(measures, settings), settings)


def kept_documents(docs: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured twice instead of being shuffled."""
    measures = stage(measured(documents(docs, "lang", "source"), keep_text=False), "quality-measures")
    rows = measured(packed(docs, "lang", "source"), keep_text=True)
    kept = judge(rows, *_limits(measures, settings), settings).filter("kept")
    return unpacked(kept, docs.columns)
