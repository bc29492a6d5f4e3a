"""Secret scans with character Markov models, in DataFrame expressions only.

Spans that look like assignments, access keys or long hex numbers are found by patterns. Besides, every run of 16 or
more characters that keys are made of is scored by two first-order character models, one of random strings and one
of ordinary identifiers: the sum of the log-likelihood ratios of its character pairs. Runs at or above
`least_ratio` that touch no pattern span are reported as `markov`.

The models are trained from labelled samples (`token`, `random`). `labelled_samples` makes them: random strings are the
base64 and hex forms of digests; ordinary ones are words, joined words and decimal numbers. The words come from a
bounded sample of the documents: those whose text hash has the most leading zeros, about `sample_documents` of them.

Positions count code points, ends exclusive. Null texts are empty. Every row is judged by itself, so repeated rows
get equal results; an empty table gives an empty result. Without ordinary words the models know digests only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import documents

# The patterns of the three base kinds. Shorter matches of a kind are dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # whole runs, so that a shorter run is no match either
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"  # the lookbehind only saves attempts inside a run
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class SecretSettings:
    least_value: int = 6
    least_access: int = 20
    least_ratio: float = 15.0
    sample_documents: int = 500
    random_strings: int = 2_000


def _located(pattern: str, possible: Column, lengths: Column | None = None) -> Column:
    """All leftmost non-overlapping matches: an array of (start, stop, token, measure).

    The text between matches comes from splitting at the same pattern, so positions are running sums.
    `possible` is a cheap test that every text with a match passes. `lengths` gives another measure per match than
    the match's own length.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    parts = F.arrays_zip(
        found.alias("token"),
        F.transform(gaps, F.length).alias("gap"),
        (lengths if lengths is not None else F.transform(found, F.length)).alias("measure"),
    )
    # There is one gap more than matches; the last has no match after it.
    parts = F.filter(parts, lambda x: x["token"].isNotNull())
    empty = F.array().cast("array<struct<start:int,stop:int,token:string,measure:int>>")

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        stop = start + F.length(x["token"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["token"].alias("token"), x["measure"].alias("measure"))
        return F.struct(stop.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda x: x["spans"])
    return F.when(possible & F.col("text").rlike(pattern), spans).otherwise(empty)


def located_spans(texts: DataFrame, settings: SecretSettings) -> DataFrame:
    """Add the arrays assign, access, hex and runs to rows with a non-null `text`."""
    values = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.length)
    text, has_runs = F.col("text"), F.size("runs") > 0
    return texts.withColumn("runs", _located(RUN, F.lit(True))).withColumns(
        {
            "assign": F.filter(
                _located(ASSIGN, text.contains("=") | text.contains(":"), values),
                lambda x: x["measure"] >= settings.least_value,
            ),
            "access": F.filter(
                _located(ACCESS, has_runs & text.contains("AKIA")), lambda x: x["measure"] >= settings.least_access
            ),
            "hex": _located(HEX, has_runs),
        }
    )


def labelled_samples(docs: DataFrame, settings: SecretSettings) -> DataFrame:
    """token, random: the training samples."""
    spark = docs.sparkSession
    hashed = documents(docs).select("text", F.xxhash64("text", F.lit(1)).alias("hash")).filter("text IS NOT NULL")
    zeros = F.coalesce(F.lit(64) - F.length(F.bin(F.when(F.col("hash") != 0, F.col("hash")))), F.lit(64)).cast("int")
    n = hashed.select("hash").distinct().count()
    least = max(0, math.floor(math.log2(max(1, n / settings.sample_documents))))
    words = (
        hashed.filter(zeros >= least)
        .select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0)))).alias("token"))
        .distinct()
    )
    joined = words.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(1_000))).groupBy("part").agg(
        F.array_join(F.slice(F.array_sort(F.collect_list(F.lower("token"))), 1, 4), "_").alias("token")
    )
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    strings = spark.range(settings.random_strings).select(
        F.array(F.rtrim(F.base64(digest)), F.lower(F.hex(digest))).alias("random"),
        F.array(F.conv(F.substring(F.hex(digest), 1, 12), 16, 10), (F.col("id") + 1_000_000).cast("string")).alias("plain"),
    )
    return (
        words.select("token", F.lit(False).alias("random"))
        .unionByName(joined.select("token", F.lit(False).alias("random")))
        .unionByName(strings.select(F.explode("plain").alias("token"), F.lit(False).alias("random")))
        .unionByName(strings.select(F.explode("random").alias("token"), F.lit(True).alias("random")))
    )


def _pairs(token: Column) -> Column:
    """Numbers of the character pairs of a token: first * size + second; other characters share one number."""
    size = len(ALPHABET) + 1
    codes = F.transform(F.split(token, ""), lambda x: F.instr(F.lit(ALPHABET), x))
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)), lambda a, b: a * size + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each character pair. Counts are smoothed by one."""
    size = len(ALPHABET) + 1
    counts = (
        samples.filter(F.length("token") > 1)
        .select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
        .groupBy("pair")
        .agg(F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("plain"))
        .collect()  # at most size * size rows
    )
    table = {x.pair: (x.random, x.plain) for x in counts}
    out = []
    for first in range(size):
        rows = [table.get(first * size + second, (0, 0)) for second in range(size)]
        sums = [sum(x[i] for x in rows) + size for i in (0, 1)]
        out += [math.log((a + 1) / sums[0]) - math.log((b + 1) / sums[1]) for a, b in rows]
    return out


def _ratio(token: Column, model: Column) -> Column:
    return F.aggregate(_pairs(token), F.lit(0.0), lambda total, x: total + F.get(model, x))


def find_secrets(docs: DataFrame, settings: SecretSettings = SecretSettings(), samples: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id and spans, an array of (start, kind number, stop, kind, ratio) in order.

    `samples` (token, random) replaces the samples made from the documents.
    """
    model = train(labelled_samples(docs, settings) if samples is None else samples)
    # A constant of fixed size: the planner folds it into one array.
    weights = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    located = located_spans(rows, settings)

    def named(kind: str, source: Column, ratio=None) -> Column:
        return F.transform(
            source,
            lambda x: F.struct(
                x["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("number"),
                x["stop"].alias("stop"),
                F.lit(kind).alias("kind"),
                (ratio(x) if ratio else F.lit(None).cast("double")).alias("ratio"),
            ),
        )

    base = F.concat(*[named(x, F.col(x)) for x in KINDS[:3]])
    scored = named("markov", F.col("runs"), lambda x: _ratio(x["token"], weights))
    free = F.filter(
        F.col("scored"),
        lambda x: (x["ratio"] >= settings.least_ratio)
        & ~F.exists(F.col("base"), lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])),
    )
    return (
        located.select("doc_id", base.alias("base"), "runs")
        .select("doc_id", "base", scored.alias("scored"))
        .select("doc_id", F.array_sort(F.concat("base", free)).alias("spans"))
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
