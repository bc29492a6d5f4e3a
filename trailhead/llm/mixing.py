"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target number of words. A document is taken floor(target / source size) times, and once
more if its hash lies under the source's threshold. The threshold comes from histograms: words are summed by
source and hash bucket, the bucket in which the running sum passes the budget is found, and only that bucket
is summed again by finer buckets, until at most one hash value is left in it. Nothing is sorted, and rows
are never collected; a document is judged by its own hash and the row of its source.

Null texts have size 0, an absent source is a source of its own (last in the order), repeated rows share a
hash and are taken or left together, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import documents, small, stage

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


@dataclass(frozen=True)
class MixSettings:
    """weights        given to the sources in code point order, repeating; a null source comes last
    most_copies     a source is taken at most this many times its size
    bucket_bits     each histogram splits a bucket into 2**bucket_bits finer ones
    broadcast_rows  tables with a row per source are broadcast up to this many rows
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most_copies: float = 3.0
    bucket_bits: int = 12
    broadcast_rows: int = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixing_hash() -> Column:
    """The first 60 bits of md5 over id and text, the same in any engine."""
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(ident), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """A row per source: its size and target.

    Targets share the size of all sources by weight. One that exceeds `most_copies` times its source's size is
    set to that, and the excess is shared again by weight. That ends with target = min(cap, level * weight) for
    one level, which follows from running sums over the sources in the order of cap / weight.
    """
    n = len(settings.weights)
    weights = F.array(*[F.lit(float(x)) for x in settings.weights])
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    up_to = Window.orderBy("full_at", F.col("source").isNull(), "source")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(weights, (place % n).cast("int")))
        .withColumn("cap", settings.most_copies * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    # If every source before this one is full, what is left goes to this and the later ones by weight.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(up_to.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = sources.withColumn("level", level).withColumn(
        "final_level",
        F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything),  # the first that suits
    )
    target = F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), "cap"))
    return levels.select("source", "source_size", target.alias("target"))


def hash_thresholds(sized: DataFrame, targets: DataFrame, settings: MixSettings) -> DataFrame:
    """A row per source: take a further copy of the documents whose hash is under `threshold`.

    The words under the threshold come as near to the source's remaining budget as whole hash values allow.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("copies", copies.cast("long")).withColumns(
        {
            "left": F.col("target") - F.col("copies") * F.col("source_size"),
            "low": F.lit(0).cast("long"),  # first hash of the open bucket
        }
    )
    n_sources = targets.count()
    by_hash = Window.partitionBy("source").orderBy("bucket")
    width = 1 << HASH_BITS
    while width > 1:
        finer = max(1, width >> settings.bucket_bits)
        open_rows = sized.join(
            small(state.select("source", "low"), n_sources, settings.broadcast_rows).withColumnRenamed("source", "_s"),
            F.col("source").eqNullSafe(F.col("_s"))
            & (F.col("hash") >= F.col("low"))
            & (F.col("hash") < F.col("low") + F.lit(width)),
        )
        histogram = open_rows.groupBy("source", F.expr(f"(hash - low) div {finer}").alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last")
        )
        running = histogram.withColumn("upto", F.sum("words").over(by_hash)).join(
            small(state.select(F.col("source").alias("_s"), "left", "low"), n_sources, settings.broadcast_rows),
            F.col("source").eqNullSafe(F.col("_s")),
        )
        # The first bucket that passes the budget stays open; without one the budget covers all that is left.
        boundary = running.filter(F.col("upto") > F.col("left")).groupBy("source").agg(
            F.min_by(F.struct("bucket", "words", "upto", "first", "last"), "bucket").alias("b")
        )
        state = stage(
            state.join(
                boundary.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left"
            ).select(
                "source",
                "source_size",
                "target",
                "copies",
                F.when(F.col("b").isNull(), F.col("left"))
                .otherwise(F.col("left") - (F.col("b.upto") - F.col("b.words")))
                .alias("left"),
                F.when(F.col("b").isNull(), F.lit(width) + F.col("low"))
                .otherwise(F.col("low") + F.col("b.bucket") * F.lit(finer))
                .alias("low"),
                F.coalesce(F.col("b.last") > F.col("b.first"), F.lit(False)).alias("several"),
                F.coalesce(F.col("b.words"), F.lit(0)).alias("words"),
                F.col("b.last").alias("last"),
            ),
            "mix-thresholds",
        )
        width = finer
        if not state.filter("several").head(1):
            break
    # One hash value is left at the boundary: take it if that comes nearer to the budget.
    takes_last = F.col("last").isNotNull() & (F.col("words") <= 2 * F.col("left"))
    threshold = F.when(takes_last, F.col("last") + 1).otherwise(F.col("low"))
    return state.select("source", "source_size", "target", "copies", threshold.alias("threshold"))


def _shares(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """A row per source (`_s`), marked for broadcasting if there are few."""
    targets = stage(source_targets(sized, settings), "mix-targets")
    chosen = hash_thresholds(sized, targets, settings).withColumnRenamed("source", "_s")
    return small(chosen, targets.count(), settings.broadcast_rows)


def _sized(docs: DataFrame) -> DataFrame:
    """Each document with the columns the decision needs; `doc` holds all its own columns, whatever their names."""
    return docs.select(
        F.struct("*").alias("doc"), "source", n_words(F.col("text")).alias("size"), mixing_hash().alias("hash")
    )


def mix(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (times it is taken) and taken (words)."""
    sized = stage(_sized(documents(docs, "source")).select("doc.doc_id", "source", "size", "hash"), "mix-sizes")
    copies = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    return (
        sized.join(_shares(sized, settings), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The documents themselves with all their columns, each as often as the mix takes it."""
    sized = stage(_sized(documents(docs, "source")).select("source", "size", "hash"), "mix-sizes")
    copies = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    return (
        _sized(docs)
        .join(_shares(sized, settings), F.col("source").eqNullSafe(F.col("_s")))
        .select("doc", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))
        .select("doc.*")
    )
