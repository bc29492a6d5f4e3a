"""Hard-negative mining: for an anchor and each of its nearest rows of the same label, rows of other labels whose score is
a given share of the positive's.

Scores are exact integer inner products of the components floor(scale * x). Anchors are a stated share of all rows and are
compared with all rows, in blocks. The products are Kronecker-packed: the components of several candidates are biased to be
non-negative and put into separated fields of one wide integer. One multiplication for an anchor's component then serves
all candidates of the word, and the sums in the fields, which cannot reach each other, are unpacked exactly:

    sum_j a_j * (sum_f (c_fj + bias) * 2**(width * f)) = sum_f (score_f + bias * sum_j a_j) * 2**(width * f)

Field width and bias come from the values of each block. The wide integers are held in the 53 bits in which a double is
exact, so that the products of a block are one matrix multiplication; where a field needs more, they are Python integers of
any width.

Two passes over all rows: the first finds each anchor's positives, the second the best negatives in each window. A task
keeps, for each anchor, only as many rows as can be in the result, and only these are shuffled. Anchors are held in memory
in rounds of at most `anchor_bytes`; every round meets all rows.

Rows with a null label, a null vector or a null or non-finite component take no part. Repeated rows are rows of their own:
a copy of the anchor is another row. A null id is larger than any other, and is no anchor. Vectors of different length
are compared as if the shorter ended in zeros. Scores beyond 64 bits become the largest or smallest 64-bit number. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stage

DOUBLE_BITS = 53
NO_ID = np.iinfo(np.int64).max
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class NegativeSettings:
    """positives, negatives       rows for each anchor, and for each of its positives
    low_percent, high_percent  share of the positive's score that a negative's must have
    scale                      components are multiplied by it and rounded down
    anchor_bytes               components of the anchors of a round, as doubles
    block                      anchors that meet a batch of rows at once
    rows_per_task, most_tasks  how rows are dealt out; affects only the time
    """

    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90
    scale: int = 256
    anchor_bytes: int = 1 << 25
    block: int = 256
    rows_per_task: int = 4096
    most_tasks: int = 20_000


def wide_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all candidates; integers, given as doubles."""
    n = len(candidates)
    bias = int(np.abs(candidates).max(initial=0))
    most = max((sum(int(x) for x in row) for row in _largest(np.abs(anchors))), default=0)
    width = (2 * bias * most).bit_length() + 1
    fields = DOUBLE_BITS // width
    if fields:
        kind, biased, left = np.float64, candidates + bias, anchors
    else:
        fields, kind = 8, object
        biased, left = _as_integers(candidates) + bias, _as_integers(anchors)
    if n % fields:
        biased = np.concatenate([biased, np.zeros((fields - n % fields, biased.shape[1]), kind)])
    by_field = biased.reshape(len(biased) // fields, fields, biased.shape[1])
    words = by_field[:, 0].copy()
    for f in range(1, fields):
        words = words + by_field[:, f] * kind_of(2 ** (width * f), kind)
    sums = left @ words.T
    rest = sums.astype(np.int64) if kind is np.float64 else sums
    half, mask = 1 << (width - 1), (1 << width) - 1
    out = np.empty((len(anchors), len(words), fields), rest.dtype)
    for f in range(fields):
        out[:, :, f] = ((rest + half) & mask) - half if f < fields - 1 else rest
        rest = (rest - out[:, :, f]) >> width
    shift = left.sum(axis=1) * bias
    out = out.reshape(len(anchors), len(words) * fields)[:, :n] - (shift.astype(np.int64) if kind is np.float64 else shift)[:, None]
    return out if kind is np.float64 else np.clip(out, -int(LAST), int(LAST)).astype(np.int64)


def kind_of(value: int, kind):
    return float(value) if kind is np.float64 else value


def _largest(sizes: np.ndarray) -> np.ndarray:
    """The row of the largest sum, if the sums are exact; else all rows."""
    sums = sizes.sum(axis=1)
    return sizes[[int(sums.argmax())]] if len(sums) and sums.max() < 2**DOUBLE_BITS else sizes


def _as_integers(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()] + [None], object)[:-1].reshape(values.shape)


def components(vectors: pa.ListArray, scale: int, length: int | None = None) -> np.ndarray:
    """floor(scale * x) of each vector as doubles, all vectors brought to one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    most = int(sizes.max(initial=0)) if length is None else length
    out = np.zeros((len(sizes), most))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < most
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(scale * flat[inside]), -(2.0**1000), 2.0**1000)
    out[row[inside], place[inside]] = values
    return out


class _Best:
    """The best rows so far in each of `slots` lists of each anchor: highest score, then smallest id."""

    def __init__(self, anchors: int, slots: int, k: int) -> None:
        self.score = np.zeros((anchors, slots, k), np.int64)
        self.id = np.zeros((anchors, slots, k), np.int64)
        self.there = np.zeros((anchors, slots, k), bool)

    def add(self, at: slice, score: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        all_of = [np.concatenate([mine[at], new], axis=2) for mine, new in ((self.score, score), (self.id, ids), (self.there, there))]
        for key in (lambda: all_of[1], lambda: -all_of[0], lambda: ~all_of[2]):  # the last sort counts most
            order = np.argsort(key(), axis=2, kind="stable")
            all_of = [np.take_along_axis(x, order, axis=2) for x in all_of]
        k = self.score.shape[2]
        self.score[at], self.id[at], self.there[at] = (x[:, :, :k] for x in all_of)


def _take(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """In each row, for each window low..high (columns): the first k allowed entries inside. Entries are sorted by id."""
    n = scores.shape[1]
    codes, values = -scores, None
    if scores.size and max(int(scores.max()), -int(scores.min())) >= 2**61 // n:
        values, codes = np.unique(codes, return_inverse=True)
        codes = codes.reshape(scores.shape)
    keys = np.where(allowed, codes * n + np.arange(n), LAST)
    keys.sort(axis=1)
    valid = allowed.sum(axis=1)
    out_score, out_id = np.zeros((*low.shape, k), np.int64), np.zeros((*low.shape, k), np.int64)
    there = np.zeros((*low.shape, k), bool)
    for i in range(len(scores)):
        row = keys[i, : valid[i]]
        begin = np.clip(-high[i], -(2**61) // n, 2**61 // n) if values is None else np.searchsorted(values, -high[i])
        first = np.searchsorted(row, begin * n)
        at = first[:, None] + np.arange(k)
        inside = at < len(row)
        found = row[np.where(inside, at, 0)] if len(row) else np.zeros(at.shape, np.int64)
        code = found // n
        score = -(code if values is None else values[np.where(inside, code, 0)])
        out_score[i], out_id[i] = score, ids[np.where(inside, found - code * n, 0)]
        there[i] = inside & (score >= low[i][:, None])
    return out_score, out_id, there


def _mine(vectors: np.ndarray, labels: np.ndarray, uids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, settings):
    """Per task: for each anchor and window, the best rows of the same (or of another) label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(vectors), low.shape[1], k)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column("id").fill_null(NO_ID).to_numpy(), kind="stable")))
            ids = batch.column("id").fill_null(NO_ID).to_numpy()
            label, uid = batch.column("label").to_numpy(), batch.column("uid").to_numpy()
            rows = components(batch.column("vector"), settings.scale, vectors.shape[1])
            for first in range(0, len(vectors), settings.block):
                at = slice(first, min(first + settings.block, len(vectors)))
                scores = wide_products(vectors[at], rows)
                alike = label[None, :] == labels[at, None]
                allowed = alike & (uid[None, :] != uids[at, None]) if same else ~alike
                best.add(at, *_take(scores, ids, allowed, low[at], high[at], k))
        anchor, slot, _ = np.nonzero(best.there)
        yield pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array(anchor.astype(np.int32)),
                "slot": pa.array(slot.astype(np.int32)),
                "score": pa.array(best.score[best.there]),
                "id": pa.array(best.id[best.there]),
            }
        )

    return run


def _firsts(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _usable(rows: DataFrame, id: Column, label: Column, vector: Column, settings: NegativeSettings) -> DataFrame:
    cells = rows.select(id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    cells = cells.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    tasks = min(-(-cells.count() // settings.rows_per_task), settings.most_tasks)
    return stage(cells.repartition(max(tasks, 1)).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")


def hard_negatives(
    rows: DataFrame, id: Column, label: Column, vector: Column, is_anchor: Column, settings: NegativeSettings = NegativeSettings()
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `is_anchor` is a condition on `id`."""
    schema = "anchor int, slot int, score long, id long"
    usable = _usable(rows, id, label, vector, settings)
    chosen = usable.filter(F.coalesce(is_anchor, F.lit(False)) & F.col("id").isNotNull())
    n, length = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    rounds = -(-n * 8 * max(length, 1) // settings.anchor_bytes)
    result = None
    for turn in range(rounds):
        anchors = chosen.filter(F.pmod(F.xxhash64("uid"), F.lit(rounds)) == turn).orderBy("uid").toArrow().combine_chunks()
        if not anchors.num_rows:
            continue
        ids, labels, uids = (anchors.column(x).to_numpy() for x in ("id", "label", "uid"))
        vectors = components(anchors.column("vector").combine_chunks(), settings.scale, length)
        everything = np.full((len(ids), 1), LAST, np.int64)
        nearest = _mine(vectors, labels, uids, -everything, everything, True, settings.positives, settings)
        positives = _firsts(usable.mapInArrow(nearest, schema), settings.positives).toPandas()
        # Windows; where an anchor has fewer positives, the window is empty.
        shape = (len(ids), settings.positives)
        low, high = np.ones(shape, np.int64), np.zeros(shape, np.int64)
        of = positives["anchor"].to_numpy(), positives["rank"].to_numpy() - 1
        scores = [int(x) for x in positives["score"]]
        low[of] = [-(-settings.low_percent * x // 100) for x in scores]
        high[of] = [settings.high_percent * x // 100 for x in scores]
        positive_ids, positive_scores = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        positive_ids[of], positive_scores[of] = positives["id"], positives["score"]
        hard = _mine(vectors, labels, uids, low, high, False, settings.negatives, settings)
        named = _named(ids, positive_ids, positive_scores)
        found = _firsts(usable.mapInArrow(hard, schema), settings.negatives).select("anchor", "slot", "rank", "id", "score")
        found = found.mapInArrow(
            named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
        result = found if result is None else result.unionByName(found)
    if result is None:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], empty)
    return result


def _named(ids: np.ndarray, positive_ids: np.ndarray, positive_scores: np.ndarray):
    """Ids and scores in place of the numbers of anchors and positives."""

    def known(values: np.ndarray) -> pa.Array:
        return pa.array(values, mask=values == NO_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, slot = batch.column("anchor").to_numpy(), batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor_id": pa.array(ids[anchor]),
                    "positive_id": known(positive_ids[anchor, slot]),
                    "rank": batch.column("rank"),
                    "negative_id": known(batch.column("id").to_numpy()),
                    "positive_score": pa.array(positive_scores[anchor, slot]),
                    "negative_score": batch.column("score"),
                }
            )

    return run
