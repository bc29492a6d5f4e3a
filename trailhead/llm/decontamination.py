"""Benchmark decontamination: BM25 index of the test items, searched with every training passage by block-max WAND.

Words are lower-cased and cut at ASCII characters other than letters and digits. A document is cut into passages
of 2 * step words that overlap by half, so that any run of `step` words lies in one of them. An item is searched
in passages whose step is the smallest doubling of `step` that holds it: items are indexed by that length, so what an
item finds does not depend on longer ones. A passage is a query: its distinct words score every item by BM25, as a share of what the item's own words
would score (0 to 1). All items that reach `least_score` are retrieved. A hit counts if the passage also holds
`least_overlap` of the five-word shingles of the item's question and of those that touch its answer. The answer
is the item's last sentence, or its last third of words if it has one sentence.

Blocks of items have, for every word, the largest weight in the block. For all passages of a chunk the sums of these
bounds are taken at once; only passages with a block above the threshold go on to the search, which skips by the
same bounds, so nothing above the threshold is missed. Items are indexed in groups of at most `group_items`, each
with a pass over the documents, so the index in a task is bounded for any benchmark.

Null or empty texts and items match nothing. Repeated rows are judged alike, repeated items count once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .tables import documents, in_batches, packed, stage, unpacked
from .textops import PIECE_BYTES, chunks

# Lower-case already; anything in ASCII but letters and digits separates words.
SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class LeakSettings:
    least_score: float = 0.75
    least_overlap: float = 0.8
    shingle: int = 5
    step: int = 64
    group_items: int = 2_000
    blocks: int = 32
    k1: float = 1.2
    b: float = 0.75


def normal_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(SEPARATE).split()


def question_length(text: str, n_words: int) -> int:
    """Number of words before the answer."""
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(x) for x in (".", "!", "?", "\n"))
    before = len(normal_words(body[: cut + 1])) if cut >= 0 else 0
    return before if 0 < before < n_words else n_words - -(-n_words // 3)


def step_of(n_words: int, settings: LeakSettings) -> int:
    """Step of the passages for an item of so many words."""
    step = settings.step
    while step < n_words:
        step *= 2
    return step


@dataclass
class Item:
    item_id: object
    words: list[bytes]
    question: set
    answer: set


def make_item(item_id, text: str, settings: LeakSettings) -> Item:
    words, k = normal_words(text), settings.shingle
    asked = question_length(text, len(words))
    question, answer = set(), set()
    for i in range(max(1, len(words) - k + 1)):
        (question if i + k <= asked else answer).add(tuple(words[i : i + k]))
    return Item(item_id, words, question, answer)


class BlockMaxIndex:
    """Postings by word: items in order with weights, cut into blocks with the largest weight of each."""

    def __init__(self, items: list[Item], df: dict[bytes, int], n_items: int, mean_words: float, settings: LeakSettings):
        self.items, self.settings = items, settings
        self.block = max(1, -(-len(items) // settings.blocks))
        n_blocks = max(1, -(-len(items) // self.block))
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for i, item in enumerate(items):
            counts = Counter(item.words)
            norm = settings.k1 * (1 - settings.b + settings.b * len(item.words) / mean_words)
            weights = {
                w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (settings.k1 + 1) / (n + norm)
                for w, n in counts.items()
            }
            own = sum(weights.values())
            for w, x in weights.items():
                if w not in self.terms:
                    self.terms[w] = len(postings)
                    postings.append([])
                postings[self.terms[w]].append((i, x / own))
        self.postings = postings
        self.bounds = np.zeros((len(postings), n_blocks), np.float32)
        for t, posting in enumerate(postings):
            for i, x in posting:
                self.bounds[t, i // self.block] = max(self.bounds[t, i // self.block], np.nextafter(np.float32(x), np.float32(2)))
        self.most = self.bounds.max(axis=1, initial=0)
        self.step = step_of(max((len(x.words) for x in items), default=0), settings)

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose score reaches `least`, by WAND with block bounds."""
        lists = [[0, t] for t in terms]  # place in the posting list, term
        found = []
        while True:
            lists = [x for x in lists if x[0] < len(self.postings[x[1]])]
            lists.sort(key=lambda x: self.postings[x[1]][x[0]][0])
            # The pivot: the first item that the words up to it could bring to the threshold.
            total, pivot = 0.0, None
            for at, t in lists:
                total += self.most[t]
                if total >= least:
                    pivot = self.postings[t][at][0]
                    break
            if pivot is None:
                return found
            block = pivot // self.block
            reaching = [x for x in lists if self.postings[x[1]][x[0]][0] <= pivot]
            if sum(float(self.bounds[t, block]) for _, t in reaching) < least:
                # No item up to the next one that another word can add, or the end of the block, can reach it.
                later = [self.postings[x[1]][x[0]][0] for x in lists[len(reaching) :]]
                self._advance(reaching, min([*later, (block + 1) * self.block]))
                continue
            self._advance(reaching, pivot)
            score = 0.0
            for x in reaching:
                posting = self.postings[x[1]]
                if x[0] < len(posting) and posting[x[0]][0] == pivot:
                    score += posting[x[0]][1]
                    x[0] += 1
            if score >= least - 1e-9:
                found.append((pivot, score))

    def _advance(self, lists: list[list[int]], item: int) -> None:
        for x in lists:
            posting = self.postings[x[1]]
            while x[0] < len(posting) and posting[x[0]][0] < item:
                x[0] += 1


def passage_starts(n_words: int, step: int) -> range:
    return range(0, max(1, n_words - step), step) if n_words else range(0)


def leaks_of(texts, index: BlockMaxIndex, settings: LeakSettings) -> list[dict[int, tuple[float, float, float]]]:
    """For each text, the items it leaks: score and overlap with question and answer, of the best passage."""
    step = index.step
    out: list[dict] = [{} for _ in range(len(texts))]
    known = index.terms.get
    words_by_text, ids, first = [], [], [0]
    for i in range(len(texts)):
        words = normal_words(texts.text(i).decode())
        words_by_text.append(words)
        ids.extend([known(w, -1) for w in words])
        first.append(len(ids))
    ids = np.array(ids, np.int32)
    if not len(ids) or not len(index.bounds):
        return out
    # Bounds of all passages, from the distinct known words of each.
    counts = np.diff(first)
    per_text = np.where(counts > 0, np.maximum(1, -(-counts // step) - 1), 0)
    owners = np.repeat(np.arange(len(texts)), per_text)
    starts = (np.arange(len(owners)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * step
    n_terms = len(index.bounds)
    heard = np.flatnonzero(ids >= 0)
    text_of = np.searchsorted(first, heard, "right") - 1
    segment = (heard - np.array(first)[text_of]) // step
    base = (np.cumsum(per_text) - per_text)[text_of]
    last = per_text[text_of] - 1
    # A word in segment s is in the passages that start with segments s - 1 and s.
    at = np.concatenate([base + np.minimum(segment, last), base + np.clip(segment - 1, 0, last)])
    pairs = np.unique(at * n_terms + np.concatenate([ids[heard]] * 2))
    passage, term = pairs // n_terms, pairs % n_terms
    if not len(pairs):
        return out
    edges = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    bound = np.add.reduceat(index.bounds[term], edges, axis=0).max(axis=1)
    for p in passage[edges[bound >= settings.least_score - 1e-3]].tolist():
        i, start = owners[p], starts[p]
        words = words_by_text[i][start : start + 2 * step]
        own = ids[first[i] + start : first[i] + min(start + 2 * step, len(words_by_text[i]))]
        hits = index.search(np.unique(own[own >= 0]).tolist(), settings.least_score)
        if not hits:
            continue
        k = settings.shingle
        held = {n: {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} for n in range(1, k + 1)}
        for item, score in hits:
            x = index.items[item]
            asked, answered = (
                sum(s in held[len(s)] for s in part) / len(part) if part else 1.0 for part in (x.question, x.answer)
            )
            if min(asked, answered) >= settings.least_overlap:
                out[i][item] = max(out[i].get(item, (0.0, 0.0, 0.0)), (score, asked, answered))
    return out


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normal_words(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "number": batch.column("number"),
                "n": pa.array([len(x) for x in texts], pa.int64()),
                "terms": pa.array([list(set(x)) for x in texts], pa.list_(pa.binary())),
            }
        )


def indexes(benchmark: DataFrame, settings: LeakSettings) -> Iterator[BlockMaxIndex]:
    """An index for each group of items that need passages of one length; word statistics are those of all items."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    items = stage(items.withColumn("number", F.xxhash64("item_id", "text")), "leak-items")
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / settings.step) - 1e-9)).alias("doublings")
    terms = in_batches(items.select("number", "text"), _term_rows, "number long, n long, terms array<binary>").filter("n > 0")
    terms = stage(terms.select("*", doublings), "leak-terms")
    n_items, mean_words = terms.agg(F.count("*"), F.avg("n")).first()
    df = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # A row for each length class: their number grows with the logarithm of the longest item.
    for length, n in sorted(terms.groupBy("doublings").count().collect()):
        groups = -(-n // settings.group_items)
        for g in range(groups):
            chosen = terms.filter((F.col("doublings") == length) & (F.pmod("number", F.lit(groups)) == g))
            rows = items.join(chosen.select("number"), "number", "left_semi").orderBy("item_id", "text")
            made = [make_item(x.item_id, x.text, settings) for x in rows.collect()]  # about group_items rows
            own = chosen.select(F.explode("terms").alias("term")).distinct()
            counts = {bytes(x.term): x.df for x in df.join(own, "term", "left_semi").collect()}
            yield BlockMaxIndex(made, counts, n_items, mean_words or 1.0, settings)


def _find(index: BlockMaxIndex, settings: LeakSettings, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, limit=PIECE_BYTES):
            found = [(i, item, *best) for i, x in enumerate(leaks_of(texts, index, settings)) for item, best in sorted(x.items())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": texts.rows.column("doc").take(pa.array([x[0] for x in found], pa.int64())),
                    "item_id": pa.array([index.items[x[1]].item_id for x in found], kind),
                    "score": pa.array([x[2] for x in found], pa.float64()),
                    "question_overlap": pa.array([x[3] for x in found], pa.float64()),
                    "answer_overlap": pa.array([x[4] for x in found], pa.float64()),
                }
            )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """A row per document and item it leaks: doc_id, item_id, score, question_overlap, answer_overlap."""
    rows = documents(docs).select(F.struct("doc_id").alias("doc"), "text")
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([rows.schema["doc"], T.StructField("item_id", kind), *T.StructType.fromDDL(
        "score double, question_overlap double, answer_overlap double"
    )])
    found = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, settings):
        found = found.unionByName(in_batches(rows, _find(index, settings, to_arrow_type(kind)), schema))
    return found.select("doc.doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def _keep_clean(index: BlockMaxIndex, settings: LeakSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, limit=PIECE_BYTES):
            yield texts.rows.filter(pa.array([not x for x in leaks_of(texts, index, settings)]))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    rows = packed(docs)
    for index in indexes(benchmark, settings):
        rows = in_batches(rows, _keep_clean(index, settings), rows.schema)
    return unpacked(rows, docs.columns)
