"""Packing of examples into sequences of fixed length, as vector bin packing.

An example has three sizes: its tokens, one segment, and its loss-bearing tokens. A sequence has a limit for each. Sequences
are filled one after the other from a pool of examples: of those that fit, the one with the largest dot product of its
sizes with the room left is placed, each dimension weighed by what the pool demands of it. So a sequence that is short
of segments takes long examples, and one that is short of loss-bearing tokens takes prompts. When nothing fits, the example
with the largest product is cut, and its head fills the sequence; its tail stays in the pool. Examples longer than
a sequence give whole sequences first. A sequence that still does not get full is divided into sequences whose lengths are
powers of two, which need no padding.

Each task packs the rows that it reads, pool after pool, in one pass: nothing is shuffled, and memory is bounded by the
pool and by the longest text. Sequence ids are unique, and the same for the same partitions of the input.

Tokens come from a file of the `tokenizers` library, read by the driver and sent along. A tokenizer that drops white space
encodes a text word by word, so a distinct word is encoded once for many texts, and letters apart from the punctuation
after them. This changes no id (tested against whole texts); texts with the beginning of a special token are left whole.

A token bears loss if it lies behind the prompt and is not the first of its piece, which nothing precedes. Null or empty
texts consist of the closing token. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = "doc_id {id}, start long, length long, ids binary, loss long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackSettings:
    """tokenizer       path of the tokenizer's file
    by_words        it drops white space, ignores case and splits words where letters end
    closing         id behind every example; None for no such id
    max_tokens, max_segments, max_loss   limits of a sequence; powers of two
    pool            examples among which to choose
    chunk_bytes     bytes of text that are encoded together
    cached_words    words whose ids are remembered (up to twice as many); affects only the time
    """

    tokenizer: str
    by_words: bool = True
    closing: int | None = 1
    max_tokens: int = 2048
    max_segments: int = 64
    max_loss: int = 2048
    pool: int = 1024
    chunk_bytes: int = 4_000_000
    cached_words: int = 500_000


# Tokens

# A Latin letter with an ASCII mark after it, between which the tokenizer always cuts. Without U+0130, which becomes two
# characters in lower case, a letter and a mark.
LETTER_MARK = r"([a-zA-ZÀ-ÖØ-öø-įı-ɏ])([!-/:-@\[-`{-~])"
WHITE = re.compile(r"[ \t-\r]")


class Memory:
    """Ids of strings as bytes. Those not asked for while `most` others came in are forgotten."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, asked) -> tuple[dict[str, bytes], list[str]]:
        """The ids of those that are known, and those that are not."""
        young, old = self.young, self.old
        found, new = {}, []
        for x in asked:
            ids = young.get(x)
            if ids is None:
                ids = old.get(x)
                if ids is None:
                    new.append(x)
                    continue
                young[x] = ids
            found[x] = ids
        return found, new

    def keep(self, more: dict[str, bytes]) -> None:
        self.young.update(more)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids of texts. With `by_words`, words are encoded once each."""

    def __init__(self, definition: str, settings: PackSettings) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.settings, self.whole = settings, Tokenizer.from_str(definition)
        # For words of lower-case letters in normal form: neither normaliser nor splitting.
        plain = json.loads(definition) | {"normalizer": None, "added_tokens": []}
        plain["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        self.special = [x["content"].lower()[:2] for x in json.loads(definition)["added_tokens"]]
        self.words = Memory(settings.cached_words)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain, other = [], []
        for word in words:
            letters = word.isalpha() and (
                word.isascii() or (word.lower() == word and unicodedata.is_normalized("NFC", word))
            )
            (plain if letters else other).append(word)
        ids = {}
        for tokenizer, some in ((self.letters, plain), (self.whole, other)):
            for word, found in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                ids[word] = array("I", found.ids).tobytes()
        return ids

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        if not self.settings.by_words or any(x in text for x in self.special for text in texts):
            ids = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)])
        lower = pc.ascii_lower(pa.array(texts, pa.large_string()))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, LETTER_MARK, r"\1 \2"))
        places = lists.flatten().dictionary_encode()
        words = places.dictionary.to_pylist()
        known, new = self.words.known(words)
        learned = self._learn(new)
        self.words.keep(learned)
        known |= learned
        of_word = [known[x] for x in words]
        place = places.indices.to_numpy()
        ids = np.frombuffer(b"".join([of_word[i] for i in place.tolist()]), np.uint32)
        sizes = np.fromiter(map(len, of_word), np.int64, len(words)) // 4
        ends = np.concatenate(([0], np.cumsum(sizes[place])))
        return ids, ends[lists.offsets.to_numpy()]


_encoders: dict[tuple[str, PackSettings], Encoder] = {}


def encoder(definition: str, settings: PackSettings) -> Encoder:
    """One for each Python worker, so that tasks share what it remembers."""
    key = (definition, settings)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, settings)
    return _encoders[key]


def _slices(text: str, limit: int) -> list[str]:
    """A long text in parts that end at white space."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while at < len(text):
        found = WHITE.search(text, at + limit)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


def _encoded(texts: list[str | None], encode: Encoder, settings: PackSettings) -> Iterator[np.ndarray]:
    """The ids of each text. Texts are encoded in chunks."""
    held: list[str] = []
    parts: list[int] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ids, begin = encode(held)
        at = 0
        for n in parts:
            yield ids[begin[at] : begin[at + n]]
            at += n

    for text in texts:
        slices = _slices(text or "", settings.chunk_bytes) if settings.by_words else [text or ""]
        if held and size + len(text or "") > settings.chunk_bytes:
            yield from flush()
            held, parts, size = [], [], 0
        held += slices
        parts.append(len(slices))
        size += len(text or "")
    if held:
        yield from flush()


# Packing


def loss_of(start, end, prompt):
    """Loss-bearing tokens of the piece start:end of an example whose prompt has `prompt` tokens."""
    return np.maximum(0, end - np.maximum(start + 1, prompt))


class Packer:
    """Examples go in by `add`; `done` then holds (example, start, length, sequence, offset). `finish` packs the rest."""

    def __init__(self, settings: PackSettings) -> None:
        self.settings, self.limits = settings, np.array([settings.max_tokens, settings.max_segments, settings.max_loss], float)
        n = settings.pool + 1
        self.example, self.start, self.end, self.prompt = (np.zeros(n, np.int64) for _ in range(4))
        self.sizes = np.zeros((n, 3))
        self.count, self.sequences = 0, 0
        self.done: list[tuple[int, int, int, int, int]] = []

    def add(self, example: int, tokens: int, prompt: int = 0) -> None:
        most, start = self.settings.max_tokens, 0
        while tokens - start >= most and loss_of(start, start + most, prompt) <= self.settings.max_loss:
            self._close([(example, start, most)])
            start += most
        while start < tokens:  # a piece that fits into an empty sequence
            end = min(tokens, start + most, max(start + 1, prompt) + self.settings.max_loss)
            self._put(example, start, end, prompt)
            start = end

    def _put(self, example: int, start: int, end: int, prompt: int) -> None:
        i = self.count
        self.example[i], self.start[i], self.end[i], self.prompt[i] = example, start, end, prompt
        self.sizes[i] = end - start, 1, loss_of(start, end, prompt)
        self.count += 1
        if self.count > self.settings.pool:
            while self.count > self.settings.pool // 2:
                self._fill()

    def finish(self) -> None:
        while self.count:
            self._fill()

    def _remove(self, i: int) -> None:
        self.count -= 1
        for x in (self.example, self.start, self.end, self.prompt, self.sizes):
            x[i] = x[self.count]

    def _fill(self) -> None:
        """One sequence. The pool is not empty."""
        room, placed = self.limits.copy(), []
        weights = self.sizes[: self.count].sum(axis=0) / self.limits**2
        while room[0] and room[1] and self.count:
            sizes = self.sizes[: self.count]
            by = weights * room
            score = sizes[:, 0] * by[0] + sizes[:, 1] * by[1] + sizes[:, 2] * by[2]
            fits = (sizes[:, 0] <= room[0]) & (sizes[:, 2] <= room[2])
            at, gap = -1, int(room[0])
            if room[1] > 1 or not (sizes[:, 0] >= gap).any():
                at = int(np.where(fits, score, -1).argmax())
            if at >= 0 and fits[at]:
                placed.append((int(self.example[at]), int(self.start[at]), int(sizes[at, 0])))
                room -= sizes[at]
                self._remove(at)
                continue
            # The head of an example fills the sequence, as far as its loss-bearing tokens allow.
            start, end, prompt = self.start[: self.count], self.end[: self.count], self.prompt[: self.count]
            length = np.minimum(np.minimum(gap, end - start), np.maximum(start + 1, prompt) + int(room[2]) - start)
            at = int(np.lexsort((-score, -length))[0])
            head = int(length[at])
            placed.append((int(self.example[at]), int(start[at]), head))
            room -= head, 1, loss_of(int(start[at]), int(start[at]) + head, int(prompt[at]))
            if head == end[at] - start[at]:
                self._remove(at)
            else:
                self.start[at] += head
                self.sizes[at] = self.sizes[at, 0] - head, 1, loss_of(self.start[at], self.end[at], self.prompt[at])
        self._close(placed)

    def _close(self, placed: list[tuple[int, int, int]]) -> None:
        """Number a sequence, or the powers of two that make up one that is not full."""
        left, free = sum(x[2] for x in placed), 0
        if left == self.settings.max_tokens:
            free = left
        for example, start, length in placed:
            while length:
                if not free:
                    free = 1 << (left.bit_length() - 1)
                    size = free
                elif left == self.settings.max_tokens and free == left:
                    size = free
                take = min(length, free)
                self.done.append((example, start, take, self.sequences, size - free))
                start, length, free, left = start + take, length - take, free - take, left - take
                if not free:
                    self.sequences += 1


# Spark


def _pack(definition: str, settings: PackSettings, kind: pa.DataType):
    closing = np.array([] if settings.closing is None else [settings.closing], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(settings), encoder(definition, settings)
        examples: dict[int, list] = {}  # doc_id, ids, prompt tokens, tokens not yet packed
        n, base = 0, 0

        def packed() -> pa.RecordBatch:
            done, packer.done = packer.done, []
            columns = list(zip(*done)) if done else [[]] * 5
            of = [examples[x] for x in columns[0]]
            ids = [x[1][start : start + length].astype("<u4").tobytes() for x, start, length in zip(of, columns[1], columns[2])]
            start, length = (np.array(columns[i], np.int64) for i in (1, 2))
            prompt = np.array([x[2] for x in of], np.int64)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in of], kind), pa.array(start), pa.array(length), pa.array(ids, pa.binary()),
                    pa.array(loss_of(start, start + length, prompt)), pa.array([len(x[1]) for x in of], pa.int64()),
                    pa.array(np.array(columns[3], np.int64) + base), pa.array(columns[4], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "loss", "doc_tokens", "sequence_id", "offset"],
            )
            for x, size in zip(columns[0], columns[2]):
                examples[x][3] -= size
                if not examples[x][3]:
                    del examples[x]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column("task")[0].as_py() << 33
            docs = batch.column("doc_id").to_pylist()
            texts, prompts = batch.column("text").to_pylist(), batch.column("prompt").to_pylist()
            bodies = _encoded(texts, encode, settings)
            heads = _encoded(prompts, encode, settings) if any(prompts) else None
            for doc, body in zip(docs, bodies):
                head = next(heads) if heads else body[:0]
                ids = np.concatenate([head, body, closing])
                if len(ids):
                    examples[n] = [doc, ids, len(head), len(ids)]
                    packer.add(n, len(ids), len(head))
                    n += 1
                if len(packer.done) >= 4 * settings.pool:
                    yield packed()
            yield packed()
        packer.finish()
        yield packed()

    return run


def pack(docs: DataFrame, settings: PackSettings, text: Column | None = None, prompt: Column | None = None) -> DataFrame:
    """The pieces of all examples: doc_id, start (tokens of the example before it), length, ids (little-endian unsigned
    32-bit), loss (loss-bearing tokens), doc_tokens, sequence_id, offset (place in the sequence)."""
    from pyspark.sql.pandas.types import to_arrow_type

    with open(settings.tokenizer, encoding="utf-8") as file:
        definition = file.read()
    rows = docs.select(
        "doc_id",
        (F.col("text") if text is None else text).cast("string").alias("text"),
        (F.lit(None) if prompt is None else prompt).cast("string").alias("prompt"),
        F.spark_partition_id().alias("task"),
    )
    kind = docs.schema["doc_id"].dataType
    return rows.mapInArrow(_pack(definition, settings, to_arrow_type(kind)), PIECE.format(id=kind.simpleString()))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row a sequence: sequence_id, ids, and its pieces in order (doc_id, start, length, loss)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length", "loss")))
    grouped = pieces.groupBy("sequence_id").agg(inside.alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    parts = F.transform("pieces", lambda x: F.struct(*[x[y].alias(y) for y in ("doc_id", "start", "length", "loss")]))
    return grouped.select("sequence_id", ids.alias("ids"), parts.alias("pieces"))
