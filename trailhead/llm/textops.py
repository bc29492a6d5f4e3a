"""Array forms of text: words, lines and hashes of many texts at once, for use inside tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are handled as UTF-8 bytes. All hashes have 64 bits.
Strings of up to `SHORT` bytes are hashed by a polynomial modulo 2**64, which gives the hash of every place at once. There are
pairs of longer strings that such a polynomial cannot tell apart, whatever its base, so those are hashed one by one with
xxh3. Two different strings are taken for equal with a chance of about 2**-64 per pair; for short ones made to collide (two
letters in the order of the Thue-Morse sequence), 2**-54.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1_000_000
# For steps with many arrays beside the text: some 100 bytes of memory for each byte of a piece.
PIECE_BYTES = 250_000
SHORT = 16
U64 = np.uint64

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _random.integers(1, 2**64, 256, dtype=U64) | U64(1)
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] = SAME[97:123]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
STEP = U64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, PIECE_BYTES if have is None else min(2 * n, CHUNK_BYTES)) + 1, base, U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64, out=have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (the finalizer of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@dataclass
class Texts:
    """Some rows of a record batch: `data` holds the bytes of all texts, text i at bounds[i]:bounds[i+1]."""

    rows: pa.RecordBatch
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of bytes of each text for which `flags` is set."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def prefix_hashes(self, folding: np.ndarray = SAME) -> Prefix:
        """Running sums from which `span_hashes` gets the hash of any substring, after each byte is replaced by another."""
        n, data = len(self.data), self.data if folding is SAME else folding[self.data]
        sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODES[data] * powers(BASE, n)[:n], dtype=U64, out=sums[1:])
        return Prefix(sums, data)


@dataclass
class Prefix:
    sums: np.ndarray
    data: np.ndarray


def span_hashes(prefix: Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes starts[i]:ends[i], for each i."""
    sums, lengths = prefix.sums, ends - starts
    out = mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts] + lengths.astype(U64))
    long = np.flatnonzero(lengths > SHORT)
    if len(long):
        data, one = prefix.data.tobytes(), xxhash.xxh3_64_intdigest
        spans = zip(starts[long].tolist(), ends[long].tolist())
        out[long] = np.fromiter((one(data[a:b]) for a, b in spans), U64, len(long))
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut record batches into pieces of at most about `limit` bytes of text (one text may be longer); a null text is empty."""
    for batch in batches:
        texts = batch.column(column)
        if len(texts) == 0:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        if texts.null_count:  # a null has no bytes, whatever its slot holds
            values = [x.as_py() for x in texts]
            joined = [(x or "").encode() for x in values]
            data = np.frombuffer(b"".join(joined), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in joined], dtype=np.int64)))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Texts(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


@dataclass
class Words:
    """The words of some texts: byte spans, and `first[i]:first[i+1]` are the words of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts) -> Words:
    solid = ~IS_SPACE[texts.data]
    n = len(solid)
    edge = np.zeros(n + 1, bool)
    edge[texts.bounds] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:n] if n else solid
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate((solid[1:], [False])) & ~edge[1:] if n else solid
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds))


def word_hashes(texts: Texts, words: Words, folding: np.ndarray = SAME) -> np.ndarray:
    return span_hashes(texts.prefix_hashes(folding), words.starts, words.ends)


def _windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, ignoring where texts end."""
    n = len(hashes) - k + 1
    out = np.full(max(n, 0), k, U64)
    for i in range(k if n > 0 else 0):
        out = (out + hashes[i : i + n]) * STEP
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, in order, and where each text's runs begin.

    With `short`, a text of fewer than k words (but at least one) gives one run, its whole sequence.
    """
    counts = np.diff(first)
    runs = np.maximum(counts - k + 1, 0)
    if short:
        runs = np.where((counts > 0) & (runs == 0), 1, runs)
    begin = np.concatenate(([0], np.cumsum(runs)))
    text_of = np.repeat(np.arange(len(counts)), runs)
    at = first[text_of] + np.arange(begin[-1]) - begin[text_of]
    full = _windows(hashes, k)
    is_short = counts[text_of] < k
    out = np.zeros(begin[-1], U64)
    out[~is_short] = full[at[~is_short]]
    for n in range(1, k if short else 1):
        here = counts[text_of] == n
        if here.any():
            out[here] = _windows(hashes, n)[at[here]]
    return out, begin


def sorted_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each text's values and drop repeats; values and where each text's begin."""
    values = values.copy()
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[begin[:-1][begin[:-1] < len(values)]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return values[new], total[begin]
