"""Every id in exactly one piece, all limits kept, and ids equal to those of whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailhead.llm import packing, queries

from ..conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "don't I'LL we've 'tis dogs' x's", "École ÉCOLE école Straße STRASSE İstanbul ΣΊΣΥΦΟΣ", "a\x1cb\x85c d e",
    "x² ½ 12345 ３ a1b2", "<|endoftext|>a <|startoftext|>", "漢字かな 한글 अनुच्छेद", "́alone Ä ǅ ﬁ", "a" * 3000 + "###", "…“quoted”—dash_under_score", "emoji👩‍👩‍👧 ok", "\x00\x01 ﻿bom",
]


def whole(text):
    if not hasattr(whole, "tokenizer"):
        whole.tokenizer = Tokenizer.from_file(PATH)
    return whole.tokenizer.encode(text or "", add_special_tokens=False).ids


def check(rows, expected, settings, prompts=None):
    """rows: pieces; expected: the ids of each doc_id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        assert x.length == len(x.ids) // 4 and x.doc_tokens == len(expected[x.doc_id])
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    assert set(by_doc) == set(expected)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda x: x.start)
        assert [x.start for x in pieces] == [0, *np.cumsum([x.length for x in pieces])[:-1].tolist()]
        assert b"".join(x.ids for x in pieces) == np.array(expected[i], "<u4").tobytes()
        for x in pieces:
            assert x.loss == sum(x.start < t and t >= (prompts or {}).get(i, 0) for t in range(x.start, x.start + x.length))
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda x: x.offset)
        ends = np.cumsum([x.length for x in pieces]).tolist()
        assert [x.offset for x in pieces] == [0, *ends[:-1]]
        assert ends[-1] <= settings.max_tokens and len(pieces) <= settings.max_segments
        assert sum(x.loss for x in pieces) <= settings.max_loss
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else settings.max_tokens - ends[-1]
    assert padding == 0
    return by_sequence


def test_odd_texts_have_the_ids_of_whole_texts(spark):
    frame = spark.createDataFrame([(i, x, "t", 1) for i, x in enumerate(ODD)], "doc_id long, text string, task string, `a.b` int")
    settings = packing.PackSettings(PATH, chunk_bytes=40)
    check(packing.pack(frame, settings).collect(), {i: [*whole(x), 1] for i, x in enumerate(ODD)}, settings)
    assert packing.pack(frame.limit(0), settings).collect() == []


def test_random_words_have_the_ids_of_whole_texts():
    rng = random.Random(1)
    letters = "abcXYZéÉßİıΣς'’.,#_-12²漢́   \t\n"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    with open(PATH, encoding="utf-8") as file:
        encode = packing.Encoder(file.read(), packing.PackSettings(PATH))
    ids, begin = encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [whole(x) for x in texts]


def test_query_covers_all_documents(spark):
    folder = f"{DATA}/sf0.001"
    rows = queries.op12_packing(spark, folder).collect()
    texts = {x["doc_id"]: x["text"] for x in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    ids = {i: np.array([*whole(x), 1], "<u4") for i, x in texts.items()}
    assert {x.doc_id for x in rows} == set(ids) and sum(x.length for x in rows) == sum(map(len, ids.values()))
    assert all(x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes()) for x in rows)
    used = defaultdict(int)
    for x in rows:
        used[x.sequence_id] += x.length
    assert sum(x == 2048 for x in used.values()) > 0.9 * len(used)


@pytest.mark.parametrize("tokens, segments, loss, pool", [
    (64, 64, 64, 16), (64, 4, 64, 16), (64, 4, 16, 16), (16, 2, 8, 4), (8, 1, 8, 1), (8, 8, 1, 5), (64, 64, 4096, 200),
])
def test_limits_with_prompts(spark, tokens, segments, loss, pool):
    rng = random.Random(tokens + segments + loss)
    rows = []
    for i in range(300):
        words = [rng.choice([0, 0, 1, 5, 20, 300]) for _ in range(2)]
        rows.append((i, *(" ".join(["the"] * n) if n or rng.random() < 0.5 else None for n in words)))
    frame = spark.createDataFrame(rows, "doc_id long, question string, answer string").repartition(3)
    settings = packing.PackSettings(PATH, max_tokens=tokens, max_segments=segments, max_loss=loss, pool=pool)
    found = packing.pack(frame, settings, text=F.col("answer"), prompt=F.col("question"))
    expected = {i: [*whole(a), *whole(b), 1] for i, a, b in rows}
    by_sequence = check(found.collect(), expected, settings, {i: len(whole(a)) for i, a, _ in rows})
    joined = {x.sequence_id: x for x in packing.sequences(found).collect()}
    assert {k: b"".join(x.ids for x in v) for k, v in by_sequence.items()} == {k: bytes(x.ids) for k, x in joined.items()}
    assert all(sum(p.length for p in x.pieces) * 4 == len(x.ids) for x in joined.values())


def test_hot_empty_texts_and_long_ones(spark):
    rows = [(i, None if i % 3 else "the " * (i % 50)) for i in range(6000)] + [(10**6, "the dog " * 400_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    settings = packing.PackSettings(PATH)
    found = packing.pack(frame, settings).select("doc_id", "length", "sequence_id", "doc_tokens").collect()
    assert sum(x.length for x in found) == sum(len((x or "").split()) + 1 for _, x in rows)
    assert {x.doc_tokens for x in found if x.doc_id == 10**6} == {800_001}


def test_other_tokenizers_encode_whole_texts(spark):
    settings = packing.PackSettings(public_tokenizers.path("byte_bpe_50k.json"), by_words=False, closing=50256)
    tokenizer = Tokenizer.from_file(settings.tokenizer)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    expected = {i: [*tokenizer.encode(x or "", add_special_tokens=False).ids, 50256] for i, x in enumerate(ODD)}
    check(packing.pack(frame, settings).collect(), expected, settings)
