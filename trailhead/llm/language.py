"""Language identification by compression.

Every language has a zstandard dictionary of raw content: whole training texts, put together up to `dictionary_bytes`.
A text is compressed with each dictionary, and the language that makes it smallest wins; of equals, the one with
more training texts. Only letters count: texts are lower-cased, everything else in ASCII becomes a space, and a word
that a block repeats is written once, since repetitions would compress well in any language. Long texts are
compressed in blocks, all of them, so that a dictionary counts as much at the end of a text as at its start. A
prediction is rejected if the runner-up is nearly as small.

The training sample is bounded: of each language's distinct texts, those with the most leading zeros in their
hash, as many zeros as leave about `sample_bytes` (at most twice that, plus one text). It does not depend on the
order of rows. Every language is learned: `pass_languages` at a time, those with most texts first. The driver and
each task hold the dictionaries of one pass; a text takes its smallest sizes so far from pass to pass, so the
answer does not depend on `pass_languages`.

A null text or one without a letter is `und` with score 0. Rows with a null language or text do not teach.
Repeated rows get equal answers. Without any training text every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import documents, stage

UNDETERMINED = "und"
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageSettings:
    """level            zstandard level for texts
    short_level, short_bytes  a higher level for texts up to this length, which finds shorter matches
    pass_languages   dictionaries held at a time
    block_words      texts are compressed in blocks of this many words
    least_margin     predictions whose size margin is below this share are marked as rejected
    """

    dictionary_bytes: int = 1 << 17
    sample_bytes: int = 1 << 18
    pass_languages: int = 256
    block_words: int = 2_000
    level: int = 3
    short_level: int = 19
    short_bytes: int = 256
    least_margin: float = 0.02


# Number of leading zero bits of the hash: each further one halves the texts that have it.
ZEROS = "coalesce(64 - length(bin(CASE WHEN hash <> 0 THEN hash END)), 64)"


def _labelled(docs: DataFrame, teaches: Column) -> DataFrame:
    rows = documents(docs, "lang").filter(teaches & F.col("lang").isNotNull() & (F.length("text") > 0))
    return rows.select("lang", "text", F.xxhash64("text", F.lit(1)).alias("hash")).withColumn("zeros", F.expr(ZEROS))


def learned_languages(docs: DataFrame, teaches: Column, settings: LanguageSettings) -> DataFrame:
    """lang, its place (the one with most texts first) and the least number of zeros of its sample; one row each."""
    by_zeros = (
        _labelled(docs, teaches)
        .groupBy("lang", "hash", "zeros")
        .agg(F.max(F.octet_length("text")).alias("bytes"))
        .groupBy("lang", "zeros")
        .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    )
    from_top = Window.partitionBy("lang").orderBy(F.col("zeros").desc())
    # The most zeros that suffice, else all texts.
    enough = F.max(F.when(F.col("upto") >= settings.sample_bytes, F.col("zeros")))
    languages = (
        by_zeros.withColumn("upto", F.sum("bytes").over(from_top))
        .groupBy("lang")
        .agg(F.sum("n").alias("n"), F.coalesce(enough, F.lit(0)).alias("least"))
    )
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "lang"))
    return stage(languages.select("lang", "least", place.alias("place")), "languages")


def training_texts(docs: DataFrame, teaches: Column, languages: DataFrame) -> dict[str, list[str]]:
    """The bounded samples of these languages, in the order of their places and of hashes."""
    chosen = (
        _labelled(docs, teaches)
        .join(F.broadcast(languages), "lang")  # at most pass_languages rows
        .filter(F.col("zeros") >= F.col("least"))
        .groupBy("place", "lang", "hash")
        .agg(F.min("text").alias("text"))
        .orderBy("place", "hash")
    )
    out: dict[str, list[str]] = {}
    for x in chosen.toLocalIterator():
        out.setdefault(x.lang, []).append(x.text)
    return out


def dictionaries(samples: dict[str, list[str]], settings: LanguageSettings) -> dict[str, bytes]:
    """Equally long for all languages that have enough text, so that none has an advantage."""
    return {
        lang: b" ".join(x for text in texts for x in blocks_of(text, settings))[: settings.dictionary_bytes]
        for lang, texts in samples.items()
    }


def blocks_of(text: str, settings: LanguageSettings) -> list[bytes]:
    """The text as it is compressed: blocks of distinct words."""
    words, size = text.lower().encode().translate(LETTERS).split(), settings.block_words
    return [b" " + b" ".join(dict.fromkeys(words[i : i + size])) + b" " for i in range(0, len(words), size)]


# Language with the smallest size, that size, and the runner-up's size.
Smallest = tuple[str | None, int | None, int | None]


class Classifier:
    def __init__(self, raw: dict[str, bytes], settings: LanguageSettings) -> None:
        self.settings, self.langs = settings, list(raw)
        self.long, self.short = [], []
        for content in raw.values():
            for level, into in ((settings.level, self.long), (settings.short_level, self.short)):
                # Raw content: matches may point anywhere into it, and no header is read from it.
                made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(level=level)
                into.append(
                    zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
                )

    def sizes(self, text: str) -> list[int]:
        blocks = blocks_of(text, self.settings)
        coders = self.short if sum(map(len, blocks)) <= self.settings.short_bytes else self.long
        return [sum(len(x.compress(b)) for b in blocks) for x in coders]

    def smallest(self, text: str | None, so_far: Smallest) -> Smallest:
        """The smallest size with its language, and the runner-up's size, of earlier dictionaries and these."""
        if not text or not any(c.isalpha() for c in text):
            return so_far
        lang, least, second = so_far
        for name, size in zip(self.langs, self.sizes(text)):
            if least is None or size < least:
                lang, least, second = name, size, least
            elif second is None or size < second:
                second = size
        return lang, least, second


def _one_pass(raw: dict[str, bytes], settings: LanguageSettings, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(raw, settings)
        for batch in batches:
            before = zip(*[batch.column(x).to_pylist() for x in ("lang_pred", "least", "second")])
            found = [classifier.smallest(x.as_py(), y) for x, y in zip(batch.column("text"), before)]
            out = {"doc": batch.column("doc")} | ({"text": batch.column("text")} if keep_text else {})
            out["lang_pred"] = pa.array([x[0] for x in found], pa.string())
            out["least"] = pa.array([x[1] for x in found], pa.int64())
            out["second"] = pa.array([x[2] for x in found], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return run


def identify(docs: DataFrame, teaches: Column, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1, the margin) and rejected (the margin is too narrow).

    `teaches` says of which documents text and lang may be learned. Predictions use the text alone. The margin is
    the share by which the runner-up is larger; 1 if there is only one language.
    """
    languages = learned_languages(docs, teaches, settings)
    passes = max(1, -(-languages.count() // settings.pass_languages))
    sizes = "lang_pred string, least long, second long"
    none_yet = [F.lit(None).cast(kind).alias(x) for x, kind in (("lang_pred", "string"), ("least", "long"), ("second", "long"))]
    rows = documents(docs).select(F.struct("doc_id").alias("doc"), "text", *none_yet)
    first = [rows.schema["doc"]]
    for number in range(passes):
        of_pass = F.ceil(F.col("place") / F.lit(settings.pass_languages)) == number + 1
        raw = dictionaries(training_texts(docs, teaches, languages.filter(of_pass)), settings)
        more = number + 1 < passes
        kept = [rows.schema["text"]] if more else []
        schema = T.StructType([*first, *kept, *T.StructType.fromDDL(sizes)])
        rows = rows.mapInArrow(_one_pass(raw, settings, more), schema)
        # Written between passes, so that no plan and no task holds the dictionaries of two.
        rows = stage(rows, "language-pass") if more else rows
    margin = (
        F.when(F.col("lang_pred").isNull(), 0.0)
        .when(F.col("second").isNull(), 1.0)
        .otherwise(1 - F.col("least") / F.col("second"))
    )
    return rows.select(
        "doc.doc_id",
        F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
        margin.alias("score"),
        (margin < settings.least_margin).alias("rejected"),
    )
