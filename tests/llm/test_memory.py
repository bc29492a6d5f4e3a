"""Memory that the operators' steps take on an executor beside its JVM."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext

from trailhead.llm import decontamination, jaccard, quality, sharding
from trailhead.llm.textops import powers

ORDER = jaccard.Order(np.arange(1 << 42, 1 << 61, 1 << 45, dtype=np.uint64))
SETTINGS = jaccard.JaccardSettings()
STEPS = {
    "measure": quality._measure(True),
    "describe": jaccard._describe(ORDER, SETTINGS),
    "whole sets": jaccard._whole_sets(ORDER, SETTINGS),
}


def _batch(texts):
    n = range(len(texts))
    columns = {"doc": n, "key": n, "node": n, "text": texts}
    return pa.RecordBatch.from_pydict({x: pa.array(y) for x, y in columns.items()})


def _peak(step, batch):
    """Most bytes held at once while the step reads the batch, in MB."""
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in step(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture
def texts():
    random = np.random.default_rng(3)
    return [" ".join(f"w{x}" for x in random.integers(0, 50_000, 400)) for _ in range(1_000)]


@pytest.mark.parametrize("name", STEPS)
def test_steps_hold_little(name, texts):
    from trailhead.llm import textops

    textops._powers.clear()
    rows, mb = _peak(STEPS[name], _batch(texts))
    assert rows == len(texts) and mb < 35


def test_counts_hold_one_copy(texts):
    step = jaccard._count_blocks(SETTINGS)
    batch = _batch(texts * 10)
    # The same words in another order each time, so that no text is dropped as a copy.
    random = np.random.default_rng(4)
    mixed = [" ".join(random.permutation(x.split())) for x in batch.column("text").to_pylist()]
    rows, mb = _peak(step, _batch(mixed))
    values = 8 * sum(max(1, len(x.split()) - 4) for x in mixed) / 1e6
    assert mb < 2 * values + 25


def test_counts():
    found = list(jaccard._count_blocks(SETTINGS)(iter([_batch(["a b c d e f", "x a b c d e", "q r s t u", "a b c d e", "a b c d e", None, ""])])))
    assert [x.to_pydict()["n"] for x in found] == [[3]]
    assert [x.num_rows for x in jaccard._count_blocks(SETTINGS)(iter([_batch([None, ""]).cast(_batch(["a"]).schema)]))] in ([], [0])


def test_powers_grow():
    for n in (10, 300_000, 400_000, 1_200_000):
        have = powers(3, n)
        assert len(have) > n and have[0] == 1 and (have[1 : n + 1] == have[:n] * np.uint64(3)).all()


def test_large_groups_need_no_python_workers(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id AS doc_id", "IF(id < 50, repeat('a', 300), concat('b', id)) AS text").localCheckpoint()

    def refused(*args, **kwargs):
        raise AssertionError("rows were sent through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    rows = sharding.assign_shards(docs, sharding.ShardSettings(shards=2)).collect()
    assert sorted(x.doc_id for x in rows) == list(range(60))
    assert {x.shard for x in rows} == {0, 1}


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def no_limit(spark):
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES)


def _sizes(batches):
    for x in batches:
        yield pa.RecordBatch.from_pydict({"rows": [x.num_rows], "bytes": [x.nbytes]})


def test_batches_hold_little(no_limit):
    from trailhead.llm.tables import in_batches

    docs = no_limit.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "repeat(concat(id, 'x'), 600) AS text")
    sizes = in_batches(docs, _sizes, "rows long, bytes long").collect()
    assert sum(x.rows for x in sizes) == 3_000 and max(x.bytes for x in sizes) < 1_200_000
    long = no_limit.range(0, 3, 1, 1).selectExpr("id AS doc_id", "repeat('x', 3000000) AS text")
    assert [x.rows for x in in_batches(long, _sizes, "rows long, bytes long").collect()] == [1, 1, 1]


def test_limit_of_the_caller_is_kept(no_limit):
    from trailhead.llm.tables import in_batches

    no_limit.conf.set(BATCH_BYTES, "100k")
    docs = no_limit.range(0, 3_000, 1, 1).selectExpr("repeat(concat(id, 'x'), 600) AS text")
    assert max(x.bytes for x in in_batches(docs, _sizes, "rows long, bytes long").collect()) < 120_000


@pytest.mark.parametrize(
    "operator",
    [
        quality.judged,
        quality.kept_documents,
        jaccard.one_per_class,
        lambda docs: decontamination.clean_documents(docs, docs.selectExpr("doc_id AS item_id", "text")),
        lambda docs: decontamination.find_leaks(docs, docs.selectExpr("doc_id AS item_id", "text")),
    ],
    ids=["judged", "kept_documents", "one_per_class", "clean_documents", "find_leaks"],
)
def test_operators_bound_their_batches(no_limit, operator):
    rows = [(i, "en", "web", f"a b c d e f g {i}") for i in range(4)]
    operator(no_limit.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()
    assert no_limit.conf.get(BATCH_BYTES, None) == "1m"
