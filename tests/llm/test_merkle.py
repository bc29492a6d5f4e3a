"""The manifest against a tree built from lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trailhead.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, `a.b` int"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if row[x] is None else f"{len(str(row[x]).encode())}:{row[x]}" for x in COLUMNS))


def climb(nodes, arity):
    """The last digest and, of each node, its siblings from the bottom up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(at, min(at + arity, len(nodes))) for at in range(0, len(nodes), arity)]
        for run in runs:
            for i in run:
                for leaf in owners[i]:
                    paths[leaf].append([nodes[j] for j in run if j != i])
        owners = [[x for i in run for x in owners[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def brute(rows, arity):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {x: climb([leaf for _, _, leaf in sorted(trees[x])], arity) for x in names}
    root, above = climb([below[x][0] for x in names], arity)
    out = []
    for x, top in zip(names, above):
        for (has, i, leaf), path in zip(sorted(trees[x]), below[x][1]):
            out.append((i if has else None, leaf, below[x][0], sha("".join(d for run in path + top for d in run))))
    return root, sorted(out, key=str)


def of(docs, settings):
    return merkle.build(docs, merkle.leaf_digest(*[F.col(x) for x in COLUMNS]), settings)


def proved(manifest):
    return merkle.prove(manifest).select(
        F.col("request.doc_id").alias("doc_id"), F.col("request.leaf").alias("leaf"), "digest", "subroot",
        merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("request.leaf"), F.col("path")).alias("folded"),
    ).collect()


@pytest.mark.parametrize("arity, levels, n", [(2, 1, 70), (2, 3, 333), (2, 10, 333), (3, 2, 200), (4, 1, 65), (2, 2, 1)])
def test_proofs_equal_those_of_lists(spark, arity, levels, n):
    rng = random.Random(n)
    langs = ["en"] * 6 + ["de", "é", "z", None, ""] + [f"l{i}" for i in range(3)]
    rows = [
        {"doc_id": rng.choice([None, 5, 7, *range(100, 100 + n)]), "text": rng.choice([None, "", "a:b", "é" * 30, f"t{i}"]),
         "lang": rng.choice(langs), "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, -3, 12])}
        for i in range(n)
    ]
    rows += rows[:20]  # repeated rows
    frame = spark.createDataFrame([(*[r[x] for x in ("doc_id", "text", "lang", "source", "n_chars")], "t", 1, 2) for r in rows], SCHEMA)
    manifest = of(frame.repartition(3), merkle.MerkleSettings(arity, levels))
    root, expected = brute(rows, arity)
    assert manifest.root == root
    found = proved(manifest)
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.proof) for x in found), key=str) == expected
    assert all(x.digest == x.leaf and x.folded == root for x in found)


def test_some_leaves_only_and_store(spark):
    frame = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"),
        F.lit(4).alias("n_chars"),
    )
    manifest = of(frame, merkle.MerkleSettings(2, 4))
    asked = spark.createDataFrame([(":en", 499, (1,)), (":en", 3, (2,))], "tree string, rank long, request struct<no: int>")
    found = merkle.prove(manifest, asked).select(
        "request.no", "digest", merkle.folded(F.col("digest"), F.col("path")).alias("folded"), F.size("path").alias("n")
    ).collect()
    leaves = {x["rank"]: x.leaf for x in manifest.leaves.collect()}
    assert {(x.no, x.digest, x.folded, x.n) for x in found} == {(1, leaves[499], manifest.root, 9), (2, leaves[3], manifest.root, 9)}
    records = manifest.stores["tree"].select(F.explode("records").alias("r")).select("r.*").collect()
    assert all(sha("".join(x.children)) == x.digest for x in records)


def test_equal_subtrees_share_a_record(spark):
    frame = spark.createDataFrame([(1, "x", "en", "s", 1)] * 64, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = of(frame, merkle.MerkleSettings(2, 2))
    assert manifest.stores["tree"].count() == 3  # one for each height
    assert {x.folded for x in proved(manifest)} == {manifest.root}


def test_empty_table(spark):
    manifest = of(spark.createDataFrame([], SCHEMA), merkle.MerkleSettings())
    assert manifest.root is None and merkle.prove(manifest).collect() == []
