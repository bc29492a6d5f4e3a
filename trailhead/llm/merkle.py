"""Merkle manifest of a dataset: one root digest, and for any row a proof that it is the row which the root covers.

Every row is a leaf, the digest of its framed columns. The leaves of a tree (one for each language), in the order of
their ids, are hashed in runs of `arity` until one digest, the subroot, remains; the subroots, ordered by language,
likewise give the root. A digest stands for the hex text of a sha256.

The digests form a content-addressed graph: the store maps a digest to its children. It is kept in segments, each the
records of up to `levels` levels below one digest, so that a tree of a billion leaves takes three rounds and not thirty.

* Ranks come from one sort by range; no task holds a whole tree, and one language may hold all rows. Rows that are equal
  in all that is sorted are dealt to different tasks.
* Proofs descend from the root. Leaves whose ranks agree in their upper digits take the upper segments together: a
  request for a segment is one row, whatever number of leaves lies below it. In a segment, the digits of the rank choose
  the child, and the children not chosen are collected; the collected path, reversed, is the proof from the leaf up.

Nulls: a null column is framed as `-`, so that a null text differs from an empty one; a null language is a tree of its own
and the first; null ids come first in their tree. Rows of equal id are ordered by leaf; fully repeated rows are leaves of
their own, interchangeable. An empty table has no root (None) and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small, stage

PATH = "array<struct<at: int, others: array<string>>>"
TOP = "top"


@dataclass(frozen=True)
class MerkleSettings:
    """arity   children of a node
    levels  levels of a segment, which then has at most arity ** levels digests at its lower end"""

    arity: int = 2
    levels: int = 10

    @property
    def width(self) -> int:
        return self.arity**self.levels

    def segments(self, n: int) -> int:
        """Segments on the way from the root of a tree of n leaves to a leaf."""
        found = 0
        while n > 1:
            n, found = -(-n // self.width), found + 1
        return found


@dataclass
class Manifest:
    """leaves   tree, rank, leaf, carried (the columns asked for)
    subroots  tree, rank, digest, n (leaves of the tree)
    stores    by kind of tree (languages, top): height int, digest, records (digest, children)
    heights   by kind of tree: segments from its root to a leaf
    root      None if there are no rows
    """

    leaves: DataFrame
    subroots: DataFrame
    stores: dict[str, DataFrame | None]
    heights: dict[str, int]
    root: str | None
    settings: MerkleSettings


def framed(column: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes of the value as text, `:` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[framed(x) for x in columns]), 256)


def tree_name(lang: Column) -> Column:
    """Names sort as the languages do, null first."""
    return F.coalesce(F.concat(F.lit(":"), lang.cast("string")), F.lit("-"))


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds rank, the place from 0 among the rows of one `tree`."""
    by = ["tree", *order, "_tie"]
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(sorted_rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        parts.select("tree", "_part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start")),
        f"{name}-parts",
    )
    return (
        placed.join(small(starts, starts.count()), ["tree", "_part"])
        .withColumn("rank", F.col("_at") + F.col("start"))
        .drop("_at", "_part", "start")
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _segment(settings: MerkleSettings):
    """Hashes the digests of each segment up to its one digest and keeps all records on the way."""
    arity = settings.arity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, keys, children, ends, child_ends = [], [], [], [0], [0]
            for i in range(batch.num_rows):
                now, n = batch.column("digests")[i].as_py(), batch.column("n")[i].as_py()
                for _ in range(settings.levels):
                    if n == 1:
                        break
                    runs = [now[at : at + arity] for at in range(0, len(now), arity)]
                    now = [_sha("".join(x)) for x in runs]
                    keys += now
                    for x in runs:
                        children += x
                        child_ends.append(len(children))
                    n = -(-n // arity)
                tops.append(now[0])
                ends.append(len(keys))
            lists = pa.ListArray.from_arrays(pa.array(child_ends, pa.int32()), pa.array(children, pa.string()))
            records = pa.StructArray.from_arrays([pa.array(keys, pa.string()), lists], ["digest", "children"])
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": batch.column("tree"),
                    "n": batch.column("n"),
                    "place": batch.column("place"),
                    "digest": pa.array(tops, pa.string()),
                    "records": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), records),
                }
            )

    return run


def _grown(nodes: DataFrame, heights: int, settings: MerkleSettings) -> tuple[DataFrame, DataFrame | None]:
    """From tree, n, rank, digest of the leaves: the same of the roots (n is 1), and the store."""
    schema = "tree string, n long, place long, digest string, records array<struct<digest: string, children: array<string>>>"
    store = None
    for height in range(heights):
        place = F.expr(f"rank div {settings.width}").alias("place")
        segments = (
            nodes.groupBy("tree", "n", place)
            .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
            .select("tree", "n", "place", F.col("nodes.digest").alias("digests"))
        )
        grown = stage(segments.mapInArrow(_segment(settings), schema), f"merkle-segments-{height}")
        nodes = grown.select(
            "tree", F.ceil(F.col("n") / settings.width).alias("n"), F.col("place").alias("rank"), "digest"
        )
        # Equal subtrees share one record.
        records = grown.select(F.lit(height).alias("height"), "digest", "records").dropDuplicates(["digest"])
        store = records if store is None else store.unionByName(records)
    return nodes, store


def build(docs: DataFrame, leaf: Column, settings: MerkleSettings = MerkleSettings(), **carried: Column) -> Manifest:
    """The manifest of documents (doc_id, lang, ...) with the given leaf digests; `carried` columns stay with the leaves."""
    leaves = docs.select(
        tree_name(F.col("lang")).alias("tree"),
        F.col("doc_id").alias("_id"),
        leaf.alias("leaf"),
        F.struct(F.col("doc_id"), *[x.alias(name) for name, x in carried.items()]).alias("carried"),
    )
    leaves = _ranked(stage(leaves, "merkle-leaves"), ["_id", "leaf"], "merkle-ranks").drop("_id")
    sizes = stage(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    trees, most = sizes.agg(F.count("*"), F.max("n")).first()
    if not trees:
        return Manifest(leaves, sizes, {TOP: None, "tree": None}, {TOP: 0, "tree": 0}, None, settings)
    heights = {"tree": settings.segments(most), TOP: settings.segments(trees)}
    stores = {}
    nodes = leaves.select("tree", "rank", F.col("leaf").alias("digest")).join(small(sizes, trees), "tree")
    tops, stores["tree"] = _grown(nodes, heights["tree"], settings)
    subroots = tops.select("tree", "digest").join(small(sizes, trees), "tree")
    named = subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest", F.col("n").alias("size"))
    ranked = stage(_ranked(named, ["name"], "merkle-subroots"), "merkle-subroot-ranks")
    last, stores[TOP] = _grown(ranked.withColumn("n", F.lit(trees).cast("long")), heights[TOP], settings)
    subroots = ranked.select(F.col("name").alias("tree"), "rank", "digest", F.col("size").alias("n"))
    return Manifest(leaves, subroots, stores, heights, last.first()["digest"], settings)


def _walk(settings: MerkleSettings, schema: pa.Schema):
    """For each place asked for below a segment's digest: what lies there and the path from the root so far."""
    arity, levels = settings.arity, settings.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i] for x in batch.schema.names}
                records = {x["digest"]: x["children"] for x in row["records"].as_py()}
                asked = batch.column("asked")[i].values
                places, above = asked.field("place").to_pylist(), row["path"].as_py()
                top, depth = row["digest"].as_py(), 0
                below = top
                while below in records and depth < levels:
                    below, depth = records[below][0], depth + 1
                found, paths = [], []
                for place in places:
                    now, path = top, list(above)
                    for level in reversed(range(depth)):
                        children = records[now]
                        at = place // arity**level % arity
                        path.append({"at": at, "others": children[:at] + children[at + 1 :]})
                        now = children[at]
                    found.append(now)
                    paths.append(path)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"].as_py()] * len(places), pa.string()),
                        pa.array([row["subroot"].as_py()] * len(places), pa.string()),
                        asked.field("place"),
                        pa.array(found, pa.string()),
                        pa.array(paths, schema.field("path").type),
                        asked.field("request").cast(schema.field("request").type),
                    ],
                    schema=schema,
                )

    return run


def _descend(start: DataFrame, store: DataFrame | None, heights: int, wanted: DataFrame, settings: MerkleSettings) -> DataFrame:
    """From the roots of trees (tree, subroot, digest, path) to the leaves wanted (tree, rank, request).

    Gives tree, subroot, place, digest, path (from the root on), request.
    """
    kind = wanted.schema["request"].dataType
    path = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
    here = start.withColumn("place", F.lit(0).cast("long"))
    for height in reversed(range(heights)):
        if height:
            asked = wanted.select("tree", F.expr(f"rank div {settings.width**height}").alias("place")).distinct()
            asked = asked.withColumn("request", F.lit(None).cast("string"))
        else:
            asked = wanted.select("tree", F.col("rank").alias("place"), "request")
        name = "string" if height else kind.simpleString()
        arrow = pa.schema(
            [
                ("tree", pa.string()), ("subroot", pa.string()), ("place", pa.int64()), ("digest", pa.string()),
                ("path", path), ("request", _arrow_type(asked)),
            ]
        )
        groups = asked.groupBy("tree", F.expr(f"place div {settings.width}").alias("above")).agg(
            F.collect_list(F.struct("place", "request")).alias("asked")
        )
        met = here.join(groups.withColumnRenamed("above", "place"), ["tree", "place"])
        met = met.join(store.filter(F.col("height") == height).drop("height"), "digest")
        here = met.select("tree", "subroot", "digest", "path", "asked", "records").mapInArrow(
            _walk(settings, arrow), f"tree string, subroot string, place long, digest string, path {PATH}, request {name}"
        )
        if height:
            here = stage(here.drop("request"), f"merkle-open-{height}")
    if heights:
        return here
    return here.join(wanted.withColumnRenamed("rank", "place"), ["tree", "place"])


def _arrow_type(asked: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(asked.schema["request"].dataType)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """For leaves asked for by tree, rank and a struct `request` (default: all, with leaf and what was carried):
    request, subroot, digest (the leaf found at that place) and path, the siblings from the leaf up to the root."""
    settings, spark = manifest.settings, manifest.leaves.sparkSession
    if requests is None:
        requests = manifest.leaves.select("tree", "rank", F.struct("leaf", "carried.*").alias("request"))
    if manifest.root is None:
        empty = f"subroot string, digest string, path {PATH}, request {requests.schema['request'].dataType.simpleString()}"
        return spark.createDataFrame([], empty)
    root = spark.range(1).select(
        F.lit(TOP).alias("tree"), F.lit("").alias("subroot"), F.lit(manifest.root).alias("digest"), F.expr(f"CAST(array() AS {PATH})").alias("path")
    )
    # Of all requests for a tree, one goes through the top.
    trees = manifest.subroots.join(requests.select("tree").distinct(), "tree", "left_semi").select(
        F.lit(TOP).alias("tree"), "rank", F.struct(F.col("tree").alias("tree")).alias("request")
    )
    opened = _descend(root, manifest.stores[TOP], manifest.heights[TOP], trees, settings)
    opened = stage(
        opened.select(F.col("request.tree").alias("tree"), F.col("digest").alias("subroot"), "digest", "path"), "merkle-open"
    )
    found = _descend(opened, manifest.stores["tree"], manifest.heights["tree"], requests, settings)
    return found.select("subroot", "digest", F.reverse("path").alias("path"), "request")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def step(digest: Column, s: Column) -> Column:
        others, at = s["others"], s["at"]
        run = F.concat(F.slice(others, F.lit(1), at), F.array(digest), F.slice(others, at + 1, F.size(others)))
        return F.sha2(F.concat_ws("", run), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, from the leaf up, each run from left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda s: s["others"]))), 256)
