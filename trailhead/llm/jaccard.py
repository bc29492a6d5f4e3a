"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least a given share, and their components.

Exact. Two sets that similar share a shingle among the first n - ceil(similarity * n) + 1 of each, in any order common
to all sets. The order puts shingles found in many documents last, so that shared passages and family texts hardly
ever bring documents together by themselves.

* Equal sets are one node; nodes with identical prefixes and equal size are one group.
* Groups, not documents, are joined on prefix shingles. Buckets with one group are dropped; a group of several nodes is
  also a bucket of its own. Group pairs are filtered, then expanded into pairs of nodes.
* Parity signatures of whole sets drop pairs that differ too much, with no link lost.
* Pairs are first compared by their prefixes, which bound how similar the sets can be, then verified on whole sets.
* Only components are wanted, so not all pairs of a bucket are needed: rounds of stars
  pair every node with one leader of its bucket, where components still differ; after that the pairs of a bucket
  whose nodes are in different components are all verified. So no link between different components is lost,
  and the many pairs inside a component are never listed.

Words are case-folded for A-Z only. Shingles are 62-bit hashes and sets are identified by a 64-bit hash.
A text with fewer words than a shingle is one shingle; null texts and texts without words are linked with nothing.
Repeated rows are equal documents. A null doc_id counts as larger than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import documents, in_batches, row_key, small, stage
from .textops import LOWER, PIECE_BYTES, U64, Texts, chunks, mix, shingles, sorted_sets, span_hashes, word_hashes, words_of


@dataclass(frozen=True)
class JaccardSettings:
    """common_least, common_most  a shingle counted this often comes late in the order; at most so many do.
                     They change the amount of work only.
    count_block      shingles are first counted in blocks of this many, equal texts of a block once; those found
                     once in a block are not passed on, which again only affects the order
    stars, few_pairs rounds of stars before the remaining pairs are verified; fewer if at most `few_pairs` pairs
                     remain for each row of a bucket
    hub_pairs        pairs of one leader that are verified together
    signature_words  64-bit words of a set's signature. They change the amount of work only; a set of up to about
                     64 times so many shingles is told from unrelated ones
    """

    shingle: int = 5
    percent: int = 80
    common_least: int = 20
    common_most: int = 1 << 18
    count_block: int = 8_000_000
    stars: int = 3
    few_pairs: int = 2
    hub_pairs: int = 64
    signature_words: int = 16

    def prefix_length(self, n):
        return n - -(-self.percent * n // 100) + 1


def _shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(texts)
    values, begin = shingles(word_hashes(texts, words, LOWER), words.first, k)
    return values >> U64(2), begin


def _count_blocks(settings: JaccardSettings):
    def counted(values: list[np.ndarray]) -> pa.RecordBatch:
        """Empties `values`, and sorts in place: a block is the most that a task holds, so there is one copy of it."""
        found = np.concatenate(values)
        values.clear()
        found.sort()
        edge = np.ones(len(found) + 1, bool)
        np.not_equal(found[1:], found[:-1], out=edge[1:-1])
        # Where a value follows that is equal to it: first places of those found again.
        first = np.flatnonzero(edge[:-1] & ~edge[1:])
        last = np.flatnonzero(~edge[:-1] & edge[1:])
        return pa.RecordBatch.from_pydict({"shingle": found[first].view(np.int64), "n": last - first + 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, np.zeros(0, U64)
        for texts in chunks(batches, limit=PIECE_BYTES):
            values, begin = _shingles(texts, settings.shingle)
            content = span_hashes(texts.prefix_hashes(), texts.bounds[:-1], texts.bounds[1:])
            _, one = np.unique(content, return_index=True)
            one = one[~np.isin(content[one], seen)]
            seen = np.concatenate([seen, content[one]])
            new = np.zeros(len(texts), bool)
            new[one] = True
            held.append(values[np.repeat(new, np.diff(begin))])
            n += len(held[-1])
            if n >= settings.count_block:
                yield counted(held)
                held, n, seen = [], 0, np.zeros(0, U64)
        if held:
            yield counted(held)

    return run


def common_shingles(docs: DataFrame, settings: JaccardSettings) -> np.ndarray:
    """Common shingles, the most common last. At most `common_most`."""
    counts = in_batches(docs.select("text"), _count_blocks(settings), "shingle long, n long")
    common = (
        counts.groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= settings.common_least)
        .orderBy(F.col("n").desc(), "shingle")
        .limit(settings.common_most)
        .toPandas()
    )
    return common["shingle"].to_numpy(np.int64).view(U64)[::-1].copy()


class Order:
    """Replaces shingles by numbers in the common order: common ones come after all others."""

    def __init__(self, common: np.ndarray) -> None:
        by_value = np.argsort(common)
        self.values, self.places = common[by_value], by_value.astype(U64) + U64(1 << 62)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(common >> U64(42)).astype(np.int64)] = True

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        out = shingle.copy()
        check = np.flatnonzero(self.maybe[(shingle >> U64(42)).astype(np.int64)])
        if len(check) and len(self.values):
            at = np.minimum(np.searchsorted(self.values, shingle[check]), len(self.values) - 1)
            hit = self.values[at] == shingle[check]
            out[check[hit]] = self.places[at[hit]]
        return out


def _set_key(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hash of each set."""
    spread = mix(values + U64(0x9E3779B97F4A7C15))
    full = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros(len(begin) - 1, U64)
    if len(full):
        at = begin[full]
        total, parity = np.add.reduceat(spread, at), np.bitwise_xor.reduceat(spread, at)
        out[full] = mix(total * U64(0xD6E8FEB86659FD93) + parity)
    return out


def signatures(values: np.ndarray, begin: np.ndarray, words: int, rows: int = 1024) -> pa.ListArray:
    """Of each set, which of 64 * `words` hash slots hold an odd number of its elements.

    Two sets have at least as many elements in only one of them as their signatures have differing bits.
    """
    bits, out = 64 * words, []
    for first in range(0, len(begin) - 1, rows):
        at = begin[first : first + rows + 1].astype(np.int64)
        slot = (mix(values[at[0] : at[-1]]) % U64(bits)).astype(np.int64)
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        odd = np.bincount(of * bits + slot, minlength=(len(at) - 1) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(begin)) * words, pa.int32()), pa.array(flat))


def _describe(order: Order, settings: JaccardSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, limit=PIECE_BYTES):
            values, begin = _shingles(texts, settings.shingle)
            values, begin = sorted_sets(order(values), begin)
            n = np.diff(begin)
            lengths = np.where(n > 0, settings.prefix_length(n), 0)
            first = np.concatenate(([0], np.cumsum(lengths)))
            prefixes = values[np.repeat(begin[:-1] - first[:-1], lengths) + np.arange(first[-1])]
            group = mix(_set_key(prefixes, first) + n.astype(U64))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": texts.rows.column("doc"),
                    "key": texts.rows.column("key"),
                    "n": pa.array(n, pa.int64()),
                    "node": pa.array(_set_key(values, begin).view(np.int64)),
                    "prefix_group": pa.array(group.view(np.int64)),
                    "signature": signatures(values, begin, settings.signature_words),
                    "prefix": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(prefixes.view(np.int64))),
                }
            )

    return run


def _whole_sets(order: Order, settings: JaccardSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches, limit=PIECE_BYTES):
            values, begin = _shingles(texts, settings.shingle)
            values, begin = sorted_sets(order(values), begin)
            yield pa.RecordBatch.from_pydict(
                {
                    "node": texts.rows.column("node"),
                    "n": pa.array(np.diff(begin), pa.int64()),
                    "values": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values.view(np.int64))),
                }
            )

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(few) else 0


def sets_link(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    both = _common(a, b)
    return 100 * both >= percent * (n_a + n_b - both)


def prefixes_may_link(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """Whether sets with these prefixes (and sizes) can be similar enough.

    Up to the smaller of the two last elements both sets are known. Beyond it they have at most the rest in common.
    """
    end = min(a[-1], b[-1])
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    both = _common(a, b) + min(n_a - len(a), n_b - len(b))
    return 100 * both >= percent * (n_a + n_b - both)


def _compare_to_leaders(passes, percent: int):
    """Rows sorted by leader; each leader's own row comes first. Yields the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held, held_n = None, None, 0
        for batch in batches:
            nodes, leaders = batch.column("node").to_pylist(), batch.column("leader").to_pylist()
            lists, sizes = batch.column("values"), batch.column("n").to_pylist()
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            offsets = (offsets - offsets[0]).tolist()
            found = []
            for i, (node, to, n) in enumerate(zip(nodes, leaders, sizes)):
                values = flat[offsets[i] : offsets[i + 1]]
                if node == to:
                    leader, held, held_n = to, values.copy(), n
                else:
                    assert to == leader
                    if passes(values, n, held, held_n, percent):
                        found.append((to, node))
            yield pa.RecordBatch.from_pydict(
                {"leader": pa.array([x[0] for x in found], pa.int64()), "node": pa.array([x[1] for x in found], pa.int64())}
            )

    return run


def compared(pairs: DataFrame, values: DataFrame, passes, settings: JaccardSettings) -> DataFrame:
    """Those of the distinct pairs (leader, node) that pass, given node, n, values of all their nodes.

    A leader with many pairs is dealt to several tasks, to each with a part of its nodes.
    """
    hubs = stage(
        pairs.groupBy("leader").agg(F.count("*").alias("n")).filter(F.col("n") > settings.hub_pairs), "jaccard-hubs"
    )
    parts = F.coalesce(F.ceil(F.col("n") / settings.hub_pairs), F.lit(1)).cast("int")
    dealt = pairs.join(small(hubs, hubs.count()), "leader", "left").select(
        "leader", "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")
    )
    sent = dealt.union(dealt.select("leader", F.col("leader").alias("node"), "part").distinct())
    rows = (
        sent.join(values, "node")
        .repartition("leader", "part")
        .sortWithinPartitions("leader", "part", F.col("leader") != F.col("node"))
        .select("leader", "node", "n", "values")
    )
    return in_batches(rows, _compare_to_leaders(passes, settings.percent), "leader long, node long")


def _nodes_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node of all nodes in the pairs, marked for broadcasting if there are few."""
    wanted = pairs.select(F.explode(F.array("leader", "node")).alias("node")).distinct()
    wanted = stage(nodes.select("key", "node").join(wanted, "node", "left_semi"), "jaccard-wanted")
    return small(wanted, wanted.count())


def _compatible(a: str, b: str, percent: int):
    """Sizes that allow the similarity."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _buckets(described: DataFrame, nodes: DataFrame) -> DataFrame:
    """bucket, node, n: nodes that share a prefix shingle or a whole prefix, buckets of two nodes or more."""
    groups = nodes.groupBy("prefix_group").agg(
        F.min(F.struct("node", "key")).alias("first"), F.count("*").alias("members")
    )
    groups = stage(groups, "jaccard-groups")
    firsts = groups.select(F.col("first.key").alias("key"))
    # Joined by shuffle on purpose: the rows then lie by key, as dropping repeats needs them.
    one_each = described.select("key", "prefix", "prefix_group").join(
        firsts.hint("merge"), "key", "left_semi"
    ).dropDuplicates(["key"])
    in_bucket = Window.partitionBy("bucket").orderBy("prefix_group")
    shared = (
        one_each.select(F.explode("prefix").alias("bucket"), "prefix_group")
        .withColumns({"before": F.lag("prefix_group").over(in_bucket), "after": F.lead("prefix_group").over(in_bucket)})
        .filter("before IS NOT NULL OR after IS NOT NULL")
    )
    shared = stage(shared.select("bucket", "prefix_group"), "jaccard-shared")
    members = nodes.select("prefix_group", "node", "n")
    several = nodes.join(groups.filter("members > 1").select("prefix_group"), "prefix_group", "left_semi").select(
        F.col("prefix_group").alias("bucket"), "node", "n"
    )
    return stage(
        shared.join(members, "prefix_group").select("bucket", "node", "n").unionByName(several), "jaccard-buckets"
    )


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets with the component of each node; those that lie in one component are dropped."""
    if labels is None:
        rows = buckets.withColumn("component", F.col("node"))
    else:
        rows = buckets.join(labels.toDF("node", "label"), "node", "left").withColumn(
            "component", F.coalesce("label", "node")
        )
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(mixed.filter("low <> high").select("bucket"), "bucket", "left_semi").select(
        "bucket", "node", "n", "component"
    )


def _stars(rows: DataFrame, turn: int, settings: JaccardSettings) -> DataFrame:
    """Each node with one leader of its buckets, of another component; the leaders change with `turn`.

    Of several leaders it is the one met in most buckets, so there are never more pairs than nodes.
    """
    leader = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "component"))
    leaders = rows.groupBy("bucket").agg(leader.alias("leader"))
    return (
        rows.join(leaders, "bucket")
        .filter((F.col("component") != F.col("leader.component")) & _compatible("n", "leader.n", settings.percent))
        .groupBy("node", F.col("leader.node").alias("leader"))
        .agg(F.count("*").alias("shared"))
        .groupBy("node")
        .agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader"))
        .select("leader", "node")
    )


def _near_signatures(a: str, b: str, sizes: Column, settings: JaccardSettings) -> Column:
    """Whether sets with these signatures, of `sizes` elements together, can be similar enough."""
    words = range(settings.signature_words)
    differing = reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in words])
    return differing * (100 + settings.percent) <= (100 - settings.percent) * sizes


def _remaining(rows: DataFrame, nodes: DataFrame, settings: JaccardSettings) -> DataFrame:
    """The pairs of nodes that share a bucket, lie in different components and may be similar.

    Groups are paired, not nodes, and only then expanded. Two groups that share many buckets, as those around one
    passage do, are paired where they first meet: not in a bucket that follows, for both, the same other bucket, since
    they have met there. So a pair of groups is listed about once, however many shingles it shares. Sizes, and the
    signatures of groups of one node, are compared where groups meet; those of all nodes after expanding.
    """
    percent = settings.percent
    held = rows.join(nodes.select("node", "prefix_group", "signature"), "node")
    own = held.filter(F.col("bucket") == F.col("prefix_group"))
    one_group = own.select("bucket", "node", "n", "component", "signature")
    other = one_group.toDF("bucket", "leader", "leader_n", "leader_component", "leader_signature")
    inside = one_group.join(other, "bucket").filter(
        (F.col("component") != F.col("leader_component"))
        & (F.col("node") > F.col("leader"))
        & _near_signatures("signature", "leader_signature", F.col("n") + F.col("leader_n"), settings)
    )

    in_order = Window.partitionBy("prefix_group").orderBy("bucket")
    groups = (
        held.filter(F.col("bucket") != F.col("prefix_group"))
        .groupBy("bucket", "prefix_group", "n")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.when(F.count("*") == 1, F.first("signature")).alias("signature"),
        )
        .withColumn("before", F.lag("bucket").over(in_order))
    )
    left = groups.toDF(*["bucket" if x == "bucket" else f"a_{x}" for x in groups.columns])
    right = groups.toDF(*["bucket" if x == "bucket" else f"b_{x}" for x in groups.columns])
    one_component = (F.least("a_low", "b_low") == F.greatest("a_high", "b_high"))
    met_before = F.coalesce(F.col("a_before") == F.col("b_before"), F.lit(False))
    near = _near_signatures("a_signature", "b_signature", F.col("a_n") + F.col("b_n"), settings)
    pairs = (
        left.join(right, "bucket")
        .filter(
            (F.col("a_prefix_group") < F.col("b_prefix_group"))
            & ~met_before
            & ~one_component
            & _compatible("a_n", "b_n", percent)
            & F.coalesce(near, F.lit(True))
        )
        .select("a_prefix_group", "b_prefix_group")
        .distinct()
    )
    members = held.select("prefix_group", "node", "n", "component", "signature").dropDuplicates(["node"])
    expanded = (
        pairs.join(members.toDF("a_prefix_group", "a", "a_n", "a_component", "a_signature"), "a_prefix_group")
        .join(members.toDF("b_prefix_group", "b", "b_n", "b_component", "b_signature"), "b_prefix_group")
        .filter((F.col("a_component") != F.col("b_component")) & near)
        .select(F.least("a", "b").alias("leader"), F.greatest("a", "b").alias("node"))
    )
    return inside.select("leader", "node").unionByName(expanded)


def _remaining_bound(rows: DataFrame) -> int:
    """At least the number of pairs that `_remaining` would look at, counted bucket by bucket."""
    sizes = rows.groupBy("bucket").agg(F.count("*").cast("double").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    if tested is None:
        return pairs
    either = tested.union(tested.select("node", "leader")).toDF("leader", "node")
    return pairs.join(either, ["leader", "node"], "left_anti")


def classes(docs: DataFrame, settings: JaccardSettings = JaccardSettings()) -> DataFrame:
    """Per document: doc_id, key (see tables.row_key), n_shingles, node (of its set) and component_id."""
    docs = documents(docs)
    order = Order(common_shingles(docs, settings))
    schema = (
        f"doc struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}>, key long, n long, node long, "
        "prefix_group long, signature array<long>, prefix array<long>"
    )
    keyed = docs.select(F.struct("doc_id").alias("doc"), row_key().alias("key"), "text")
    described = stage(in_batches(keyed, _describe(order, settings), schema), "jaccard-documents")
    nodes = described.filter("n > 0").groupBy("node").agg(
        F.first("n").alias("n"),
        F.first("prefix_group").alias("prefix_group"),
        F.first("signature").alias("signature"),
        F.min("key").alias("key"),
        F.min("doc.doc_id").alias("least_id"),
    )
    nodes = stage(nodes, "jaccard-nodes")
    buckets = _buckets(described, nodes)

    prefixes = described.select("key", "n", F.col("prefix").alias("values"))

    labels, tested = None, None
    for turn in range(settings.stars + 1):
        rows = stage(_labelled(buckets, labels), "jaccard-mixed") if turn else buckets.withColumn("component", F.col("node"))
        last = turn == settings.stars or (turn and _remaining_bound(rows) <= settings.few_pairs * rows.count())
        pairs = _remaining(rows, nodes, settings) if last else _stars(rows, turn, settings)
        pairs = stage(_untested(pairs, tested), "jaccard-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        of_pairs = prefixes.join(_nodes_of(pairs, nodes), "key").dropDuplicates(["node"])
        possible = stage(compared(pairs, of_pairs, prefixes_may_link, settings), "jaccard-possible")
        sets = keyed.select("key", "text").join(_nodes_of(possible, nodes), "key").dropDuplicates(["node"])
        sets = in_batches(sets, _whole_sets(order, settings), "node long, n long, values array<long>")
        links = stage(compared(possible, sets, sets_link, settings), "jaccard-links")
        if labels is None or links.head(1):
            labels = components(links if labels is None else links.union(labels))
        if last:
            break

    named = nodes.join(labels.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_node = named.join(least, "label").select("node", "component_id")
    rows = described.select("doc.doc_id", "key", F.col("n").alias("n_shingles"), "node")
    linked = rows.filter("n_shingles > 0").join(by_node, "node").select(*rows.columns, "component_id")
    return linked.unionByName(rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def one_per_class(docs: DataFrame, settings: JaccardSettings = JaccardSettings()) -> DataFrame:
    """The documents without near duplicates, with all their columns: of each component the least doc_id stays.

    Documents without words all stay, except that of fully repeated rows (same doc_id and text) one stays.
    """
    found = stage(classes(docs, settings).withColumn("empty", F.col("n_shingles") == 0), "jaccard-classes")
    # A component is named by its least doc_id, or by the node if it has none.
    name = F.struct("component_id", F.when(F.col("component_id").isNull() | F.col("empty"), F.col("node")), F.when(F.col("empty"), F.col("key")))
    best = found.groupBy(name.alias("name")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best")
    )
    stays = best.select(F.col("best.key").alias("key")).distinct()
    counted = found.groupBy("key").agg(F.count("*").alias("rows"))
    gone = stage(counted.join(stays, "key", "left_anti").select(F.col("key").alias("_key")), "jaccard-gone")
    repeated = stage(
        counted.filter("rows > 1").join(stays, "key", "left_semi").select(F.col("key").alias("_key")), "jaccard-repeated"
    )
    rows = docs.select(F.struct("*").alias("doc"), row_key().alias("_key"))
    kept = rows.join(small(gone, gone.count()), "_key", "left_anti")
    n_repeated = repeated.count()
    if n_repeated:
        twice = small(repeated, n_repeated)
        kept = kept.join(twice, "_key", "left_anti").unionByName(
            kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"])
        )
    return kept.select("doc.*")
