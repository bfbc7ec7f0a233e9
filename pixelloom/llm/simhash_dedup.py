"""SimHash near-duplicate detection with BK-trees.

A text's fingerprint is the bitwise majority over the XXH64 hashes of its word shingles. Fingerprints link when they differ
in at most `radius` bits. Distinct fingerprints are cut into m blocks of bits; two that differ in at most `radius` bits
agree in m - radius blocks at least, so each fingerprint goes to one shard for every choice of m - radius blocks, keyed by
those bits. m follows from the number of distinct fingerprints, so that a shard stays small at any size; which links are
found does not depend on m.

Each shard is a BK-tree: a child hangs at the integer Hamming distance to its parent, and a search follows only edges
within the radius of its own distance. The trees of a task are built and searched together, level by level, on arrays.
A shard tree meets its queries in one task through the shuffle: its size has no proven bound, so it is not broadcast to
all tasks. A shard with more than `hot` fingerprints is cut by a second choice of blocks among its other bits: two of its fingerprints
within the radius agree in one of radius + 1 of them. What is still larger is dealt into parts with a tree each. While all these trees have
at most `TREE_BYTES`, counted, they are broadcast and searched by the shard's fingerprints where they lie; beyond it each pair of
parts is a task of its own, with the tree of the one and the queries of the other. A task gives the classes it found as stars, never all pairs.

Defined cases: a text without words (null and empty ones too) has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; equal texts share a fingerprint and are never expanded into pairs; rows with a null
doc_id keep their fingerprint and take the class of their fingerprint; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import id_and_text, materialize, trimmed, whole_groups
from pixelloom.llm.components import components, merge_labels

SEED = 42
BITS = 64
#: Ids of dropped documents that may be broadcast; beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000
#: (query, node) steps that are held at once in a search.
STEPS = 2_000_000
#: Bytes of the trees of very large shards that may be broadcast, and of one fingerprint in a tree.
TREE_BYTES, NODE_BYTES = 32 << 20, 64


def shingle_hashes(text: str, width: int = 4) -> np.ndarray:
    """XXH64 of every word shingle, repeated ones too; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()  # ASCII only, as both are on bytes
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    last = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    first = [0, *ends[: n - 1].tolist()]
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have; 0 for none."""
    if not len(h):
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        total += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks_for(n: int, radius: int, shard: int = 256) -> int:
    """Blocks so that a shard of evenly spread fingerprints has at most `shard` of them, or as near as 40 copies of each allow."""
    m = radius + 1
    while n / 2 ** (BITS * (m - radius) / m) > shard and comb(m + 1, radius) <= 40:
        m += 1
    return m


def shard_masks(m: int, radius: int) -> list[int]:
    cut = [round(BITS * i / m) for i in range(m + 1)]
    block = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(m)]
    return [sum(block[i] for i in c) for c in combinations(range(m), m - radius)]


def sub_masks(mask: int, radius: int) -> list[int]:
    """The bits outside a mask in radius + 1 runs of about equal size."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    cut = [round(len(rest) * i / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in rest[x:y]) for x, y in zip(cut[:-1], cut[1:])]


class Forest:
    """BK-trees over all groups at once; the first item of each group is its root. Items of a group differ."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp
        first = np.r_[True, group[1:] != group[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        active, here = np.flatnonzero(~first), self.root[~first]
        parents, edges, children = [], [], []
        while len(active):
            d = np.bitwise_count(fp[active] ^ fp[here]).astype(np.int64)
            slot, at, which = np.unique(here * (BITS + 1) + d, return_index=True, return_inverse=True)
            child = active[at]
            parents.append(slot // (BITS + 1))
            edges.append(slot % (BITS + 1))
            children.append(child)
            here = child[which]
            rest = here != active
            active, here = active[rest], here[rest]
        p = np.concatenate([*parents, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(p, kind="stable")
        self.edge = np.concatenate([*edges, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.child = np.concatenate([*children, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.start = np.searchsorted(p[order], np.arange(len(fp) + 1))

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (place in query, item) for items within the radius, level by level."""
        at, node = np.arange(len(query)), root
        while len(at):
            d = np.bitwise_count(query[at] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            yield at[near], node[near]
            lo = self.start[node]
            n = self.start[node + 1] - lo
            up = np.repeat(np.arange(len(at)), n)
            k = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n) + lo[up]
            go = np.abs(self.edge[k] - d[up]) <= radius
            at, node = at[up[go]], self.child[k[go]]


def _stars(t: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes within each cell as (node, smallest node) links. side 0: in the tree; 1: a query only; cells of one part have side 0 only."""
    cell, fp, node, side = (t.column(c).to_numpy() for c in ("cell", "fp", "node", "side"))
    order = np.lexsort((node, side, cell))
    cell, fp, node, side = cell[order], fp[order].astype(np.int64).view(np.uint64), node[order], side[order]
    tree = np.flatnonzero(side == 0)
    if not len(tree):
        return node[:0], node[:0]
    forest = Forest(fp[tree], cell[tree])
    label = np.arange(len(fp))
    split = np.unique(cell[side == 1])
    asks = np.flatnonzero((side == 1) | ~np.isin(cell, split))
    roots = np.searchsorted(cell[tree], cell[asks])
    known = roots < len(tree)
    known[known] = cell[tree][roots[known]] == cell[asks[known]]
    asks, roots = asks[known], roots[known]
    size = np.searchsorted(cell[tree], cell[asks], side="right") - roots
    cuts = np.searchsorted(np.cumsum(size), np.arange(STEPS, size.sum() + STEPS, STEPS), side="left") + 1
    begin = 0
    for end in np.unique(np.minimum(cuts, len(asks))):
        q = asks[begin:end]
        for at, item in forest.search(fp[q], roots[begin:end], radius):
            merge_labels(label, q[at], tree[item])
        begin = end
    up = label != np.arange(len(label))
    return node[up], node[label[up]]


def links(distinct: DataFrame, radius: int = 4, hot: int = 4096) -> DataFrame:
    """(a, b): links that join exactly the classes of `distinct` (fp long, node long; one row a fingerprint)."""
    spark = distinct.sparkSession
    masks = shard_masks(blocks_for(distinct.count(), radius), radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = distinct.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(signed(m)).cast("long").alias("mask")) for i, m in enumerate(masks)])).alias("s"))
    keyed = keyed.select("fp", "node", F.col("s.i").alias("i"), F.xxhash64("s.i", F.col("fp").bitwiseAND(F.col("s.mask"))).alias("shard"))
    crowded = materialize(keyed.groupBy("shard").count().where(F.col("count") > hot).select("shard"), "crowded")
    if not crowded.isEmpty():
        cuts = F.array(*[F.array(*[F.lit(signed(x)).cast("long") for x in sub_masks(m, radius)]) for m in masks])
        again = F.transform(F.element_at(cuts, F.col("i") + 1), lambda x, j: F.xxhash64("shard", j, F.col("fp").bitwiseAND(x)))
        keyed = keyed.join(crowded.withColumn("crowded", F.lit(True)), "shard", "left").select("fp", "node", F.explode(F.when(F.col("crowded"), again).otherwise(F.array("shard"))).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > hot).select("shard", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    if not crowded.isEmpty():
        large = materialize(keyed.groupBy("shard").count().where(F.col("count") > hot).select("shard", F.ceil(F.col("count") / hot).cast("int").alias("parts"), "count"), "large")
        size = large.agg(F.sum("count")).first()[0] or 0
        large = large.drop("count")
        if 0 < size * NODE_BYTES <= TREE_BYTES:
            few = F.broadcast(large)  # fewer rows than the trees have fingerprints
            return _links(keyed.join(few.select("shard"), "shard", "left_anti").select("fp", "node", F.col("shard").alias("cell"), F.lit(0).cast("byte").alias("side")), radius).union(_tree_links(keyed.join(few, "shard").withColumn("part", F.pmod(F.xxhash64("node", "fp"), F.col("parts"))), radius))
    dealt = keyed.join(large, "shard", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", "fp"), F.col("parts"))))
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.col("shard").alias("cell"), F.lit(0).cast("byte").alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda o: F.struct(F.xxhash64("shard", F.least("part", o), F.greatest("part", o)).alias("cell"), (F.col("part") > o).cast("byte").alias("side")))
    )
    return _links(dealt.select("fp", "node", F.explode(pairs).alias("p")).select("p.cell", "p.side", "fp", "node"), radius)


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links within large shards: rows (shard, part, fp, node) against the broadcast trees of all parts of their shard."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "tree"):
            tree, fp, node, shard = (t.column(c).to_numpy() for c in ("tree", "fp", "node", "shard"))
            cut = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1], True]).tolist()
            blobs = [pickle.dumps((Forest(fp[a:b].astype(np.int64).view(np.uint64), tree[a:b]), node[a:b])) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array(blobs, pa.binary())], ["shard", "tree"])

    named = rows.withColumn("tree", F.xxhash64("shard", "part")).select("tree", "fp", "node", "shard")
    trees = named.repartition(n, "tree").sortWithinPartitions("tree", "fp").mapInArrow(trimmed(grow), "shard long, tree binary")
    of: dict[int, list] = {}
    for r in trees.toLocalIterator():  # counted: at most TREE_BYTES
        of.setdefault(r["shard"], []).append(bytes(r["tree"]))
    sent = spark.sparkContext.broadcast(of)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp, node = (b.column(c).to_numpy() for c in ("shard", "fp", "node"))
            for s in np.unique(shard).tolist():
                mine = shard == s
                query, asks = fp[mine].astype(np.int64).view(np.uint64), node[mine]
                for blob in sent.value[s]:
                    forest, names = pickle.loads(blob)
                    ids = np.unique(np.concatenate([asks, names]))
                    label, q, x = np.arange(len(ids)), np.searchsorted(ids, asks), np.searchsorted(ids, names)
                    for at, item in forest.search(query, np.zeros(len(query), np.int64), radius):
                        merge_labels(label, q[at], x[item])
                    up = label != np.arange(len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[up]), pa.array(ids[label[up]])], ["a", "b"])

    return rows.select("shard", "fp", "node").mapInArrow(trimmed(ask), "a long, b long")


def _links(cells: DataFrame, radius: int) -> DataFrame:
    """Links within cells (cell, side, fp, node)."""
    spark = cells.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            a, b = _stars(t, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that the document reaches over links, itself included."""
    fps = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(distinct.where("node is not null"), radius))
    classes = distinct.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """The documents with one of each class of near-duplicates: the one with the smallest doc_id. All columns are kept.

    Rows that share a doc_id are told apart by nothing and stay or go together; rows with a null doc_id stay.
    """
    go = materialize(near_duplicates(docs, radius, width).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(F.broadcast(go) if go.count() <= BROADCAST_IDS else go, "doc_id", "left_anti").select(*docs.columns)
