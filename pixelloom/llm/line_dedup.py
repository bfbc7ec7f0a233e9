"""Line de-duplication with a segment-partition edit join.

Lines within `tau` edits (and a similarity of 0.8: at most a fifth of the longer line's characters) are near-duplicates; the
first line of each class, by (doc_id, line number), stays. A line is cut into tau + 1 segments of about equal length. A line
within tau edits of another holds one of its segments unchanged, near the segment's own place; so every line is indexed under its
tau + 1 segments and probes, for every length it could match, the substrings that the multi-match-aware bounds on place and
length allow. Only keys where an indexed and a probing line meet go on; their lines are verified with a banded bit-parallel
edit distance.

A key that very many different lines share is split by a second segment: what is left of the lines without the first one is
partitioned in the same way. A repeated line enters the join once per task. Lines that share a segment meet in cells of at most 2 x `CELL` lines; a larger
group is dealt into parts and each pair of parts is a cell of its own. A cell skips pairs that it already knows to be of
one class and gives its classes as stars. Near lines' texts are fetched by their ids, which are broadcast only while their
counted number is at most `BROADCAST_IDS`.

Defined cases: blank lines stay as they are and are never compared; lines shorter than tau + 1 characters only match equal
lines; a null or empty text is one blank line; rows with the same doc_id are treated alike (null, which comes first, too), so equal
rows keep or lose the same lines; equal lines within a document count as repeats; an empty table gives an empty result; extra columns are ignored, or
kept by dedup_lines().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import fresh, id_and_text, materialize, trimmed, whole_groups
from pixelloom.llm.components import components

TAU = 2
SIMILARITY = 0.8
CELL = 256
BROADCAST_IDS = 300_000
#: Lines that a task remembers so as to give each once.
SEEN = 400_000
#: The sample that tells hot keys, and how many of them are split.
ONE_IN, MOST_HOT = 64, 50_000
SEED = 42
_KEY = ~1 & (1 << 64) - 1


def allowed(a: int, b: int, tau: int = TAU) -> int:
    """Edits that two lines of these lengths may differ by."""
    return min(tau, int((1 - SIMILARITY) * max(a, b) + 1e-9))


@lru_cache(maxsize=20_000)
def segments(length: int, tau: int) -> tuple[tuple[int, int], ...]:
    """(start, size) of the tau + 1 segments of a line; the longer ones come last."""
    n, long_ = length // (tau + 1), length % (tau + 1)
    sizes = [n] * (tau + 1 - long_) + [n + 1] * long_
    return tuple((sum(sizes[:i]), s) for i, s in enumerate(sizes))


@lru_cache(maxsize=20_000)
def slices(length: int, tau: int) -> tuple[tuple[int, int, int, int], ...]:
    """(start, end, seed, side) of the parts under which a line is indexed (side 0) and which it probes (side 1); in UTF-32 bytes."""
    out = [(4 * s, 4 * (s + n), length * (tau + 1) + i, 0) for i, (s, n) in enumerate(segments(length, tau))]
    for shorter in range(tau + 1):
        if length - shorter < tau + 1:
            break
        for i, (s, n) in enumerate(segments(length - shorter, tau)):
            lo = max(0, s - i, s + shorter - (tau - i))
            hi = min(length - n, s + i, s + shorter + (tau - i))
            out += [(4 * x, 4 * (x + n), (length - shorter) * (tau + 1) + i, 1) for x in range(lo, hi + 1)]
    return tuple(out)


@lru_cache(maxsize=20_000)
def rest_slices(length: int, shorter: int, tau: int) -> tuple[tuple[int, int, int], ...]:
    """(start, end, segment) of the parts of what is left of a line without a segment: all its own if shorter is 0 or less, else those it probes."""
    if shorter < 0:
        return tuple((4 * s, 4 * (s + n), i) for i, (s, n) in enumerate(segments(length, tau)))
    out = []
    for i, (s, n) in enumerate(segments(length - shorter, tau)):
        lo, hi = max(0, s - i, s + shorter - (tau - i)), min(length - n, s + i, s + shorter + (tau - i))
        out += [(4 * x, 4 * (x + n), i) for x in range(lo, hi + 1)]
    return tuple(out)


def signatures(line: str, tau: int, hot: frozenset[int] = frozenset()) -> list[int]:
    """Keys of a line; the lowest bit tells indexed (0) from probing (1).

    A hot key gives way to keys of that key and a second segment: what is left of two lines without the segment they share
    is within tau edits too, so the same partition holds for it.
    """
    raw, h = line.encode("utf-32-le", "surrogatepass"), xxhash.xxh64_intdigest
    size = len(raw) // 4
    keys = [h(raw[a:b], s) & _KEY | side for a, b, s, side in slices(size, tau)]
    if hot.isdisjoint(k & _KEY for k in keys):
        return keys
    out = []
    for k, (a, b, s, side) in zip(keys, slices(size, tau)):
        other, cut = s // (tau + 1), (b - a) // 4  # length of the indexed line, and of its segment
        if k & _KEY not in hot or other - cut < tau + 1:
            out.append(k)
            continue
        rest, base = raw[:a] + raw[b:], k & _KEY
        out += [h(rest[x:y], base + 2 * i + 2 & (1 << 64) - 1) & _KEY | side for x, y, i in rest_slices(size - cut, size - other if side else -1, tau)]
    return out


def hot_keys(docs: DataFrame, tau: int) -> frozenset[int]:
    """Keys that very many different lines share, as a sample of one document in `ONE_IN` tells; the most frequent `MOST_HOT` of them.

    They have a bearing on the cost only: lines that share any other key meet in cells, however many they are.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = {x for t in b.column("text").to_pylist() for x in t.split("\n") if len(x) > tau and x.strip(" ")}
            keys = [k & _KEY for x in lines for k in signatures(x, tau)]
            ids = np.repeat(np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), SEED) for x in lines], np.uint64), [len(slices(len(x), tau)) for x in lines])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids.view(np.int64))], ["key", "id"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0).select("text").mapInArrow(trimmed(sign), "key long, id long")
    found = some.groupBy("key").agg(F.approx_count_distinct("id").alias("n")).where(F.col("n") > 8 * CELL // ONE_IN).orderBy(F.desc("n"), "key").limit(MOST_HOT)
    return frozenset(r.key % (1 << 64) for r in found.collect())  # bounded by MOST_HOT


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: banded and bit-parallel.

    Bit i of a row's mask stands for the diagonal i - most; masks hold, edits by edits, the diagonals reached so far.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    lo, hi = 0, n  # the common prefix, by halving
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    if not a or not b:
        return len(a) + len(b) <= most
    width, full = 2 * most + 1, (1 << 2 * most + 1) - 1
    goal = len(b) - len(a) + most
    # reached[e]: diagonals that some path of at most e edits is on after i characters of a
    reached = [0] * (most + 1)
    start = 1 << most
    for e in range(most + 1):
        reached[e] = start | (reached[e - 1] << 1 if e else 0)
        reached[e] &= full
    for i, c in enumerate(a):
        same, window = 0, b[max(0, i - most) : i + most + 1]
        if c in window:
            off = max(0, most - i)
            for k, d in enumerate(window):
                if c == d:
                    same |= 1 << k + off
        before = reached
        reached = []
        for e in range(most + 1):
            r = before[e] & same  # both move on
            if e:
                r |= before[e - 1]  # one character for another
                r |= before[e - 1] >> 1  # a's character goes
                r |= reached[e - 1] << 1  # b's character comes in
            reached.append(r & full)
        if not reached[most]:
            return False
    return bool(0 <= goal < width and reached[most] >> goal & 1)


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2): the lines that are not blank, by 128 bits of hash."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(F.trim("line")) > 0)
    return lines.select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id) of the keys at which an indexed and another, probing line meet."""
    for t in whole_groups(batches, "key", shift=1):
        key, line = t.column("key").to_numpy(), t.column("id").to_numpy()
        side, key = key & 1, key & ~1
        order = np.lexsort((side, line, key))
        key, line, side = key[order], line[order], side[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]  # one row for a line and key
        at = np.flatnonzero(new)
        sides = np.bitwise_or.reduceat(1 << side, at)
        key, line = key[at], line[at]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        live = (size > 1) & (np.bitwise_or.reduceat(sides, first) == 3)
        keep = np.repeat(live, size)
        key, line, size = key[keep], line[keep], np.repeat(size, size)[keep]
        small = size <= 2 * CELL
        cells, ids = [key[small]], [line[small]]
        for a in np.flatnonzero(~small & np.r_[True, key[1:] != key[:-1]]).tolist():
            g, members = key[a], line[a : a + size[a]]
            parts = -(-len(members) // CELL)
            part = np.arange(len(members)) % parts
            for o in range(parts):
                lo, hi = np.minimum(part, o), np.maximum(part, o)
                cells.append(g ^ ((lo * 1_000_003 + hi) * 2 + 1))
                ids.append(members)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(ids))], ["cell", "id"])


def _verify(cell_lines: list[tuple[int, str]], tau: int) -> Iterator[tuple[int, int]]:
    """Links that join the classes of one cell."""
    by_size = sorted(cell_lines, key=lambda x: (len(x[1]), x[0]))
    parent = list(range(len(by_size)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for j in range(1, len(by_size)):
        idj, b = by_size[j]
        i = j - 1
        while i >= 0 and len(b) - len(by_size[i][1]) <= tau:
            ri, rj = root(i), root(j)
            if ri != rj and within(by_size[i][1], b, allowed(len(by_size[i][1]), len(b), tau)):
                parent[max(ri, rj)] = min(ri, rj)
                yield by_size[i][0], idj
            i -= 1


def near_links(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): links between ids (h1) of different lines within the allowed edits; they join exactly the classes of lines."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(docs, tau)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        h = xxhash.xxh64_intdigest
        for b in batches:
            keys: list[int] = []
            ids: list[int] = []
            counts: list[int] = []
            for text in b.column("text").to_pylist():
                for line in text.split("\n"):
                    if len(line) > tau and line.strip(" "):
                        i = h(line.encode("utf-8", "replace"), SEED)
                        if i not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(i)
                            s = signatures(line, tau, hot)
                            keys += s
                            ids.append(i)
                            counts.append(len(s))
                if len(keys) > 500_000:
                    yield batch(keys, ids, counts)
                    keys, ids, counts = [], [], []
            yield batch(keys, ids, counts)

    def batch(keys: list[int], ids: list[int], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, np.uint64).view(np.int64), np.array(counts, np.int64)))], ["key", "id"])

    signed = docs.select("text").mapInArrow(trimmed(sign), "key long, id long")
    cells = materialize(signed.repartition(n, F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(trimmed(_cells), "cell long, id long").distinct(), "cells")
    near = materialize(cells.select("id").distinct(), "near-lines")
    count = near.count()
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("id"), "line")
    texts = lines.join(F.broadcast(near) if count <= BROADCAST_IDS else near, "id", "left_semi").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell", at_least=20_000):
            cell, ids, text = t.column("cell").to_numpy(), t.column("id").to_pylist(), t.column("line").to_pylist()
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]).tolist()
            found = [link for a, b in zip(cut[:-1], cut[1:]) for link in _verify(list(zip(ids[a:b], text[a:b])), tau)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return cells.join(texts, "id").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(trimmed(verify), "a long, b long").distinct()


def first_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, stay array<int>): numbers of the lines that are the first of their class."""
    ids = materialize(line_ids(docs), "lines")
    classes = components(near_links(docs, tau))
    # a class is a root of near lines, or else a line's own 128 bits
    one = ids.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    placed = one.join(classes, one["h1"] == classes["node"], "left").select(F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).alias("c2"), "first")
    first = placed.groupBy("c1", "c2").agg(F.min("first").alias("first"))
    return first.select("first.doc_id", "first.line_no").groupBy("doc_id").agg(F.collect_list("line_no").alias("stay"))


def kept_text(text: str, stay: list[int] | None) -> tuple[str, int, int]:
    """The text without its repeated lines, how many lines it had and lost."""
    lines, keep = text.split("\n"), set(stay or ())
    kept = [x for i, x in enumerate(lines) if i in keep or not x.strip(" ")]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_digests(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines) of every document."""
    d = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_text(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("stay").to_pylist())]
            shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _, _ in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n, _ in got], pa.int64()), pa.array([n for _, _, n in got], pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    kind = d.schema["doc_id"].dataType.simpleString()
    stay = first_lines(d, tau).withColumnRenamed("doc_id", "of")
    return d.join(stay, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "stay").mapInArrow(trimmed(run), f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string")


def dedup_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """The documents without their repeated lines, all columns kept. A document that loses all its lines goes.

    A document that was blank before stays as it is.
    """
    names = docs.columns
    of, lines = fresh("of", names), fresh("stay", names)
    stay = first_lines(id_and_text(docs), tau).select(F.col("doc_id").alias(of), F.col("stay").alias(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index("text")).to_pylist()
            kept = [t if t is None or not t.strip(" \n") else kept_text(t, s)[0] for t, s in zip(texts, b.column(len(names)).to_pylist())]
            out = pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(names)], names)
            yield out.filter(pa.array([t is None or k.strip(" \n") != "" or not t.strip(" \n") for t, k in zip(texts, kept)], pa.bool_()))

    joined = docs.join(stay, docs["doc_id"].eqNullSafe(stay[of]), "left").select(*[docs[c] for c in names], lines)
    return joined.mapInArrow(trimmed(run), docs.schema)
