"""Exact substring de-duplication over suffix arrays.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id is removed; strings are
judged on the input.

0. A document whose whole text a smaller document has, by its SHA-256 and length, loses all of it and takes no further part.
1. Each window of `length` bytes has a minimizer: the smallest hash among its `gram`-byte grams. Equal windows have equal
   minimizers, so a window whose minimizer lives in one document only cannot repeat elsewhere. This step only finds where to look
   and drops no repeat.
2. Consecutive windows with one minimizer that several documents have form a stretch. Equal stretches collapse within each task, with the
   smallest and largest doc_id that holds them; so a passage in a third of all documents is a row for each task before it is sorted.
3. Stretches meet by minimizer and are joined into shard texts, whose suffixes are sorted by external induced sorting with
   common-prefix values. Suffixes that agree in `length` bytes are one string; the smallest doc_id among them is its first document.
   A minimizer with one kind of stretch has nothing to be sorted: all windows of the stretch start in its smallest document.
4. Every occurrence of a stretch learns from that which of its windows start in a smaller document too, and the covered bytes go.

A shard is a few megabytes as a rule; one minimizer with more makes a larger one, whose sort goes to disk beyond its budget (induced_sort).

Defined cases: a null or empty text has no bytes; texts shorter than `length` lose nothing; rows with the same doc_id do not make each
other's strings repeats; a row with a null doc_id loses nothing and makes nobody else lose; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.base import drop, id_and_text, materialize, trimmed, whole_groups
from pixelloom.llm.fingerprints import window_minima
from pixelloom.llm.induced_sort import Space, chunks, suffix_order

LENGTH, GRAM = 50, 20
#: Bytes of stretches that one suffix sort takes, unless one minimizer alone has more.
SHARD_BYTES = 2_000_000
#: Documents whose ids may be broadcast; else the texts shuffle.
BROADCAST_IDS = 1_000_000
#: Kinds of stretches that a task gathers before it gives them out.
KINDS = 200_000
#: Fixed odd multipliers of the hash.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def minimizers(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The minimizer of every window of a text's bytes, as unsigned 64-bit hashes."""
    n = len(raw)
    h, out, have, width, rest, power = raw.astype(np.uint64) + np.uint64(1), None, 0, 1, gram, BASE
    while rest:
        if rest & 1:
            out = h.copy() if out is None else out[: n - have - width + 1] * power + h[have : n - width + 1]
            have += width
        rest >>= 1
        if rest:
            h = h[:-width] * power + h[width:]
            power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
            width *= 2
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return window_minima(out, length - gram + 1)


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id): the distinct minimizers of each document."""
    for b in batches:
        found, ids, size = [], [], 0
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            raw = _bytes_of(text)
            if len(raw) >= LENGTH:
                m = minimizers(raw)
                u = np.unique(m[np.r_[True, m[1:] != m[:-1]]])
                found.append(u.view(np.int64))
                ids.append(np.full(len(u), doc, np.int64))
                size += len(u)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], ["anchor", "doc_id"])
                found, ids, size = [], [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], ["anchor", "doc_id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, doc_id), those whose anchor has two documents or more; nothing of a group is held but its first row."""
    held: tuple[int, int] | None = None
    open_ = False  # the held anchor is known to be shared and its first row is out
    for b in batches:
        if not b.num_rows:
            continue
        a, d = b.column("anchor").to_numpy(), b.column("doc_id").to_numpy()
        if held is not None:
            a, d = np.r_[held[0], a], np.r_[held[1], d]
        start = np.r_[True, a[1:] != a[:-1]]
        group = np.cumsum(start) - 1
        at = np.flatnonzero(start)
        ends = np.r_[at[1:], len(a)] - 1
        shared = d[at] != d[ends]
        shared[0] |= open_
        keep = shared[group]
        if held is not None and open_:
            keep[0] = False
        # of a last group that is not shared yet its first row waits; its other rows have the same document and stay out
        last_shared = bool(shared[-1])
        held, open_ = (int(a[at[-1]]), int(d[at[-1]])), last_shared
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(d[keep])], ["anchor", "doc_id"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows with a shared minimizer: a row for each occurrence, and one with the bytes for each kind that the task saw, with its smallest and largest document."""
    kinds: dict[bytes, list] = {}
    digest = xxhash.xxh3_128_digest
    for b in batches:
        names: list[bytes] = []
        docs: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        for doc, text, anchors in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("anchors")):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) < LENGTH:
                continue
            h = xxhash.xxh64_intdigest(data) - (1 << 63)
            m = minimizers(np.frombuffer(data, np.uint8)).view(np.int64)
            at = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            ends = np.r_[at[1:], len(m)]
            live = np.isin(m[at], anchors.values.to_numpy())
            at, ends = at[live], ends[live]
            for a, s, e in zip(m[at].tolist(), at.tolist(), ends.tolist()):
                x = data[s : e + LENGTH - 1]
                k = digest(x)
                names.append(k)
                kind = kinds.get(k)
                if kind is None:
                    kinds[k] = [a, doc, doc, x]
                elif doc < kind[1]:
                    kind[1] = doc
                elif doc > kind[2]:
                    kind[2] = doc
            docs.append(np.full(len(at), doc, np.int64))
            hashes.append(np.full(len(at), h, np.int64))
            starts.append(at.astype(np.int32))
            if len(names) > 100_000:
                yield _occurrences(names, docs, hashes, starts)
                names, docs, hashes, starts = [], [], [], []
            if len(kinds) > KINDS:
                yield _kinds(kinds)
                kinds = {}
        if names:
            yield _occurrences(names, docs, hashes, starts)
    if kinds:
        yield _kinds(kinds)


COLUMNS = ["anchor", "stretch", "doc_id", "text_hash", "start", "last_doc", "bytes"]


def _occurrences(names: list, docs: list, hashes: list, starts: list) -> pa.RecordBatch:
    n = len(names)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(names, pa.binary()), pa.array(np.concatenate(docs)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(starts)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], COLUMNS)


def _kinds(kinds: dict[bytes, list]) -> pa.RecordBatch:
    anchor, first, last, raw = zip(*kinds.values())
    n = len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(list(kinds), pa.binary()), pa.array(first, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(last, pa.int64()), pa.array(raw, pa.binary())], COLUMNS)


def first_runs(stretches: list[bytes], docs: np.ndarray, length: int = LENGTH, space: Space | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, a, b, doc): runs of windows a to b of a stretch whose smallest document, of those whose stretches hold the window, is doc."""
    space = space or Space()
    sizes = np.array([len(s) for s in stretches], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    # symbol 1 parts stretches, 0 ends the text
    text = space.array(int(sizes.sum()) + len(sizes) + 1, np.int16)
    for lo in range(0, len(stretches), 4096):
        some = np.frombuffer(b"\0".join(stretches[lo : lo + 4096]), np.uint8)
        text[starts[lo] : starts[lo] + len(some)] = some
    owner = space.array(len(text), np.int32)
    for a, b in chunks(len(text)):
        text[a:b] += 2
        lo, hi = np.searchsorted(starts, [a, b])
        new = np.zeros(b - a, np.int32)
        new[starts[lo:hi] - a] = 1
        owner[a:b] = lo - 1 + np.cumsum(new)
    text[starts + sizes] = 1
    text[-1] = 0
    final = starts + sizes - length  # where the last window of a stretch starts
    order, prefix = suffix_order(text, length, space)
    groups = sum(int((prefix[a:b] < length).sum()) for a, b in chunks(len(text)))
    first, least = space.array(groups, np.int64), space.array(len(text), np.int64)
    for a, b in chunks(groups):
        first[a:b] = np.iinfo(np.int64).max
    for fill in (True, False):
        base = -1
        for a, b in chunks(len(text)):
            place = np.asarray(order[a:b])
            group = base + np.cumsum(prefix[a:b] < length)
            base = int(group[-1])
            own = owner[place]
            inside = np.flatnonzero(place <= final[own])
            place, own, group = place[inside], own[inside], group[inside]
            if fill and len(group):
                heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                first[group[heads]] = np.minimum(first[group[heads]], np.minimum.reduceat(docs[own], heads))
            elif len(group):
                least[place] = first[group]
    out = []
    for a, b in chunks(len(text)):  # runs are cut where a chunk ends, which the ranges do not mind
        own = np.asarray(owner[a:b])
        at = np.flatnonzero(np.arange(a, b) <= final[own])
        if len(at):
            value, own = np.asarray(least[a:b])[at], own[at]
            heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
            ends = np.r_[heads[1:], len(at)] - 1
            out.append((own[heads].astype(np.int64), a + at[heads] - starts[own[heads]], a + at[ends] - starts[own[heads]], value[heads]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stretch, a, b, first): runs of each stretch's windows with their first document, where some occurrence can lose something."""
    names = ["stretch", "a", "b", "first"]

    def rows(stretch: pa.Array, owner: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        live = first < last[owner]
        return pa.RecordBatch.from_arrays([stretch.take(pa.array(owner[live])), pa.array(a[live].astype(np.int32)), pa.array(b[live].astype(np.int32)), pa.array(first[live])], names)

    for t in whole_groups(batches, "anchor", at_least=40_000):
        # tasks have given each kind once at most, or a few times; here they meet
        raw = t.column("stretch").combine_chunks()
        raw = raw if isinstance(raw, pa.Array) else raw.chunk(0)
        name = np.frombuffer(b"".join(raw.to_pylist()), np.int64).reshape(-1, 2)
        anchor = t.column("anchor").to_numpy()
        order = np.lexsort((name[:, 1], name[:, 0], anchor))
        anchor, name = anchor[order], name[order]
        heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]).any(axis=1)])
        docs = np.minimum.reduceat(t.column("doc_id").to_numpy()[order], heads)
        last = np.maximum.reduceat(t.column("last_doc").to_numpy()[order], heads)
        kept = pa.array(order[heads])
        stretch, data = raw.take(kept), t.column("bytes").take(kept).combine_chunks()
        data = data if isinstance(data, pa.Array) else data.chunk(0)
        anchor, size = anchor[heads], pc.binary_length(data).to_numpy().astype(np.int64)
        alone = np.r_[True, anchor[1:] != anchor[:-1]] & np.r_[anchor[1:] != anchor[:-1], True]
        one = np.flatnonzero(alone)
        yield rows(stretch, one, np.zeros(len(one), np.int64), size[one] - LENGTH, docs[one], last)
        many = np.flatnonzero(~alone)
        if not len(many):
            continue
        total = np.cumsum(size[many] + 1)
        ends = np.r_[np.flatnonzero(anchor[many][1:] != anchor[many][:-1]) + 1, len(many)]
        begin = 0
        for i, e in enumerate(ends.tolist()):
            if i + 1 == len(ends) or total[ends[i + 1] - 1] - (total[begin - 1] if begin else 0) > SHARD_BYTES:
                mine = many[begin:e]
                owner, a, b, first = first_runs(data.take(pa.array(mine)).to_pylist(), docs[mine])
                yield rows(stretch.take(pa.array(mine)), owner, a, b, first, last[mine])
                begin = e


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy_key): documents whose whole text a smaller document has, by SHA-256 and length.

    Texts that over a thousandth of all documents have are a thousand at most: those are broadcast, the others meet by key.
    """
    keyed = docs.where("doc_id is not null").select("doc_id", whole_key(F.col("text")).alias("copy_key"), F.octet_length("text").alias("size"))
    keyed = materialize(keyed.where(F.col("size") >= LENGTH).select("doc_id", "copy_key"), "text-keys")
    first = materialize(keyed.groupBy("copy_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-texts")
    hot = F.lit(max(1, keyed.count() // 1000))
    large, small = F.broadcast(first.where(F.col("n") > hot)), first.where(F.col("n") <= hot)
    in_large = keyed.join(large, "copy_key").where("doc_id > first").select("doc_id", "copy_key")
    in_small = keyed.join(large, "copy_key", "left_anti").join(small, "copy_key").where("doc_id > first").select("doc_id", "copy_key")
    return in_large.union(in_small)


def whole_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ranges array of (a, b)): byte ranges to remove of the documents that have any. docs: doc_id, text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.where("doc_id is not null")
    anchors = known.mapInArrow(trimmed(_anchors), "anchor long, doc_id long").repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id")
    shared = materialize(anchors.mapInArrow(trimmed(_shared), "anchor long, doc_id long"), "anchors")
    live = shared.groupBy("doc_id").agg(F.array_distinct(F.collect_list("anchor")).alias("anchors"))
    found = materialize(known.join(live, "doc_id").select("doc_id", "text", "anchors").mapInArrow(trimmed(_stretches), "anchor long, stretch binary, doc_id long, text_hash long, start int, last_doc long, bytes binary"), "stretches")
    drop(shared)
    kinds = found.where("bytes IS NOT NULL").select("anchor", "stretch", "doc_id", "last_doc", "bytes")
    firsts = materialize(kinds.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(_sorted_shards), "stretch binary, a int, b int, first long"), "firsts")
    lost = found.where("bytes IS NULL").select("stretch", "doc_id", "text_hash", "start").join(firsts, "stretch").where("first < doc_id")
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + LENGTH).alias("b"))).alias("ranges"))


def cut(text: str, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes, removed bytes, runs)."""
    data, runs = text.encode("utf-8", "surrogatepass"), merged(ranges)
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    out = b"".join(kept)
    return out, len(data), len(data) - len(out), len(runs)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    d = id_and_text(docs, id_col, text_col)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # A copy of a smaller document's whole text loses all its bytes, and what it would make others lose its original does.
    whole = materialize(copies(d).withColumnRenamed("doc_id", "copy_id"), "copies")
    of = (F.col("doc_id") == F.col("copy_id")) & (whole_key(F.col("text")) == F.col("copy_key"))
    few = F.broadcast(whole) if whole.count() <= BROADCAST_IDS else whole  # counted; beyond it the same joins shuffle
    rest = d.join(few, of, "left_anti")
    gone = d.join(few, of, "left_semi").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    ranges = materialize(repeated_ranges(rest), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, h, found in zip(b.column("text").to_pylist(), b.column("hashes").to_pylist(), b.column("ranges").to_pylist()):
                mine: list[tuple[int, int]] = []
                if found:
                    own = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    mine = [(r["a"], r["b"]) for k, rs in zip(h, found) if k == own for r in rs]
                kept, size, removed, runs = cut(text, mine)
                out.append((size, removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    per_doc = ranges.groupBy("doc_id").agg(F.collect_list("text_hash").alias("hashes"), F.collect_list("ranges").alias("ranges"))
    if ranges.count() > BROADCAST_IDS:
        return gone.union(rest.join(per_doc, "doc_id", "left").select("doc_id", "text", "hashes", "ranges").mapInArrow(trimmed(run), schema))
    touched = F.broadcast(ranges.select("doc_id").distinct())  # counted: at most BROADCAST_IDS ids
    some = rest.join(touched, "doc_id", "left_semi").join(per_doc, "doc_id", "left").select("doc_id", "text", "hashes", "ranges")
    others = rest.join(touched, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<long>").alias("hashes"), F.lit(None).cast(per_doc.schema["ranges"].dataType).alias("ranges"))
    return gone.union(some.mapInArrow(trimmed(run), schema)).union(others.mapInArrow(trimmed(run), schema))
