"""Token-id files: Parquet with one list column of ids per document, in ascending document order.

Files are written by Spark's Parquet writer with data page version 2, so that ids are dictionary encoded while the
dictionary fits and delta encoded otherwise; row groups and pages have set sizes, and the page index is written. A reader of
token ranges (read_range) or of the metadata columns (doc_id, n_tokens) touches only the files and pages it needs.

Documents are dealt into ranges of doc_id, each range is sorted, and the ranges are written as files in order, so the
file number, then row order, is the order of the whole corpus. Start offsets come from per-file totals: one row per file
reaches the driver, nothing that grows with the documents.

All ids are the tokenizers library's. Texts are cut where no pre-token can reach across, an Arrow batch's parts are counted
once by dictionary encoding, and only parts that the worker does not know yet go to the library.

Defined cases: a null or empty text has only the end id; rows with equal doc_id follow in the order of their texts, null
doc_ids come first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.base import id_and_text, shared_path, text_groups, trimmed
from pixelloom.llm.token_counts import byte_level

#: Fixed sizes of the file format.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
#: Bytes of text that are cut into parts and looked up together; a longer text is a group of its own.
GROUP_BYTES = 6_000_000
#: Parts that a worker remembers before it forgets those that one group only had, and parts that go to the library in one call.
MEMO_PARTS, ASK_PARTS = 600_000, 20_000
#: What keeps a text from being cut before each space, comma and full stop and around each line break: white space next to white
#: space or at the end, other white space or control characters, and a comma or full stop that does not follow a plain letter or digit.
_JOINS = r"[ \n][ \n]|[ \n]$|[^0-9A-Za-zÀ-ÖØ-öø-ž][,.]|^[,.]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PARTS = re.compile(r"\s*\S+|\s+")
_VISIBLE = re.compile(r" ?[!-~]+").fullmatch


class Ids:
    """Ids of texts by way of their parts, which it keeps as one Arrow array; knows the ids of about MEMO_PARTS parts and a group's more.

    Plain texts are cut before each space, comma and full stop and around each line break, where no pre-token can reach across. Texts
    in which one of these could join others are cut before white space only; texts with special tokens, or control
    characters that only some libraries take for white space, are one part.
    """

    def __init__(self, path: str):
        self.tokenizer, self.special, self.splits = byte_level(path)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.splits and len(line) == 1 else None
        self.known = pa.array([], pa.string())
        self.ids, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        """Forgets the parts that one group only had."""
        often = np.flatnonzero(self.used > 1)
        start = np.cumsum(self.size) - self.size
        self.ids = self.ids[_ragged(start[often], self.size[often])]
        self.known, self.size, self.used = self.known.take(pa.array(often)), self.size[often], np.zeros(len(often), np.int32)

    def learn(self, parts: list[str]) -> None:
        """Asks the library for the ids of new parts. Parts of visible ASCII characters go in one text, a line each: the line break is a pre-token, and a token, of its own."""
        plain, rest, ids_, sizes = [], [], [self.ids], [self.size]
        for p in parts:
            (plain if self.line is not None and _VISIBLE(p) else rest).append(p)
        for at in range(0, len(plain), ASK_PARTS):
            some = plain[at : at + ASK_PARTS]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int32)
            breaks = np.r_[-1, np.flatnonzero(ids == self.line), len(ids)]
            if len(breaks) != len(some) + 1:
                raise ValueError(f"{len(some)} lines came back as {len(breaks) - 1}")
            ids_.append(ids[ids != self.line])
            sizes.append(np.diff(breaks) - 1)
        for at in range(0, len(rest), ASK_PARTS):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + ASK_PARTS], add_special_tokens=False)]
            ids_.append(np.array([i for x in got for i in x], np.int32))
            sizes.append(np.array([len(x) for x in got], np.int64))
        self.known = pa.concat_arrays([self.known, pa.array(plain, pa.string()), pa.array(rest, pa.string())])
        self.ids, self.size = np.concatenate(ids_), np.concatenate(sizes)
        self.used = np.r_[self.used, np.zeros(len(parts), np.int32)]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
        """(parts, number of parts of each text, the parts' places in text order unless they are in that order already)."""
        whole = pc.match_substring_regex(texts, r"[\x1c-\x1f]") if self.splits else pa.array(np.ones(len(texts), bool))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        odd = pc.or_(whole, pc.match_substring_regex(texts, _JOINS)).to_numpy(zero_copy_only=False)
        marked = texts.filter(pa.array(~odd)) if odd.any() else texts
        for mark, by in (("\n", "\0\n\0"), (" ", "\0 "), (",", "\0,"), (".", "\0.")):
            marked = pc.replace_substring(marked, mark, by)
        lists = pc.split_pattern(marked, "\0")
        parts, counts = lists.flatten(), np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(lists.offsets.to_numpy())
        if not odd.any():
            return parts, counts, None
        alone = whole.to_numpy(zero_copy_only=False)[odd]
        own = [([t] if t else []) if one else _PARTS.findall(t) for one, t in zip(alone, texts.filter(pa.array(odd)).to_pylist())]
        counts[odd] = [len(x) for x in own]
        first = np.zeros(len(texts), np.int64)
        for some, base in ((~odd, 0), (odd, len(parts))):
            first[some] = base + np.cumsum(counts[some]) - counts[some]
        return pa.concat_arrays([parts, pa.array([p for x in own for p in x], pa.string())]), counts, _ragged(first, counts)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where known parts stand; -1 for others."""
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        parts, counts, place = self.cut(texts)
        coded = parts.dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.known) > MEMO_PARTS:
            self.forget()
        at = self._places(words)
        new = np.flatnonzero(at < 0)
        if len(new):
            before, asked = len(self.known), words.take(pa.array(new))
            self.learn(asked.to_pylist())
            at[new] = before + pc.index_in(asked, value_set=self.known.slice(before)).to_numpy()
        self.used[at] += 1
        size = self.size
        start = np.cumsum(size) - size
        code = coded.indices.to_numpy() if place is None else coded.indices.to_numpy()[place]
        n = size[at][code]
        done = np.r_[0, np.cumsum(n)]
        ends = np.r_[0, np.cumsum(counts)]
        return self.ids[_ragged(start[at][code], n)], np.diff(done[ends])


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places start[i], start[i] + 1, ... of n[i] each, one after the other."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def encode_texts(texts: pa.Array, path: str, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, number of ids of each) of consecutive groups of texts, each text followed by the end id."""
    for a, b in text_groups(texts, GROUP_BYTES):
        ids, n = ids_of(path).encode(texts.slice(a, b - a))
        if end_id is not None:
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
        yield ids, n


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts and writes (doc_id, n_tokens, ids list<int>) in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for ids, sizes in encode_texts(b.column("text"), tokenizer_path, end_id):
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(sizes)), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])
                done += len(sizes)

    d = id_and_text(docs, id_col, text_col)
    n = files or max(2, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")
    (
        encoded.write.option("compression", "snappy").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").parquet(out)
    )


def file_number(name: str) -> int:
    """The number of the task that wrote the file; names as text are out of order from 100,000 files on."""
    return int(re.match(r"part-(\d+)", name)[1])


def file_starts(spark: SparkSession, path: str) -> dict[str, int]:
    """Ids before each file; one row a file reaches the driver, as many as Spark has just listed."""
    name = F.col("_metadata.file_name").alias("file")
    totals = spark.read.parquet(path).select(name, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("total")).collect()
    before, so_far = {}, 0
    for r in sorted(totals, key=lambda r: file_number(r["file"])):
        before[r["file"]], so_far = so_far, so_far + (r["total"] or 0)
    return before


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, file, row). Select fewer columns to read fewer; row is the place within the file."""
    return spark.read.parquet(path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids): the documents' ids at the places start to stop - 1 of the corpus, with the place of the first of them.

    Only files and documents that hold some of them have their ids read.
    """
    before = file_starts(spark, path)
    order = sorted(before, key=file_number)
    mine = {f: before[f] for f, after in zip(order, [*[before[f] for f in order[1:]], None]) if before[f] < stop and (after is None or after > start)}
    rows = read_tokens(spark, path).where(F.col("file").isin(list(mine)))
    placed = with_starts(rows.select("doc_id", "n_tokens", "file", "row"), mine, keep=["file", "row"]).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    cut = F.slice("ids", (F.greatest(F.lit(start), F.col("start")) - F.col("start") + 1).cast("int"), (F.least(F.lit(stop), F.col("start") + F.col("n_tokens")) - F.greatest(F.lit(start), F.col("start"))).cast("int"))
    ids = rows.select(F.col("file"), F.col("row"), "ids")
    return ids.join(placed, ["file", "row"]).select("doc_id", F.greatest(F.lit(start).cast("long"), "start").alias("start"), cut.alias("ids"))


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the token files, reads them back, and gives doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    out = shared_path(spark, "token-ids")
    write_tokens(docs, tokenizer_path, out, end_id)
    t = read_tokens(spark, out)
    kind = t.schema["doc_id"].dataType.simpleString()

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ids, at = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("file"), b.column("row"), pa.array(sums, pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    sums = t.mapInArrow(trimmed(crc), f"doc_id {kind}, n_tokens long, file string, row long, ids_crc32 long")
    return with_starts(sums, file_starts(spark, out))


def with_starts(rows: DataFrame, before: dict[str, int], keep: list[str] | None = None) -> DataFrame:
    spark = rows.sparkSession
    firsts = spark.createDataFrame([(k, int(v)) for k, v in before.items()], "file string, before long")
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    columns = ["n_tokens", *(keep if keep is not None else ["ids_crc32"])]
    # firsts has one row a file, known from the driver's list of files
    return rows.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(firsts), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), *columns)
