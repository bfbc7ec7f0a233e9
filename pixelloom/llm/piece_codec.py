"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda: a heap of adjacent symbol pairs ordered by piece score, highest first and leftmost
among equals. Popping a pair merges it and offers the two new neighbours. Symbols that are no piece fall back to
their UTF-8 bytes.

A piece never holds a space mark after another character, so no merge crosses the start of a run of space marks;
each such run with the word behind it is encoded alone. Each worker keeps a bounded table of words it has encoded;
all ids are the agenda's. Every word that enters the table is checked against the sentencepiece library in one call per
Arrow batch, and the job fails if the two should differ.

Defined cases: a null or empty text has only the begin and end ids and decodes to the empty string; repeated rows
give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from pixelloom.llm.base import id_and_text, text_groups, trimmed

SPACE = "▁"
#: Words a worker remembers at most; then it starts anew. Bounds memory at about 150 MB.
MEMO_WORDS = 500_000
#: The same within a pipeline, whose workers also hold what other stages left; forgotten after each task.
STAGE_WORDS = 150_000
GROUP_BYTES = 2_000_000
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@cache
def processor(model_path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def words_of(text: str) -> list[str]:
    """Words that can be encoded alone. A plain word stands for one space mark and itself; other runs keep their marks."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
        return text.split(" ")
    runs = _RUNS.findall(SPACE + text.replace(" ", SPACE))
    return [r[1:] if len(r) > 1 and r[1] != SPACE else r for r in runs]


class Agenda:
    """The merge-type encoder itself, on one word at a time."""

    def __init__(self, model_path: str):
        sp = processor(model_path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.fallback = sp.is_byte(self.bytes[0])

    def encode(self, chars: str) -> list[int]:
        symbols: list[str] = list(chars)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(pair := symbols[i] + symbols[i + 1])
            if s is not None:
                agenda.append((-s, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (-s, i, pair + symbols[k]))
            h = before[i]
            if h >= 0 and (s := score.get(symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (-s, h, symbols[h] + pair))
        out: list[int] = []
        for s in symbols:
            if s:
                if (i := self.id.get(s)) is not None:
                    out.append(i)
                elif self.fallback:
                    out.extend(self.bytes[b] for b in s.encode("utf-8", "replace"))
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out


class WordMemo(dict):
    """Word -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, model_path: str, most: int):
        super().__init__()
        self.sp, self.agenda, self.most = processor(model_path), Agenda(model_path), most

    def learn(self, words: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        # The library puts a space mark before its input; a run's own first mark goes for it. A lone mark can't be asked for.
        theirs = self.sp.encode([w[1:] if w[0] == SPACE else w for w in new], num_threads=1) if new else []
        for w, said in zip(new, theirs):
            ids = self.agenda.encode(w if w[0] == SPACE else SPACE + w)
            if ids != said and w != SPACE:
                raise ValueError(f"the agenda gives {ids[:20]} for the word {w[:40]!r}, the library {said[:20]}")
            self[w] = np.array(ids, "<u4").tobytes()


@cache
def memo(model_path: str, most: int = MEMO_WORDS) -> WordMemo:
    return WordMemo(model_path, most)


def encode_batch(texts: pa.Array, model_path: str, most: int = MEMO_WORDS) -> list[bytes]:
    """Ids of each text, without begin and end ids. most: words to remember."""
    known, out = memo(model_path, most), []
    for a, b in text_groups(texts, GROUP_BYTES):
        split = [words_of(t) for t in texts.slice(a, b - a).to_pylist()]
        known.learn(set().union(*split))
        out += [b"".join(map(known.__getitem__, words)) for words in split]
    return out


def decode_batch(ids: list[bytes], model_path: str) -> list[str]:
    sp = processor(model_path)
    return [sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin_end: bool = True) -> DataFrame:
    """(doc_id, ids binary): ids of the whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path)
        ends = [np.array([x], "<u4").tobytes() if begin_end else b"" for x in (sp.bos_id(), sp.eos_id())]
        for b in batches:
            ids = [ends[0] + x + ends[1] for x in encode_batch(b.column("text"), model_path)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from what encode() returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(decode_batch(b.column("ids").to_pylist(), model_path), pa.string())], ["doc_id", "text"])

    d = encoded.select("doc_id", "ids")
    return d.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the encoded and the decoded whole text in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (sp.bos_id(), sp.eos_id()))
        for b in batches:
            ids = [begin + x + end for x in encode_batch(b.column("text"), model_path)]
            shas = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decode_batch(ids, model_path)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def reencode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """The documents with each text encoded and decoded again, all other columns kept; a null text stays null. n_tokens (without begin and end) is new.

    Where decoding gives another text (a space mark or an invalid sequence in it), the decoded text is what a
    model would have seen, so it takes the text's place.
    """
    docs = docs.drop("n_tokens")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index("text"))
            ids = encode_batch(texts.fill_null(""), model_path, STAGE_WORDS)
            back = pa.array([d if here else None for here, d in zip(texts.is_valid().to_pylist(), decode_batch(ids, model_path))], pa.string())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [back if c == "text" else b.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, counts], [*names, "n_tokens"])
        memo(model_path, STAGE_WORDS).clear()

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField("n_tokens", LongType())]))
