"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

An Arrow batch is cut into groups of about equal bytes. Texts, long ones included, are split where no token can
cross: before a run of space marks (piece vocabularies) or before white space that follows other characters
(byte-level vocabularies). Each distinct part is encoded by the library once per worker and remembered in a bounded
table; a text's count is the sum over its parts.

Defined cases: a null or empty text counts 0 tokens; repeated rows give repeated counts; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pixelloom.llm.base import id_and_text, text_groups, trimmed
from pixelloom.llm.piece_codec import SPACE, processor, words_of

MEMO_PARTS = 700_000
GROUP_BYTES = 2_000_000
_PARTS = re.compile(r"\s*\S+|\s+")
_SPACE_BEFORE_SPACE = re.compile(r" (?=\s|$)")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_level_parts(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """Parts of a text that a byte-level tokenizer with the usual pre-tokenizer pattern encodes independently.

    A text that holds a special token, or a control character that only some libraries take for white space, is one part.
    """
    if not text:
        return []
    if any(s in text for s in special) or _SEPARATORS.search(text):
        return [text]
    if not _SPACE_BEFORE_SPACE.search(text) and text[0] != " ":
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]
    return _PARTS.findall(text)


@cache
def byte_level(path: str) -> tuple[Tokenizer, tuple[str, ...], bool]:
    """The tokenizer, its special tokens, and whether byte_level_parts holds for it."""
    t = Tokenizer.from_file(path)
    return t, tuple(str(x) for x in t.get_added_tokens_decoder().values() for x in [x.content]), type(t.pre_tokenizer).__name__ == "ByteLevel" and t.pre_tokenizer.use_regex and not t.pre_tokenizer.add_prefix_space and t.normalizer is None


class Lengths(dict):
    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def parts(self, text: str) -> list[str]:
        if self.path.endswith(".model"):
            return words_of(text)
        _, special, splits = byte_level(self.path)
        return byte_level_parts(text, special) if splits else [text]

    def learn(self, parts: set[str]) -> None:
        if len(self) > MEMO_PARTS:
            self.clear()
        new = [p for p in parts if p not in self]
        if not new:
            return
        if self.path.endswith(".model"):
            sizes = map(len, processor(self.path).encode([p[1:] if p[0] == SPACE else p for p in new], num_threads=1))
            self.update(zip(new, sizes))
            if SPACE in parts:
                self[SPACE] = 1
        else:
            self.update(zip(new, (len(e.ids) for e in byte_level(self.path)[0].encode_batch_fast(new, add_special_tokens=False))))


@cache
def lengths(path: str) -> Lengths:
    return Lengths(path)


def count_batch(texts: pa.Array, path: str) -> list[int]:
    known, out = lengths(path), []
    for a, b in text_groups(texts, GROUP_BYTES):
        split = [known.parts(t) for t in texts.slice(a, b - a).to_pylist()]
        known.learn(set().union(*split))
        out += [sum(map(known.__getitem__, parts)) for parts in split]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text; path: a .json or .model tokenizer file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            n = count_batch(text, path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.binary_length(text.cast(pa.binary())).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(trimmed(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
