"""Tokens of whole texts: ids, their places, and counts by section.

A text is encoded once, as a whole.  Each token's character span is then held
against the spans of fields or sections, and a token that crosses a boundary goes,
by rule, to the section with most of its characters, the earlier one on a tie.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Texts of these characters alone go through the faster of two libraries that give
#: the same ids; what is special to either, and rarer scripts, goes through `tokenizers`.
COMMON = r"[\t\n\r\x20-\x7e\xa1-ɏ–-…€]*"
SPECIAL = "<|"


class Encoder:
    """Ids of the tokenizer file `name`, as `tokenizers` gives them without special tokens.

    name: of the public tokenizer, or a path; a .tiktoken file beside it, of the same
    vocabulary, serves common texts.
    """

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("common", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)
        self.common = re.compile(COMMON).fullmatch

    def _is_common(self, text: str) -> bool:
        return SPECIAL not in text and self.common(text) is not None

    def ids(self, text: str) -> np.ndarray:
        if self._is_common(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last, of each token.

        Tokens that share the bytes of one character all span it.
        """
        if not self._is_common(text):
            found = self.whole.encode(text, add_special_tokens=False).offsets
            at = np.array(found, np.int64).reshape(-1, 2)
            return at[:, 0], at[:, 1]
        ends = np.cumsum(self.bytes[np.array(self.fast.encode_ordinary(text), np.int64)])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        if not text.isascii():
            char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # of each byte
            starts, ends = char[starts], char[ends - 1] + 1
        return starts, ends


def attributed(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary.

    bounds: where sections start, ascending, then where the last one ends; sections
    cover the tokens.  An empty section has no tokens.
    """
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, 0, n - 1)
    to, crosses = first.copy(), np.flatnonzero(first != last)
    for t in crosses:
        parts = np.arange(first[t], last[t] + 1)
        shared = np.minimum(bounds[parts + 1], ends[t]) - np.maximum(bounds[parts], starts[t])
        to[t] = parts[shared.argmax()]
    return np.bincount(to, minlength=n), np.bincount(to[crosses], minlength=n)


def line_bounds(text: str) -> np.ndarray:
    """Lines as sections, each with its line feed; a text without one is one section."""
    after = [m.end() for m in re.finditer("\n", text)]
    return np.array([0, *after, *([len(text)] if not after or after[-1] < len(text) else [])], np.int64)


SECTIONS = "doc_id long, section int, start int, end int, tokens long, crossing long"


def section_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", fields: tuple[str, ...] = ()) -> DataFrame:
    """Token counts by line of docs(doc_id, text), or by field.

    fields: the columns whose texts, one after the other, are the document; each is
    a section then, without more separators.  Result: doc_id, section (from 0),
    start and end (characters), tokens, and crossing: those of them that reach into
    another section.  The tokens of a document's sections add up to its tokens.

    A null text counts as empty; an empty document is one section of no tokens.
    Whole texts are encoded; repeated rows and null ids are passed through.
    """
    named = fields or ("text",)
    rows = columns(docs, doc_id="long", **dict.fromkeys(named, "string"))
    rows = rows.select("doc_id", F.array(*[F.coalesce(c, F.lit("")) for c in named]).alias("parts"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for b in batches:
            ids, out = b.column("doc_id"), []
            for row in range(b.num_rows):
                parts = b.column("parts")[row].as_py()
                text = "".join(parts)
                bounds = np.cumsum([0, *map(len, parts)]) if fields else line_bounds(text)
                tokens, crossing = attributed(*encoder.spans(text), bounds)
                out.append((np.full(len(tokens), row), np.arange(len(tokens)), bounds[:-1], bounds[1:], tokens, crossing))
            at, section, start, end, tokens, crossing = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(x.astype(np.int32)) for x in (section, start, end)), pa.array(tokens), pa.array(crossing)], ["doc_id", "section", "start", "end", "tokens", "crossing"])

    return rows.mapInArrow(each, SECTIONS)
