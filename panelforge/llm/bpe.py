"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to short leaves; a leaf's ids come from the rank file, and two neighbours are joined by encoding
a window around their border anew. Two facts bound the window:

* No match of the splitting pattern holds a non-space followed by a space, so a border between the two is always a
  border of matches ("cut"). Ids left of a cut before the window and right of a cut after it can't change. The search for
  a cut doubles its reach until it finds one.
* Inside one match (a very long word), a sequence of tokens is the encoding of its bytes exactly if every adjacent pair
  is the encoding of its own bytes. The window grows by doubling until both pairs at its ends pass that test.

Decoding joins the bytes of the halves up the same tree.

Rows with null text count as empty (no ids); an empty table gives an empty table; repeated rows and repeated doc_ids give
a row each; other columns of the input are ignored, whatever their names. Bytes that are no UTF-8 count as replacement
characters; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, out_batch, valid_text

#: Characters of a leaf, and bytes of a match beyond which it's encoded by halves itself.
LEAF, LONG_MATCH = 512, 128
#: A non-space and then a space: the text can be cut between them.
CUT = re.compile(r"\S[ \n]")
#: Patterns whose matches are known to end there: a space or newline only begins a match, or follows other spaces.
CUT_BY = frozenset([public_tokenizers.PATTERN])

ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, decoded binary"


class Codec:
    """Ranks and pattern of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        if pattern not in CUT_BY:
            raise ValueError("only patterns of which no match holds a non-space and then a space can be cut there")
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.fits = lru_cache(1 << 16)(self._fits)

    def merged(self, data: bytes) -> list[int]:
        """Ids of a short run of bytes: the lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, within one match."""
        if not left or not right:
            return left + right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merged(b"".join(self.bytes_of[x] for x in left[i:] + right[:j]))
            if (i == 0 or self.fits(left[i - 1], window[0])) and (j == len(right) or self.fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def match(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= 16:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self._halves(data[:middle]), self._halves(data[middle:]))

    def window(self, text: str) -> list[int]:
        """Ids of a stretch between two cuts."""
        if len(text) <= LONG_MATCH:
            return self.plain(text)
        ids: list[int] = []
        for piece in self.split(text):
            ids += self.plain(piece) if len(piece) <= LONG_MATCH else self.match(piece.encode())
        return ids

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            part = text[lo:hi]
            return self.plain(part) if CUT.search(part) else self.window(part)
        mid = (lo + hi) // 2
        left, right = self._tree(text, lo, mid), self._tree(text, mid, hi)
        start, end = self._cut_before(text, lo, mid), self._cut_after(text, mid, hi)
        middle = self.window(text[start:end])
        gone_left = len(left) if start == lo else len(self.window(text[start:mid]))
        gone_right = len(right) if end == hi else len(self.window(text[mid:end]))
        del left[len(left) - gone_left :]
        left += middle
        left += right[gone_right:]
        return left

    @staticmethod
    def _cut_before(text: str, lo: int, mid: int) -> int:
        reach = 16
        while True:
            start = max(lo, mid - reach)
            found = None
            for found in CUT.finditer(text, start, mid):
                pass
            if found:
                return found.start() + 1
            if start == lo:
                return lo
            reach *= 2

    @staticmethod
    def _cut_after(text: str, mid: int, hi: int) -> int:
        found = CUT.search(text, mid, hi)
        return found.start() + 1 if found else hi

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row's text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches(rows):
            ids = [np.array(own.encode(text) if text else [], dtype="<u4") for text in batch.column(1).to_pylist()]
            yield out_batch(ENCODED, [batch.column(0), [len(x) for x in ids], [x.tobytes() for x in ids]])

    return docs.select(F.col("doc_id").cast("long"), valid_text()).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encode_documents with the bytes that their ids stand for."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches(rows):
            yield out_batch(DECODED, [*batch.columns, [own.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column(2).to_pylist()]])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
