"""Token ids of a corpus in binary shards, each one file that holds a wavelet matrix.

Documents are range-partitioned by doc_id, encoded, and cut into shards at document borders. A shard's file holds the
doc_ids, the lengths and one bit-plane for each bit of an id, highest first. In plane l the ids stand in the order that
a stable partition by the bits above l gives them, zeros first, so a rank on each plane leads from a position to the
next plane. Planes are cut into blocks, each compressed by itself; a directory of the ones before each block is the start of
every rank and select. Access, counts, ranks, and the place of the k-th occurrence read the directory and a few blocks of
each plane.

Encoding looks words up in a bounded table of what the tokenizer made of them: between a non-space and a space the
pattern of these vocabularies always splits, so stretches between such cuts can be encoded apart.
Texts that hold an added token (none has a space) get its id, as from the library's plain call.

Null texts count as empty: the end id alone. An empty table gives no shard and an empty result. Repeated doc_ids get a
place each, in the order of their texts. Bytes that are no UTF-8 count as replacement characters. A text of any length is
encoded whole and lies in one shard, which is held in memory while it is built. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, fresh_path, open_fs, out_batch, parallelism, valid_text, write_file, written

MAGIC = b"PFWM0002"
#: Bits of a block of a plane, the unit of the directory and of reads.
BLOCK = 1 << 14
#: Ids in a shard before it is closed, and entries of the word table before it starts anew.
SHARD_IDS, TABLE = 1 << 22, 1_500_000
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Where a text may need the search for cuts, as a space or newline may follow another space.
UNEVEN = ["  ", " \n", "\n ", "\n\n", "\0", *(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")]

MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Ids below 2 ** levels; planes are packed bits, lowest bit of a byte first, in blocks of BLOCK bits.

    before[l][b] is how many ones plane l has before block b, the directory that rank and select start from. A matrix
    is held in memory or read from a file block by block, as block() gives them.
    """

    def __init__(self, n: int, zeros: list[int], before: list[np.ndarray], block):
        self.n, self.zeros, self.before, self.block = n, zeros, before, block

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        now, planes, zeros = np.ascontiguousarray(ids), [], []
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            planes.append(np.packbits(bit, bitorder="little"))
            low = now.take(np.flatnonzero(~bit))
            zeros.append(len(low))
            now = np.concatenate([low, now.take(np.flatnonzero(bit))])
        size = BLOCK // 8
        before = [np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), size)))]) if len(p) else np.zeros(1, np.int64) for p in planes]
        return cls(len(ids), zeros, before, lambda level, b: planes[level][b * size : (b + 1) * size])

    def plane(self, level: int) -> np.ndarray:
        """A whole plane, packed."""
        return np.concatenate([np.zeros(0, np.uint8), *(self.block(level, b) for b in range(len(self.before[level]) - 1))])

    def all(self, kind=np.uint32) -> np.ndarray:
        """Every id in its place: the planes undone from the lowest."""
        ids = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit, up = np.unpackbits(self.plane(level), count=self.n, bitorder="little").view(bool), np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = ids[: self.zeros[level]]
            up[np.flatnonzero(bit)] = ids[self.zeros[level] :] | kind(1 << (len(self.zeros) - 1 - level))
            ids = up
        return ids

    def ones_before(self, level: int, at):
        """Ones among the first at bits of a plane; at may be an array."""
        at = np.asarray(at, dtype=np.int64)
        flat, b = at.ravel(), at.ravel() // BLOCK
        out = self.before[level][b]
        for u in np.unique(b[flat > b * BLOCK]).tolist():
            data = self.block(level, u)
            upto = np.concatenate([[0], np.cumsum(np.bitwise_count(data), dtype=np.int64)])
            here = np.flatnonzero(b == u)
            inside = flat[here] - u * BLOCK
            tail = np.append(data, np.uint8(0))[inside >> 3] & ((1 << (inside & 7)) - 1).astype(np.uint8)
            out[here] += upto[inside >> 3] + np.bitwise_count(tail)
        return out.reshape(at.shape)

    def access(self, at):
        """The ids at these positions."""
        at = np.asarray(at, dtype=np.int64)
        ids = np.zeros_like(at)
        for level in range(len(self.zeros)):
            ones = self.ones_before(level, at)
            bit = self.ones_before(level, at + 1) - ones
            ids = ids << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return ids

    def _walk(self, id_: int, at: int) -> tuple[int, int]:
        """Where the run of an id begins on the last plane, and how far the first at positions reach into it."""
        lo, hi = 0, at
        for level in range(len(self.zeros)):
            a, b = self.ones_before(level, [lo, hi]).tolist()
            if id_ >> (len(self.zeros) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, id_: int, at: int) -> int:
        """Occurrences of an id among the first at positions."""
        if id_ >> len(self.zeros):
            return 0
        lo, hi = self._walk(id_, at)
        return hi - lo

    def count(self, id_: int) -> int:
        return self.rank(id_, self.n)

    def _nth(self, level: int, one: int, k: int) -> int:
        """The position of the k-th one or zero of a plane: the directory gives its block."""
        ones = self.before[level]
        counts = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        b = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.block(level, b), bitorder="little")[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[b])])

    def select(self, id_: int, k: int) -> int:
        """The position of the k-th occurrence, counted from 0; -1 if there are fewer."""
        if not 0 <= k < self.count(id_):
            return -1
        at = self._walk(id_, 0)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = id_ >> (len(self.zeros) - 1 - level) & 1
            at = self._nth(level, one, at - self.zeros[level] if one else at)
        return at


def dump(doc_ids: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix, nulls: list[int]) -> list[bytes]:
    """The parts of a shard's file: head, doc_ids and lengths, the directory, then the planes' blocks, each compressed by itself."""
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = [press(matrix.block(level, b).tobytes()) for level in range(len(matrix.zeros)) for b in range(len(matrix.before[level]) - 1)]
    ones = np.concatenate([np.zeros(0, np.int64), *matrix.before]).astype("<i8")
    starts = np.cumsum([0, *map(len, blocks)]).astype("<i8")
    parts = [press(x.tobytes()) for x in (doc_ids.astype("<i8"), lengths.astype("<i8"), ones, starts)]
    head = json.dumps({"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "null_ids": nulls, "block": BLOCK, "sizes": [len(p) for p in parts]}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *parts, *blocks]


class ShardFile:
    """A shard's file (any object with seek and read): the head and directory are read, blocks when they are asked for."""

    def __init__(self, file):
        self.file = file
        start = file.read(16)
        if start[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        size = int.from_bytes(start[8:16], "little")
        self.head = json.loads(file.read(size))
        if self.head["block"] != BLOCK:
            raise ValueError(f"blocks of {self.head['block']} bits can't be read as of {BLOCK}")
        self.at = np.cumsum([16 + size, *self.head["sizes"]]).tolist()
        self.unpress = zstandard.ZstdDecompressor().decompress
        ones, self.starts = self._part(2), self._part(3) + self.at[4]
        n, levels = self.head["n"], len(self.head["zeros"])
        self.per = -(-n // BLOCK)
        self.held = lru_cache(64)(self._block)
        self.matrix = WaveletMatrix(n, self.head["zeros"], list(ones.reshape(levels, self.per + 1)) if levels else [], self.held)

    def _read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)

    def _part(self, i: int) -> np.ndarray:
        return np.frombuffer(self.unpress(self._read(self.at[i], self.at[i + 1])), "<i8")

    def _block(self, level: int, b: int) -> np.ndarray:
        i = level * self.per + b
        return np.frombuffer(self.unpress(self._read(int(self.starts[i]), int(self.starts[i + 1]))), np.uint8)

    def documents(self) -> tuple[list, np.ndarray]:
        """doc_ids and lengths."""
        doc_ids = self._part(0).tolist()
        for i in self.head["null_ids"]:
            doc_ids[i] = None
        return doc_ids, self._part(1)


class Encoder:
    """A tokenizer of the tokenizers library with a bounded table of words that it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        splits, added = own["pre_tokenizer"] or {}, [t["content"] for t in own["added_tokens"]]
        if own["normalizer"] or own["post_processor"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex") or own["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE with its own splitting pattern is known to split between a non-space and a space")
        if any(c.isspace() for t in added for c in t):
            raise ValueError("an added token with a space could be cut")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.levels = max(vocab.values()).bit_length()
        self.kind = np.uint16 if self.levels <= 16 else np.uint32
        # a byte-level token has a character for each byte
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.n_bytes[list(vocab.values())] = [len(token) for token in vocab]
        self.ends = {x: int(self._raw(x)[0]) for x in ".,"}
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, self.kind), 0
        self.starts, self.lengths = np.zeros(TABLE, np.int64), np.zeros(TABLE, np.int64)

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _enter(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add words with the ids of all on end."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        i, n = len(self.index), len(words)
        self.index.update(zip(words, range(i, i + n), strict=True))
        self.lengths[i : i + n] = lengths
        self.starts[i : i + n] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of table entries on end, and where each one's end."""
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)], ends

    @staticmethod
    def _stretch(word: str) -> str:
        """What a key of the table stands for."""
        return word[1:] if word[:1] == "\0" else word if word[:1] == "\n" else " " + word

    @staticmethod
    def _words(text: str) -> list[str]:
        """Keys of the stretches of a text between cuts: "\\0x" is x, "\\nx" is itself, and x is " x"."""
        if any(x in text for x in UNEVEN):
            return ["\0" + x for x in CUT.split(text)]
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\0" + words[0]
        return words

    def _learn(self, words: list[str]) -> None:
        apart, ended, joint = [], [], {}
        for word in words:
            if word[:1] in ("", "\0") or word[-1].isspace():
                apart.append(word)
            elif word[-1] in ".," and word[:-1].isalpha() and max(word) < "\u0250":
                ended.append(word)
                joint[word[:-1]] = None
            else:
                joint[word] = None
        fresh = [word for word in joint if word not in self.index]
        if fresh:
            spaced = [self._stretch(word) for word in fresh]
            ids = np.concatenate([self._raw("".join(spaced[lo : lo + 64])) for lo in range(0, len(fresh), 64)])
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(x.encode()) for x in spaced])) + 1
            self._enter(fresh, ids, np.diff(ends, prepend=0))
        if ended:
            ids, ends = self._gather(np.array([self.index[word[:-1]] for word in ended]))
            self._enter(ended, np.insert(ids, ends, [self.ends[word[-1]] for word in ended]), np.diff(ends, prepend=0) + 1)
        for word in apart:
            ids = self._raw(self._stretch(word))
            self._enter([word], ids, np.array([len(ids)]))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each with end_id after it, and how many each has."""
        spans, words = [], []
        for text in texts:
            own = self._words(text) if text else []
            spans.append(len(own))
            words += own
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            if len(self.index) + 2 * len(new) > TABLE:
                self._clear()
                new, missing = list(dict.fromkeys(words)), range(len(words))
                if 2 * len(new) > TABLE:
                    half = len(texts) // 2
                    if not half:  # one text with more words than the table holds
                        ids = np.append(self._raw(texts[0]), self.kind(end_id))
                        return ids, np.array([len(ids)])
                    a, b = self.encode(texts[:half], end_id), self.encode(texts[half:], end_id)
                    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            self._learn(new)
            at[missing] = [self.index[words[i]] for i in missing]
        flat, ends = self._gather(at)
        upto = np.concatenate([[0], ends])[np.cumsum(spans)] if spans else np.zeros(0, np.int64)
        lengths = np.diff(upto, prepend=0) + 1
        return np.insert(flat, upto, self.kind(end_id)), lengths


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode all texts into shard files in ascending doc_id order; returns the written manifest of the shards.

    Columns: part and seq (their order is that of the shards), file, n_docs, n_ids.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids), own.levels)
            nulls = [i for i, x in enumerate(doc_ids) if x is None]
            file = write_file(folder, f"shard-{part:06d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.wm", dump(np.array([x or 0 for x in doc_ids], np.int64), np.concatenate(lengths), matrix, nulls))
            return out_batch(MANIFEST, [[part], [seq], [file], [len(doc_ids)], [matrix.n]])

        for batch in batches(rows, 2 << 20):
            flat, sizes = own.encode([text or "" for text in batch.column(1).to_pylist()], end_id)
            doc_ids += batch.column(0).to_pylist()
            ids.append(flat)
            lengths.append(sizes)
            if sum(map(len, ids)) >= SHARD_IDS:
                yield close()
                doc_ids, ids, lengths, seq = [], [], [], seq + 1
        if doc_ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), valid_text()).repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("file", before.alias("before")).repartition(parallelism(manifest.sparkSession))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, at = open_fs(file)
                with files.open_input_file(at) as f:
                    shard = ShardFile(io.BytesIO(f.read()))  # every id is wanted here
                doc_ids, lengths = shard.documents()
                ids = shard.matrix.all(np.uint16 if len(shard.head["zeros"]) <= 16 else np.uint32).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[lo:hi]) for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield out_batch(ROWS, [doc_ids, start + ends - lengths, lengths, crcs])

    return placed.mapInArrow(run, ROWS)
