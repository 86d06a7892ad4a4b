"""Language identification with hyperdimensional profiles.

Every letter (lower-case code point) has a random vector of +1 and -1 of its own, drawn by a seed from its code point. An n-gram of three letters is bound into the product of their vectors, each
permuted by its place; a text is the sum (bundle) of its n-grams, and a language's prototype the bundle of its learning
texts. A text gets the language of the prototype with the largest cosine.

Letters are lower-cased; all else is one gap. Learning takes rows with text and language; each task sends one vector of
fixed size per language, and these are summed in two steps. A text that is null or has no letter is `und` with score 0, as is every
text if nothing could be learnt. Ties go to the language first in order. Rows are judged one by one, so repeated rows
get equal results; an empty table gives an empty result. Texts are read whole; one with very many different n-grams is
bundled in parts. Columns under the result's two names are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, schema_of, valid_text

#: Dimensions of a vector, the seed of the letters' vectors, bits of a code point, and vectors of n-grams held at once.
DIMENSIONS, SEED, BITS, HELD = 1024, 7, 21, 1 << 16
#: Parts that a language's vectors are summed in first.
PARTS = 256
UNKNOWN = "und"
LOW = (1 << BITS) - 1


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """For each code point that of its lower-case letter, or 0 if it is no letter."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))], np.int32)


class LetterVectors:
    """The vector of each letter met so far, drawn by a seed of its own, and of the gap (0)."""

    def __init__(self) -> None:
        self.place = np.full(1 << BITS, -1, np.int32)
        self.table, self.n = np.zeros((256, DIMENSIONS), np.int8), 0

    def of(self, letters: np.ndarray) -> np.ndarray:
        for letter in np.unique(letters[self.place[letters] < 0]).tolist():
            if self.n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.n] = np.random.Generator(np.random.PCG64([SEED, letter])).choice(np.array([-1, 1], np.int8), DIMENSIONS)
            self.place[letter], self.n = self.n, self.n + 1
        return self.table[self.place[letters]]


@lru_cache(1)
def letter_vectors() -> LetterVectors:
    return LetterVectors()


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-gram codes: the product of their letters', permuted for the first and the second place."""
    own = letter_vectors()
    return np.roll(own.of(grams >> 2 * BITS), 2, axis=1) * np.roll(own.of(grams >> BITS & LOW), 1, axis=1) * own.of(grams & LOW)


def grams_of(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, gaps of any length as one; those around a gap alone are left out."""
    if not text:
        return np.zeros(0, np.int64)
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not codes.any():
        return np.zeros(0, np.int64)
    letter = codes > 0
    codes = codes[letter | np.append(True, letter[:-1])]
    codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
    middle = codes[1:-1]
    return (codes[:-2] << 2 * BITS | middle << BITS | codes[2:])[middle > 0]


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of n-grams, each as often as it occurs."""
    total = np.zeros(DIMENSIONS)
    for lo in range(0, len(grams), 4096):
        total += counts[lo : lo + 4096].astype(np.float32) @ bound(grams[lo : lo + 4096]).astype(np.float32)
    return total


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # a row of unit length for each language


def learn(docs: DataFrame, use: Column) -> Prototypes:
    """Prototypes from the text and lang of the rows under use."""
    rows = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), valid_text())
    kinds = "lang string, part int, vector binary"

    def per_task(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches(batched):
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(lang, []).append(grams_of(text))
            for lang, lists in own.items():
                grams, counts = np.unique(np.concatenate(lists), return_counts=True)
                sums[lang] = sums.get(lang, 0) + bundle(grams, counts)
        part = TaskContext.get().partitionId() % PARTS
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([total.tobytes()])], schema=schema_of(kinds))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in pdf["vector"]], axis=0)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "part": pdf["part"].iloc[:1], "vector": [total.tobytes()]})

    # part by part, then of all parts: no group has a vector for each task
    summed = rows.mapInArrow(per_task, kinds).groupBy("lang", "part").applyInPandas(add, kinds).groupBy("lang").applyInPandas(add, kinds)
    found = sorted((r["lang"], np.frombuffer(bytes(r["vector"]))) for r in summed.select("lang", "vector").collect())  # one row a language
    found = [(lang, v) for lang, v in found if v.any()]
    return Prototypes([lang for lang, _ in found], np.array([v / np.linalg.norm(v) for _, v in found]).reshape(len(found), DIMENSIONS))


def judge(texts: list[str | None], prototypes: Prototypes) -> tuple[list[str], list[float]]:
    """Language and cosine (0 if negative) of each text."""
    languages, scores = [], []
    own = [np.unique(grams_of(text), return_counts=True) for text in texts]
    every = np.unique(np.concatenate([grams for grams, _ in own])) if own else np.zeros(0, np.int64)
    vectors = bound(every) if len(every) <= HELD else None
    for grams, counts in own:
        if not len(grams) or not prototypes.languages:
            languages.append(UNKNOWN)
            scores.append(0.0)
            continue
        total = bundle(grams, counts) if vectors is None else counts.astype(np.float32) @ vectors[np.searchsorted(every, grams)].astype(np.float32)
        cosines = prototypes.vectors @ total / max(float(np.linalg.norm(total)), 1e-9)
        best = int(np.argmax(cosines))
        languages.append(prototypes.languages[best])
        scores.append(min(1.0, max(0.0, float(cosines[best]))))
    return languages, scores


def identify(docs: DataFrame, prototypes: Prototypes, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, with the language and its score under these names in place of any such columns."""
    docs = docs.drop(label, score).withColumn("text", valid_text())
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            languages, scores = judge(batch.column(at).to_pylist(), prototypes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, label, score])

    return docs.mapInArrow(run, schema)
