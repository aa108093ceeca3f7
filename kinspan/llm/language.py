"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point. An n-gram's vector
binds its letters' vectors, each rolled by its place, by multiplying them; a text's vector bundles its n-grams by
adding them. A language's prototype bundles the texts learned for it. A document gets the language whose prototype,
less what all prototypes share, has the greatest cosine with the document's vector, less the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm import _docs

DIM, GRAM = 512, 3
#: n-gram and letter vectors kept by a worker.
KEPT, LETTERS = 1 << 15, 4096
#: Languages whose prototypes may come to the driver: 4 kB each.
MOST_LANGUAGES = 4096
#: Letters' bits in an n-gram's key; GRAM of them fit in 63.
BITS = 21
SCHEMA = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_of() -> np.ndarray:
    """Of every code point: its lower-case letter's code point, or 32 if it is no letter."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _letters = table
    return _letters


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of letters, words parted by one space, and how often each is there."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    letters = _letter_of()[codes]
    gap = letters == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # of a run of other characters the first stays, as a space
    letters = letters[keep]
    if not len(letters) or (letters == 32).all():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if letters[0] != 32:
        letters = np.concatenate([[32], letters])
    if letters[-1] != 32:
        letters = np.concatenate([letters, [32]])
    letters = letters.astype(np.int64)
    n = len(letters) - GRAM + 1
    key = letters[:n].copy()
    for k in range(1, GRAM):
        key = key << BITS | letters[k : n + k]
    return np.unique(key, return_counts=True)


class Vectors:
    """n-gram vectors by key, the last ones kept."""

    def __init__(self, dim: int):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((KEPT, dim), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def _gram(self, key: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(GRAM):
            out *= np.roll(self._letter(key >> BITS * (GRAM - 1 - place) & (1 << BITS) - 1), place)
        return out

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors."""
        total = np.zeros(self.dim, np.float64)
        for start in range(0, len(keys), KEPT // 4):
            part = keys[start : start + KEPT // 4].tolist()
            if len(self.rows) + len(part) > KEPT:
                self.rows.clear()
            at = []
            for key in part:
                row = self.rows.get(key)
                if row is None:
                    row = self.rows[key] = len(self.rows)
                    self.table[row] = self._gram(key)
                at.append(row)
            total += counts[start : start + KEPT // 4].astype(np.float32) @ self.table[at]
        return total


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # unit vectors of each language, less the shared one
    shared: np.ndarray  # unit vector of what all languages have in common
    dim: int

    def predict(self, vectors: Vectors, text: bytes) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        v = vectors.bundle(keys, counts)
        v = v - (v @ self.shared) * self.shared
        norm = np.linalg.norm(v)
        cosines = self.prototypes @ v / norm if norm > 0 else np.zeros(len(self.languages))
        best = int(np.argmax(cosines))  # of equal ones the first by name
        return self.languages[best], float(min(1.0, max(0.0, (1 + cosines[best]) / 2)))


def fit(docs: DataFrame, dim: int = DIM) -> Profiles:
    """Learn a prototype of each lang of `docs` (text, lang); rows without lang, or without a letter, teach nothing.

    Each task sends one vector for each language it met; they are summed by language and place. The driver gets
    dim numbers for each language; over MOST_LANGUAGES of them are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(dim)
        held: dict[str, dict[int, int]] = defaultdict(dict)
        sums: dict[str, np.ndarray] = {}

        def settle(lang: str) -> None:
            count = held.pop(lang)
            keys = np.fromiter(count, np.int64, len(count))
            add = vectors.bundle(keys, np.fromiter(count.values(), np.int64, len(count)))
            sums[lang] = sums.get(lang, 0.0) + np.rint(add).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _docs.utf8(batch.column(1))):
                keys, counts = grams(text)
                mine = held[lang]
                for key, n in zip(keys.tolist(), counts.tolist()):
                    mine[key] = mine.get(key, 0) + n
                if len(mine) > KEPT // 2:
                    settle(lang)
        for lang in list(held):
            settle(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(total, pa.int64())],
                names=["lang", "place", "value"],
            )

    _docs.bound_batches(docs.sparkSession)
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = (
        known.where("lang is not null and text is not null")
        .mapInArrow(run, "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .limit((MOST_LANGUAGES + 1) * dim)
        .collect()
    )
    if len(rows) > MOST_LANGUAGES * dim:
        raise ValueError(f"over {MOST_LANGUAGES} languages: the column lang holds something else")
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dim))
    for lang, place, value in rows:
        sums[lang][place] = value
    languages = sorted(lang for lang, v in sums.items() if v.any())
    unit = np.array([sums[lang] / np.linalg.norm(sums[lang]) for lang in languages]).reshape(-1, dim)
    shared = unit.sum(axis=0)
    shared = shared / np.linalg.norm(shared) if len(languages) > 1 else np.zeros(dim)
    own = unit - (unit @ shared)[:, None] * shared
    norms = np.linalg.norm(own, axis=1, keepdims=True)
    return Profiles(languages, own / np.where(norms > 0, norms, 1), shared, dim)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """lang_pred and score (the cosine, moved to 0 to 1) of each row of `docs` (doc_id, text).

    Texts that are null or without a letter get UNKNOWN and 0; so does every text if nothing was learned. Rows with
    equal or null doc_id are judged each on its own. An empty table gives no rows. Further columns are not read.
    """

    def make():
        vectors = Vectors(profiles.dim)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [profiles.predict(vectors, text) for text in _docs.utf8(batch.column(1))]
            names, scores = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

        return each

    return _docs.map_batches(_docs.texts(docs), make, SCHEMA)


def held_out(doc_id="doc_id"):
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
