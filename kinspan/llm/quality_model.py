"""Quality classifier learned from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing. How often each pattern of votes occurs is counted over
all documents; expectation-maximisation on those counts gives every labeller's vote probabilities in either class, and
so the posterior of each pattern. Posteriors of a bounded sample label a linear scorer on hashed word shapes, which
scores all documents; labellers alone do not see what it sees, and it needs no labeller at scoring time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm import _docs

GOOD, BAD, NONE = 0, 1, 2
#: Hashed features; documents (at most) on which the scorer is fitted; its passes over them.
FEATURES, SAMPLE, STEPS = 1 << 16, 8192, 300
#: Words of a stretch in which different ones are counted, so that long texts are judged like short ones.
STRETCH = 500
#: Score from which a document is kept.
KEEP = 0.5
_SYMBOLS = bytes(b for b in range(256) if chr(b) not in "#*$%&|<>")
_MARKS = bytes(b for b in range(256) if b <= 32 or b >= 127 or chr(b).isalnum())
#: White space, and the bytes that continue a character.
_NO_CHARACTER = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_UPPER, _SHOUT, _STOP, _ODD = 1, 2, 4, 8


@dataclass
class Signs:
    """What labellers look at."""

    n: int  # words
    symbols: int
    upper: int  # words of two letters or more, all upper-case
    shouts: int  # words that end in an exclamation mark
    stops: int  # words that end a sentence or clause
    stutters: int  # words equal to the one before
    distinct: int  # words that differ, of stretches of STRETCH words each
    lines: int
    repeats: int  # lines equal to an earlier one
    size: int  # characters in words
    odd: int  # words that end in neither a letter, a digit nor common punctuation
    marks: int  # ASCII characters that are neither letters, digits nor white space


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Each votes on a document with at least one word.
LABELLERS: dict[str, Callable[[Signs], int]] = {
    "symbols": lambda s: _vote(5 * s.symbols > s.n, 50 * s.symbols <= s.n),
    "odd_ends": lambda s: _vote(5 * s.odd > s.n, 25 * s.odd <= s.n),
    "marks": lambda s: _vote(s.n >= 20 and 100 * s.marks > 9 * s.size, 100 * s.marks <= 6 * s.size),
    "upper_case": lambda s: _vote(3 * s.upper > s.n, 20 * s.upper <= s.n),
    "shouting": lambda s: _vote(4 * s.shouts > s.n, 20 * s.shouts <= s.n),
    "stutter": lambda s: _vote(4 * s.stutters > s.n and s.n >= 8, 20 * s.stutters <= s.n),
    "variety": lambda s: _vote(s.n >= 20 and 10 * s.distinct < s.n, s.n >= 20 and 10 * s.distinct > 3 * s.n),
    "sentences": lambda s: _vote(s.n >= 60 and s.stops == 0, 100 * s.stops >= s.n),
    "repeated_lines": lambda s: _vote(s.repeats > 0 and 2 * s.repeats > s.lines, 10 * s.repeats <= s.lines),
    "word_length": lambda s: _vote(not 2 * s.n <= s.size <= 20 * s.n, 3 * s.n <= s.size <= 12 * s.n),
}


def _shape(word: bytes) -> int:
    """A hashed feature of the word's shape, above the word's flags."""
    text = word.decode("utf-8", "replace")
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text]
    runs = "".join(k if k != kinds[i - 1] or not i else "" for i, k in enumerate(kinds))
    letters = [k for k in kinds if k in "Aa"]
    flags = _UPPER * (len(letters) > 1 and "a" not in letters) | _SHOUT * text.endswith("!") | _STOP * text.endswith((".", ",", ";", ":", "?"))
    flags |= _ODD * (not text[-1].isalnum() and text[-1] not in ".,;:?!\"')]»”’")
    return xxhash.xxh3_64_intdigest(runs.encode()) % (FEATURES - 64) << 4 | flags


class Reader:
    """Signs and features of a text."""

    def __init__(self):
        self.shapes = _docs.Cache(_shape)

    def read(self, text: bytes) -> tuple[Signs, np.ndarray, np.ndarray] | None:
        """None for a text without a word."""
        words = text.split()
        n = len(words)
        if not n:
            return None
        packed = np.fromiter(map(self.shapes.__getitem__, words), np.int64, n)
        flags = np.bincount(packed & 15, minlength=16)
        upper, shouts, stops, odd = (int(flags[[k for k in range(16) if k & b]].sum()) for b in (_UPPER, _SHOUT, _STOP, _ODD))
        lines = [x for x in text.split(b"\n") if x]
        signs = Signs(
            n,
            len(text.translate(None, _SYMBOLS)),
            upper,
            shouts,
            stops,
            sum(map(bytes.__eq__, words, words[1:])),
            sum(len(set(words[k : k + STRETCH])) for k in range(0, n, STRETCH)),
            len(lines),
            len(lines) - len(set(lines)),
            len(text.translate(None, _NO_CHARACTER)),
            odd,
            len(text.translate(None, _MARKS)),
        )
        shapes, times = np.unique(packed >> 4, return_counts=True)
        extra = [signs.stutters / n, 1 - signs.distinct / n, signs.repeats / max(1, len(lines)), signs.symbols / n]
        at = np.concatenate([shapes, FEATURES - 64 + np.arange(len(extra))])
        values = np.concatenate([times / n, np.minimum(extra, 2.0)])
        return signs, at, values


def votes(signs: Signs) -> int:
    """All labellers' votes as one number in base 3."""
    pattern = 0
    for labeller in LABELLERS.values():
        pattern = 3 * pattern + labeller(signs)
    return pattern


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each pattern of votes.

    Votes are independent within a class. A bad document is often bad in one way only, so most labellers pass it; but
    hardly any labeller votes bad on a good one. That is where the search starts, and what a prior of a tenth of all
    documents' weight holds it to in the class of good ones.
    """
    m = len(LABELLERS)
    vote = patterns[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3
    prior = 0.8
    table = np.empty((2, m, 3))  # of a class, a labeller, a vote
    start = np.array([(0.85, 0.005, 0.145), (0.70, 0.20, 0.10)])
    table[GOOD], table[BAD] = start
    held = np.array([[0.1 * counts.sum()], [0.1]]) * start + 0.1  # no vote is impossible
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log(table)
        each = [logs[c][np.arange(m), vote].sum(axis=1) for c in (GOOD, BAD)]
        before = posterior
        posterior = 1 / (1 + np.exp(np.clip(each[BAD] + np.log(1 - prior) - each[GOOD] - np.log(prior), -500, 500)))
        for c, share in ((GOOD, posterior), (BAD, 1 - posterior)):
            weight = share * counts
            for j in range(m):
                got = np.bincount(vote[:, j], weight, 3) + held[c]
                table[c, j] = got / got.sum()
        prior = float(np.clip((posterior * counts).sum() / max(counts.sum(), 1), 0.01, 0.99))
        if np.abs(posterior - before).max(initial=0) < 1e-9:
            break
    return posterior


@dataclass
class Model:
    posteriors: dict[int, float]
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(values @ self.weights[at] + self.bias, -50, 50))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps whose size adapts to each feature."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not len(rows):
        return weights, bias
    row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
    used, at = np.unique(np.concatenate([at for at, _ in rows]), return_inverse=True)
    values = np.concatenate([v for _, v in rows])
    w, seen, seen_bias = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    balance = np.where(labels >= 0.5, 0.5 / max((labels >= 0.5).sum(), 1), 0.5 / max((labels < 0.5).sum(), 1))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * w[at], len(rows)) + bias, -50, 50)))
        error = (p - labels) * balance
        slope = np.bincount(at, values * error[row], len(used)) + 1e-6 * w
        seen += slope**2
        seen_bias += error.sum() ** 2
        w -= 0.5 * slope / np.sqrt(seen)
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    weights[used] = w
    return weights, float(bias)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from `docs` (doc_id, text).

    Vote patterns are counted over all documents; the driver gets at most 3 ** len(LABELLERS) counts. The scorer is
    fitted on at most about `sample` documents, those of the least hashed doc_id and text, whatever the partitions;
    wholly equal rows count once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(), {}
        for batch in batches:
            for text in _docs.utf8(batch.column(1)):
                found = reader.read(text)
                pattern = -1 if found is None else votes(found[0])
                held[pattern] = held.get(pattern, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["pattern", "n"]
        )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            read = [(h, *f) for h, f in zip(batch.column(1).to_pylist(), map(reader.read, _docs.utf8(batch.column(0)))) if f is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, *_ in read], pa.int64()),
                    pa.array([votes(s) for _, s, *_ in read], pa.int64()),
                    pa.array([at.astype("<i4").tobytes() for *_, at, _ in read], pa.binary()),
                    pa.array([values.astype("<f4").tobytes() for *_, values in read], pa.binary()),
                ],
                names=["h", "pattern", "at", "values"],
            )

    spark, narrow = docs.sparkSession, _docs.texts(docs)
    _docs.bound_batches(spark)
    counted = {r[0]: r[1] for r in narrow.mapInArrow(count, "pattern long, n long").groupBy("pattern").sum("n").collect()}
    total = sum(counted.values())
    counted.pop(-1, None)
    patterns = np.array(sorted(counted), np.int64)
    posterior = expectation_maximisation(patterns, np.array([counted[p] for p in patterns.tolist()], float))
    posteriors = dict(zip(patterns.tolist(), posterior.tolist()))
    keyed = narrow.select("text", F.xxhash64("doc_id", "text").alias("h"))
    bound = _docs.least_hashes(keyed.select("h"), sample, total) if total else None
    rows = []
    if bound is not None:
        found = keyed.where(F.col("h") <= bound).mapInArrow(features, "h long, pattern long, at binary, values binary")
        rows = [r[1:] for r in found.dropDuplicates(["h"]).collect()]
    rows.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    labels = np.array([posteriors.get(r[0], 0.5) for r in rows])
    weights, bias = fit_scorer([(np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4")) for r in rows], labels)
    return Model(posteriors, weights, bias)


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the linear scorer) and kept of each row of `docs`.

    model: by default fitted on the same documents. A text that is null or has no word gets 0 and isn't kept. Rows
    with equal or null doc_id are judged each on its own. An empty table gives no rows. Further columns are not read.
    """
    fitted = fit(docs) if model is None else model

    def make():
        reader = Reader()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            posterior, scores = [], []
            for text in _docs.utf8(batch.column(1)):
                found = reader.read(text)
                posterior.append(0.0 if found is None else fitted.posteriors.get(votes(found[0]), 0.5))
                scores.append(0.0 if found is None else fitted.score(*found[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(posterior, pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array([s >= KEEP for s in scores], pa.bool_()),
                ],
                names=["doc_id", "posterior", "score", "kept"],
            )

        return each

    return _docs.map_batches(_docs.texts(docs), make, "doc_id long, posterior double, score double, kept boolean")


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` that `classify` keeps, with all their columns, whatever their names.

    Texts that are null or have no word go; equal rows are judged alike, each on its own; an empty table gives no rows.
    """
    fitted = fit(docs) if model is None else model

    def make():
        reader = Reader()

        def each(texts: list[bytes]) -> list[bool]:
            found = map(reader.read, texts)
            return [f is not None and fitted.score(*f[1:]) >= KEEP for f in found]

        return each

    return _docs.keep_rows(docs, make)
