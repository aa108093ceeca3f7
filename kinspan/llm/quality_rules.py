"""Quality rules as a short-circuit cascade.

A document's measures are taken when a rule first asks for them. Rules, those of the base among them, are ordered by
what a sample shows: how many documents each rejects for the time it takes, with what it has to measure. A document
goes through them in that order and stops at the first that rejects it, so what only later rules ask for isn't
measured. The order changes the time only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm import _docs

#: Words in a window whose repeats count; documents on which costs and selectivities are estimated.
WINDOW, SAMPLE = 8, 256
SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)
_NO_SYMBOLS = bytes(b for b in range(256) if chr(b) not in SYMBOLS)
#: White space, and the bytes that continue a character.
_NO_CHARACTER = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
#: 64-bit multipliers of a window's words.
_FACTORS = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Document:
    """A text whose measures are taken when asked for."""

    def __init__(self, text: bytes, hash_of: dict[bytes, int]):
        self.text, self.hash_of = text, hash_of

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _NO_CHARACTER))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text.translate(None, _NO_SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return repeated_lines(self.text)

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words <= WINDOW:
            return 0
        return repeated(np.fromiter(map(self.hash_of.__getitem__, self.words), np.uint64, self.n_words))


#: Each takes a Document and says whether it rejects it. All are exact integer tests. The first two are the base.
RULES: dict[str, Callable[[Document], bool]] = {
    # Under 20 words.
    "short": lambda d: d.n_words < 20,
    # Over 30 % of the words lie in a window of words that is found twice or more.
    "repeats": lambda d: 100 * d.n_repeat_words > 30 * d.n_words,
    # More than a symbol for every five words.
    "symbols": lambda d: 5 * d.n_symbols > d.n_words,
    # Words of over 20 characters on average, or of under 2.
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words,
    # Over half of the lines that hold a word repeat an earlier one.
    "repeated_lines": lambda d: d.n_dup_lines > 0 and 2 * d.n_dup_lines > sum(1 for x in d.text.split(b"\n") if x.split()),
    # Over a quarter of the words end in an exclamation mark.
    "shouting": lambda d: 4 * sum(w.endswith(b"!") for w in d.words) > d.n_words,
    # Over a quarter of the words equal the word before them.
    "stutter": lambda d: 4 * sum(map(bytes.__eq__, d.words, d.words[1:])) > d.n_words,
}
BASE = ("short", "repeats")


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of characters other than the six ASCII white spaces."""
    return text.split()


def repeated(hashes: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of words that is found twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        keys = hashes[:n] * _FACTORS[0]
        for k in range(1, window):
            keys ^= keys >> np.uint64(29)
            keys += hashes[k : n + k] * _FACTORS[k]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + window, np.int32)
    starts = np.flatnonzero(twice)
    change[starts] += 1
    change[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


def repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.split():
            seen.add(line)
    return n


def base_failed(d: Document) -> bool:
    return any(RULES[name](d) for name in BASE)


def timings(texts: list[bytes], hash_of: dict[bytes, int]) -> dict[str, tuple[int, int, float]]:
    """For each rule how many texts it saw, how many it rejected, and the seconds it took with all it had to measure."""
    found = {}
    for name, rule in RULES.items():
        began, rejected = time.perf_counter(), 0
        for text in texts:
            d = Document(text, hash_of)
            d.words  # all rules but one need them, and it hardly matters to that one
            rejected += rule(d)
        found[name] = len(texts), rejected, time.perf_counter() - began
    return found


def ranked(measured: dict[str, tuple[int, int, float]]) -> list[str]:
    """The rules by rejections per second, then by cost."""

    def key(name: str) -> tuple:
        seen, rejected, seconds = measured.get(name, (0, 0, 0.0))
        cost = seconds / max(1, seen) + 1e-9
        return -(rejected / max(1, seen)) / cost, cost, name

    return sorted(RULES, key=key)


def plan(docs: DataFrame, rows: int = SAMPLE) -> list[str]:
    """The order of the rules on `rows` documents, those of the least hashed doc_id and text (equal rows count once).

    They are measured whole where they are; a row for each rule and task is summed, and seven numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, total = _docs.Cache(xxhash.xxh3_64_intdigest), {name: (0, 0, 0.0) for name in RULES}
        for batch in batches:
            for name, more in timings(_docs.utf8(batch.column(0)), hash_of).items():
                total[name] = tuple(a + b for a, b in zip(total[name], more))
        columns = [list(total), *zip(*total.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rule", "seen", "rejected", "seconds"])

    _docs.bound_batches(docs.sparkSession)
    narrow = _docs.texts(docs).select("text", F.xxhash64("doc_id", "text").alias("h"))
    bound = _docs.least_hashes(narrow.select("h"), rows, narrow.count())
    if bound is None:
        return ranked({})
    sample = narrow.where(F.col("h") <= bound).select("text")
    sums = sample.mapInArrow(run, "rule string, seen long, rejected long, seconds double").groupBy("rule").sum("seen", "rejected", "seconds")
    return ranked({r[0]: tuple(r)[1:] for r in sums.collect()})


def passes(d: Document, cascade: list[Callable[[Document], bool]]) -> bool:
    """Stops at the first rule that rejects."""
    return not any(rule(d) for rule in cascade)


def evaluate(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Measures and verdict of each row of `docs` (doc_id, text).

    Gives n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier
    line), n_repeat_words (words in 8-word windows found twice or more), base_failed and kept (no rule rejects).
    All of these are asked for here, so the cascade saves the further rules' own work only; in `keep` it saves most.
    order: names of all RULES; by default planned on a sample of SAMPLE documents.

    Null text is empty: all counts are 0 and it fails the base. Rows with equal or null doc_id are judged each on
    its own. An empty table gives no rows. Further columns are not read.
    """
    names = plan(docs) if order is None else order

    def make():
        hash_of = _docs.Cache(xxhash.xxh3_64_intdigest)
        cascade = [RULES[name] for name in names]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for text in _docs.utf8(batch.column(1)):
                d = Document(text, hash_of)
                kept = passes(d, cascade)
                failed = not kept and base_failed(d)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

        return each

    return _docs.map_batches(_docs.texts(docs), make, SCHEMA)


def keep(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of `docs` that `evaluate` keeps, with all their columns, whatever their names.

    Null, empty and short texts go; equal rows are judged alike, each on its own; an empty table gives no rows.
    """
    names = plan(docs) if order is None else order

    def make():
        hash_of = _docs.Cache(xxhash.xxh3_64_intdigest)
        cascade = [RULES[name] for name in names]
        return lambda texts: [passes(Document(text, hash_of), cascade) for text in texts]

    return _docs.keep_rows(docs, make)
