"""Packing documents into token windows by minimum bin slack.

Each document's ids are cut into whole windows; what remains, shorter than a window, joins a pool. The pool is a
multiset of remaining lengths. To fill a window, the longest of them is set, then a subset-sum dynamic program
over the rest, held in one integer as a bitset, finds the fullest reachable sum, and its trail gives how many of
each length to take. Where slack is left, the next remainder is cut to close it. Each task packs what it reads
and emits a window as soon as it is full: nothing is shuffled, and a pool never holds more than POOL tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kinspan.llm import _docs, wordbpe

WINDOW = 4096
#: Tokens at which a task's pool is packed, and down to which it is.
POOL, POOL_LEFT = 4 << 20, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most `capacity` that the multiset reaches, and how many of each length make it.

    counts: how often each length (1 or more) is there. Lengths are tried from the longest; the program ends
    early once `capacity` itself is reached.
    """
    reach, most, trail = 1, (1 << capacity + 1) - 1, []
    for length in sorted(counts, reverse=True):
        before = reach
        for _ in range(min(counts[length], capacity // length)):
            grown = (reach | reach << length) & most
            if grown == reach:
                break
            reach = grown
        if reach != before:
            trail.append((length, before))
        if reach >> capacity:
            break
    rest = total = reach.bit_length() - 1
    used = {}
    for length, before in reversed(trail):
        taken = 0
        while not before >> rest & 1:
            rest -= length
            taken += 1
        if taken:
            used[length] = taken
    return total, used


def powers(tokens: int, window: int) -> list[int]:
    """`tokens` as sums of powers of two, from the largest: the last sequences, which need no padding."""
    return [1 << b for b in range(window.bit_length(), -1, -1) if tokens >> b & 1]


class Packer:
    """Takes documents' ids, gives rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, window: int, sequence: int):
        self.window, self.sequence = window, sequence
        self.pool: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.tokens = 0

    def put(self, doc_id, start: int, ids: bytes, total: int) -> None:
        length = len(ids) // 4
        self.pool.setdefault(length, []).append((doc_id, start, ids, total))
        self.counts[length] = self.counts.get(length, 0) + 1
        self.tokens += length

    def take(self, length: int) -> tuple:
        self.tokens -= length
        self.counts[length] -= 1
        piece = self.pool[length].pop()
        if not self.counts[length]:
            del self.counts[length], self.pool[length]
        return piece

    def sequence_of(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, ids, total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, step = len(ids) // 4, self.window * 4
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield from self.sequence_of([(doc_id, at // 4, ids[at : at + step], total)])
        if whole < len(ids):
            self.put(doc_id, whole // 4, ids[whole:], total)
        if self.tokens >= POOL:
            yield from self.fill(POOL_LEFT)

    def fill(self, left: int) -> Iterator[tuple]:
        """Fill windows until the pool holds at most `left` tokens, or less than a window."""
        while self.tokens >= self.window and self.tokens > left:
            pieces = [self.take(max(self.counts))]
            free = self.window - len(pieces[0][2]) // 4
            total, used = best_fill(self.counts, free)
            for length, taken in used.items():
                pieces += [self.take(length) for _ in range(taken)]
            if slack := free - total:
                doc_id, start, ids, of = self.take(min(length for length in self.counts if length > slack))
                pieces.append((doc_id, start, ids[: slack * 4], of))
                self.put(doc_id, start + slack, ids[slack * 4 :], of)
            yield from self.sequence_of(pieces)

    def finish(self) -> Iterator[tuple]:
        yield from self.fill(0)
        rest = [piece for pieces in self.pool.values() for piece in pieces]
        for size in powers(self.tokens, self.window):
            pieces = []
            while size:
                doc_id, start, ids, of = rest.pop()
                now = min(size, len(ids) // 4)
                pieces.append((doc_id, start, ids[: now * 4], of))
                if now * 4 < len(ids):
                    rest.append((doc_id, start + now, ids[now * 4 :], of))
                size -= now
            yield from self.sequence_of(pieces)
        self.pool, self.counts, self.tokens = {}, {}, 0


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pack `docs` (doc_id, text) into sequences of at most `window` tokens; one row for each piece.

    tokenizer: path of the tokenizers file, present on every executor. ids are unsigned 32-bit integers,
    little-endian; `start` is the piece's place in its document, `offset` its place in the sequence. Every
    sequence is full, but for a task's last ones, whose lengths are powers of two.

    Null text is empty, so the document is `end_id` alone. Rows with equal or null doc_id are documents of their
    own. An empty table gives no rows. Further columns are not read.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = wordbpe.ids_by_chunk(tokenizer)
        packer, rows, held = Packer(window, _docs.partition_id() << 32), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _docs.utf8(batch.column(1))):
                for row in packer.add(doc_id, b"".join(map(ids_of.__getitem__, text.split())) + end):
                    rows.append(row)
                    held += len(row[3])
                    if held > _docs.BATCH_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
        for row in packer.finish():
            rows.append(row)
        yield _rows(rows)

    _docs.bound_batches(docs.sparkSession)
    return _docs.texts(docs).mapInArrow(run, SCHEMA)
