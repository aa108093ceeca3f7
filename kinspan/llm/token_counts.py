"""Token counts: each distinct pre-token is counted once, then joined to per-document frequencies.

Blocks of documents turn into postings: for each distinct pre-token of a block, which of its documents hold it and
how often. Postings are dealt out by pre-token; there each distinct one is counted once and joined to its postings,
and blocks get back the sums. No ids are kept anywhere. A frequent pre-token has one row for each block at most, and is
counted anew for every GROUP of tasks, so that no key gathers the rows of all blocks. A pre-token over LONGEST bytes,
which hardly any other document shares, is counted where it is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm import _docs, wordbpe

#: A block ends at so many documents, postings, or bytes of its distinct pre-tokens.
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_BYTES = 16_384, 2_000_000, 16 << 20
#: Tasks whose postings of a pre-token meet; bytes of a pre-token that is shared.
GROUP, LONGEST = 512, 256
#: Starts the key of the row that holds a block's documents; never part of UTF-8.
META = b"\xfd"
POSTING = np.dtype([("doc", "<u2"), ("times", "u1")])
PARTIAL = np.dtype([("doc", "<u2"), ("n", "<u8")])
HEAD = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n_bytes", "<i8"), ("n_long", "<i8")])


class _Block:
    def __init__(self, key: int):
        self.key, self.index, self.heads, self.parts, self.size, self.held, self.words = key, {}, [], [], 0, 0, 0

    def add(self, doc_id, n_bytes: int, keys: np.ndarray, n_long: int) -> None:
        """n_long: the document's tokens that no posting counts."""
        token, times = np.unique(keys, return_counts=True)
        self.parts.append((token, np.full(len(token), len(self.heads), "<u2"), times))
        self.heads.append((doc_id is not None, doc_id or 0, n_bytes, n_long))
        self.size += len(token)
        self.held += sum(map(len, islice(reversed(self.index), len(self.index) - self.words)))
        self.words = len(self.index)

    @property
    def full(self) -> bool:
        return len(self.heads) >= BLOCK_DOCS or self.size >= BLOCK_POSTINGS or self.held >= BLOCK_BYTES

    def rows(self) -> pa.RecordBatch:
        words = list(self.index)
        token, doc, times = (np.concatenate(x) for x in zip(*self.parts))
        if (often := times > 255).any():  # more than a byte holds: several postings
            copies = np.where(often, -(-times // 255), 1)
            last = np.cumsum(copies) - 1
            token, doc, kept = np.repeat(token, copies), np.repeat(doc, copies), times - 255 * (copies - 1)
            times = np.full(len(token), 255)
            times[last] = kept
        order = np.argsort(token, kind="stable")
        postings = np.empty(len(order), POSTING)
        postings["doc"], postings["times"] = doc[order], times[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(words)))])
        offsets = (ends * POSTING.itemsize).astype("<i4")
        payload = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(postings)])
        head = np.array(self.heads, HEAD).tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*words, META + self.key.to_bytes(8, "big")], pa.binary()),
                pa.array(np.full(len(words) + 1, self.key), pa.int64()),
                pa.concat_arrays([payload, pa.array([head], pa.binary())]),
            ],
            names=["pre_token", "block", "postings"],
        )


def _postings(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = wordbpe.load(tokenizer)
        split = _docs.Cache(model.pre_tokens)
        number = _docs.partition_id() << 24
        block = _Block(number)
        n_long = 0

        def shared(chunk: bytes) -> list[bytes]:
            """Of a long chunk the pre-tokens that are shared; the others are counted."""
            nonlocal n_long
            tokens = model.pre_tokens(chunk)
            n_long += sum(len(model.ids(t)) for t in tokens if len(t) > LONGEST)
            return [t for t in tokens if len(t) <= LONGEST]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _docs.utf8(batch.column(1))):
                index, n_long = block.index, 0
                keys = [
                    index.setdefault(token, len(index))
                    for chunk in text.split()
                    for token in (split[chunk] if len(chunk) <= LONGEST else shared(chunk))
                ]
                block.add(doc_id, len(text), np.array(keys, np.int64), n_long)
                if block.full:
                    yield block.rows()
                    number += 1
                    block = _Block(number)
        if block.heads:
            yield block.rows()

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, postings, n) to (block, kind, payload): a block's documents as they are, its postings as sums."""
    sums: dict[int, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys, payloads = [], []
        for key, total in sums.items():
            part = np.empty(np.count_nonzero(total), PARTIAL)
            part["doc"], part["n"] = np.flatnonzero(total), total[total > 0]
            keys.append(key)
            payloads.append(part.tobytes())
        sums.clear()
        return out(keys, False, payloads)

    def out(keys: list, head: bool, payloads: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([head] * len(keys), pa.bool_()), pa.array(payloads, pa.binary())],
            names=["block", "head", "payload"],
        )

    for batch in batches:
        tokens, blocks, n = batch.column(0), batch.column(1).to_numpy(), batch.column(3).to_numpy()
        lengths = np.diff(np.frombuffer(batch.column(2).buffers()[1], "<i4")[batch.column(2).offset :][: len(n) + 1]) // POSTING.itemsize
        payloads = batch.column(2).to_pylist()
        heads = np.array([t[:1] == META for t in tokens.to_pylist()])
        if heads.any():
            yield out(blocks[heads].tolist(), True, [payloads[i] for i in np.flatnonzero(heads)])
        rows = np.flatnonzero(~heads)
        rows = rows[np.argsort(blocks[rows], kind="stable")]
        if len(rows):
            posts = np.frombuffer(b"".join(payloads[i] for i in rows), POSTING)
            weight = posts["times"] * np.repeat(n[rows], lengths[rows])
            firsts = np.flatnonzero(np.diff(blocks[rows], prepend=blocks[rows[0]] - 1))
            ends = np.concatenate([np.cumsum(lengths[rows])])
            for a, b in zip(firsts, [*firsts[1:], len(rows)]):
                i, j = (ends[a - 1] if a else 0), ends[b - 1]
                key = int(blocks[rows[a]])
                add = np.bincount(posts["doc"][i:j], weight[i:j], BLOCK_DOCS).astype(np.uint64)
                sums[key] = sums[key] + add if key in sums else add
        if len(sums) > 64:
            yield flush()
    yield flush()


def _documents(table: pa.Table) -> pa.Table:
    """The documents of one block, with the sums of all its parts."""
    head, total = None, np.zeros(BLOCK_DOCS, np.int64)
    for is_head, payload in zip(table.column("head").to_pylist(), table.column("payload").to_pylist()):
        if is_head:
            head = np.frombuffer(payload, HEAD)
        else:
            part = np.frombuffer(payload, PARTIAL)
            total[part["doc"]] += part["n"].astype(np.int64)
    return pa.table(
        {
            "doc_id": pa.array(head["doc_id"], pa.int64(), mask=head["known"] == 0),
            "n_bytes": pa.array(head["n_bytes"], pa.int64()),
            "n_tokens": pa.array(total[: len(head)] + head["n_long"], pa.int64()),
        }
    )


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text) and n_tokens of each row of `docs` (doc_id, text).

    tokenizer: path of the tokenizers file, present on every executor. Null text is empty: 0 bytes, 0 tokens.
    Rows with equal or null doc_id are counted each on its own. An empty table gives no rows. Further columns
    are not read.
    """

    @F.pandas_udf("long")
    def pieces(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = wordbpe.load(tokenizer)
        for part in keys:
            yield pd.Series([0 if bytes(k[:1]) == META else len(model.ids(bytes(k))) for k in part], dtype="int64")

    spark = docs.sparkSession
    _docs.bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = (
        _docs.texts(docs)
        .mapInArrow(_postings(tokenizer), "pre_token binary, block long, postings binary")
        .withColumn("group", F.shiftright("block", 24 + GROUP.bit_length() - 1))
        .repartition(parts, "pre_token", "group")
    )
    # Each column itself takes part, so that this and the join read the same exchange.
    distinct = postings.groupBy("pre_token", "group").agg(F.count("block").alias("_b"), F.count("postings").alias("_p"))
    counts = distinct.where("_b > 0 and _p > 0").select("pre_token", "group", pieces("pre_token").alias("n"))
    return (
        postings.join(counts, ["pre_token", "group"])
        .select("pre_token", "block", "postings", "n")
        .mapInArrow(_sums, "block long, head boolean, payload binary")
        .groupBy("block")
        .applyInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")
    )
