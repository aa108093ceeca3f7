"""Removal of repeated word passages by de Bruijn compaction.

Words are tokens; each run of EDGE words is an edge of a de Bruijn graph over the whole table. The least hashed edge in
a window of WINDOW words anchors it, and windows in a row with the same anchor make one path: a stretch of the graph
held in one row in place of a row for each window. Paths meet at their anchors through Spark joins. An anchor that
occurs once can't be in a repeated window. Where all paths through an anchor are equal, the path doesn't branch: it
stays at its first source coordinates, and each later occurrence is repeated as a whole. Where paths branch, at the
ends of shared passages, only the first occurrence of each distinct path is opened into windows, which are compared by
themselves.

Repeated paths and windows carry the coordinates of an earlier occurrence, their source. In a document those that
follow one another, with sources that do the same, compact into one long span. The words at each distinct source span
are read and hashed to 128 bits at their coordinates, and a span is removed only if the words at its own coordinates
agree with that.

What a task sees several times it settles itself before anything moves, so that a passage that very many documents
share has a row for each task, not for each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.llm import _docs

WINDOW, EDGE = 20, 8
SPREAD = WINDOW - EDGE + 1  # edges in a window, so windows in a path at most
#: A place: bits of its document's tie-breaker, of its first word, of its number of windows. A row's key is that
#: tie-breaker and KEY_BITS more of a hash of its text, besides its doc_id.
TIE_BITS, WORD_BITS, RUN_BITS, KEY_BITS = 28, 31, 4, 60
#: Rows that a task settles at once.
CHUNK = 200_000
#: In place of a source: a path through an anchor that branches.
OPEN = -1
#: Stands for a null doc_id, before all others.
NULL = -(1 << 63)
ROW = ("doc", "key", "tie")
_PATHS = "anchor long, path long, doc long, key long, place long, sdoc long, skey long, splace long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_rng = np.random.Generator(np.random.PCG64(20))
_FACTORS = _rng.integers(0, 1 << 63, EDGE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_rng.integers(0, 1 << 62)) * 4 + 3)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHIFT, _ODD = np.uint64(31), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _SHIFT) * _ODD
    return x ^ x >> _SHIFT


class Words:
    """Words of some documents in a row, their hashes, and the windows that lie within one document."""

    def __init__(self, texts: list[bytes], hash_of: dict[bytes, int]):
        self.words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.starts[-1])
        self.hashes = np.fromiter(map(hash_of.__getitem__, chain.from_iterable(self.words)), np.uint64, n)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        count = max(0, n - WINDOW + 1)
        self.windows = np.flatnonzero(self.doc[:count] == self.doc[WINDOW - 1 :]) if count else np.empty(0, np.int64)
        power = np.full(n + 1, _BASE)
        power[0] = 1
        back = np.full(n + 1, _BACK)
        back[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * power[:n], dtype=np.uint64)])

    def content(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to stop."""
        return _mix((self.sums[stop] - self.sums[start]) * self.back[start])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window its anchor's hash and place: of its edges the one of least hash, of equal ones the first."""
        if not len(self.windows):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        n = len(self.hashes) - EDGE + 1
        edge = np.zeros(n, np.uint64)
        for k in range(EDGE):
            edge = _mix(edge + self.hashes[k : n + k] * _FACTORS[k])
        least = np.lib.stride_tricks.sliding_window_view(edge, SPREAD).argmin(axis=1)
        at = self.windows + least[self.windows]
        return edge[at], at

    def paths(self) -> tuple[np.ndarray, ...]:
        """anchor, path, document, first window (a word of the whole row), number of windows; of each path."""
        anchor, at = self.anchors()
        w = self.windows
        new = np.ones(len(w), bool)
        new[1:] = (at[1:] != at[:-1]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(w)))
        low = w[first]
        shape = ((at[first] - low) * 16 + run).astype(np.uint64)
        path = _mix(self.content(low, low + run + WINDOW - 1) + shape * _ODD)
        return anchor[first], path, self.doc[low], low, run


def _place(tie: np.ndarray, low: np.ndarray, run) -> np.ndarray:
    return tie << (WORD_BITS + RUN_BITS) | low << RUN_BITS | run


def _span(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of windows."""
    return place >> RUN_BITS & (1 << WORD_BITS) - 1, place & (1 << RUN_BITS) - 1


def _tie(place: np.ndarray) -> np.ndarray:
    return place >> (WORD_BITS + RUN_BITS)


class _Settler:
    """Takes rows (anchor, path, doc, key, place) and gives those of _PATHS.

    Of rows that have anchor and path in common the first in order stays as it is. The others are repeated, with the
    first as their source; they are sent to no anchor but to a key of their document. With `branch`, an anchor met
    here with more than two paths is known to branch: its least and its greatest path go to it as witnesses, the others
    each to a key of their own, with OPEN in place of a source. So an anchor gets a few rows of a task at most.
    """

    def __init__(self, branch: bool = False):
        self.parts, self.size, self.branch = [], 0, branch

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append([np.asarray(c).astype(np.int64) for c in columns])
        self.size += len(columns[0])
        if self.size >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        anchor, path, doc, key, place = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else [np.empty(0, np.int64)] * 5
        self.parts, self.size = [], 0
        order = np.lexsort((place, key, doc, path, anchor))
        anchor, path, doc, key, place = (c[order] for c in (anchor, path, doc, key, place))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (path[1:] != path[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.empty(0, np.int64)
        same = (doc == doc[first]) & (key == key[first]) & (place == place[first])  # wholly equal rows too
        keep = new | ~same
        again = ~new[keep]
        source = first[keep]
        row = _mix(doc[keep].view(np.uint64) * _ODD + key[keep].view(np.uint64)).view(np.int64)  # copies have the same key
        at, own = np.where(again, row, anchor[keep]), np.where(again, 0, path[keep])
        before = place[source]
        known = np.zeros(len(at), bool)
        if self.branch and len(order):
            firsts = anchor[new]  # sorted; each path of an anchor once
            inner = np.zeros(len(firsts), bool)
            inner[1:-1] = (firsts[1:-1] == firsts[:-2]) & (firsts[1:-1] == firsts[2:])
            known[~again] = inner
            at = np.where(known, _mix(at.view(np.uint64) * _ODD + own.view(np.uint64)).view(np.int64), at)
            before = np.where(known, OPEN, before)
        columns = [pa.array(c, pa.int64()) for c in (at, own, doc[keep], key[keep], place[keep])]
        columns += [pa.array(doc[source], pa.int64(), mask=~again), pa.array(key[source], pa.int64(), mask=~again), pa.array(before, pa.int64(), mask=~again & ~known)]
        whole = pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in _PATHS.split(", ")])
        yield from (whole.slice(start, 10_000) for start in range(0, max(1, whole.num_rows), 10_000))


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, tie, text) to the paths of each document."""
    hash_of, settler = _docs.Cache(xxhash.xxh3_64_intdigest), _Settler(branch=True)
    for batch in batches:
        doc_ids, keys, ties = (batch.column(k).to_numpy() for k in range(3))
        words = Words(_docs.utf8(batch.column(3)), hash_of)
        anchor, path, doc, low, run = words.paths()
        order = np.lexsort((low, path, anchor, doc))  # of equal paths in a document the first is enough
        a, p, d = anchor[order], path[order], doc[order]
        keep = np.ones(len(order), bool)
        keep[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        k = np.sort(order[keep])
        place = _place(ties[doc[k]], low[k] - words.starts[doc[k]], run[k])
        yield from settler.add(anchor[k].view(np.int64), path[k].view(np.int64), doc_ids[doc[k]], keys[doc[k]], place)
    yield from settler.flush()


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column, and the row of each."""
    sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    return lists.drop_null().flatten(), np.repeat(np.arange(len(lists)), sizes)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed paths (doc, key, tie, text, open), as paths of their own."""
    hash_of, settler = _docs.Cache(xxhash.xxh3_64_intdigest), _Settler()
    for batch in batches:
        doc_ids, keys, ties = (batch.column(k).to_numpy() for k in range(3))
        words = Words(_docs.utf8(batch.column(3)), hash_of)
        place, row = _flat(batch.column(4))
        low, run = _span(_longs(place))
        at = np.repeat(low + words.starts[row], run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        row = np.repeat(row, run)
        anchor, anchor_at = words.anchors()
        k = np.searchsorted(words.windows, at)
        content = _mix(words.content(at, at + WINDOW) + (anchor_at[k] - at).astype(np.uint64) * _ODD)
        place = _place(ties[row], at - words.starts[row], 1)
        yield from settler.add(anchor[k].view(np.int64), content.view(np.int64), doc_ids[row], keys[row], place)
    yield from settler.flush()


_SPANS = "doc long, key long, tie long, start long, n long, sdoc long, skey long, stie long, sstart long"


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, tie, again) to spans of words: repeats that follow one another, as their sources do, make one."""
    for batch in batches:
        found, row = _flat(batch.column(3))
        place, sdoc, skey, splace = (_longs(found.field(k)) for k in ("place", "sdoc", "skey", "splace"))
        low, run = _span(place)
        slow, stie = _span(splace)[0], _tie(splace)
        order = np.lexsort((low, low - slow, stie, skey, sdoc, row))
        low, run, slow, stie, sdoc, skey, row = (c[order] for c in (low, run, slow, stie, sdoc, skey, row))
        new = np.ones(len(low), bool)
        same = (row[1:] == row[:-1]) & (sdoc[1:] == sdoc[:-1]) & (skey[1:] == skey[:-1]) & (stie[1:] == stie[:-1])
        new[1:] = ~(same & (low[1:] - slow[1:] == low[:-1] - slow[:-1]) & (low[1:] <= low[:-1] + run[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new))[: len(first)] - 1
        n = low[last] + run[last] + WINDOW - 1 - low[first]
        own = [_longs(batch.column(k))[row[first]] for k in range(3)]
        columns = [*own, low[first], n, sdoc[first], skey[first], stie[first], slow[first]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[part.split()[0] for part in _SPANS.split(", ")])


def _digest(words: list[bytes]) -> tuple[int, int]:
    value = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def _source_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, tie, text, spans) to a digest of the words at each listed span."""
    names = ["sdoc", "skey", "stie", "sstart", "n", "one", "two"]
    for batch in batches:
        rows = []
        for doc, key, tie, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().split()
            rows += [(doc, key, tie, s["sstart"], s["n"], *_digest(words[s["sstart"] : s["sstart"] + s["n"]])) for s in spans]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def _cutter():
    """Takes row keys, texts and marks (start, n, one, two) of a batch; gives each text's words and which of them go."""
    hash_of = _docs.Cache(xxhash.xxh3_64_intdigest)
    before = None

    def each(rows: list[tuple], texts: list[bytes], marks: pa.Array) -> tuple[list, list[np.ndarray]]:
        nonlocal before
        words = Words(texts, hash_of)
        change = np.zeros(len(words.hashes) + 1, np.int32)
        spans, row = _flat(marks)
        for k, start, n, *digest in zip(row.tolist(), *(_longs(spans.field(k)).tolist() for k in ("start", "n", "one", "two"))):
            if _digest(words.words[k][start : start + n]) == tuple(digest):
                change[start + words.starts[k]] += 1
                change[start + n + words.starts[k]] -= 1
        w = words.windows
        content = words.content(w, w + WINDOW)
        order = np.lexsort((w, content, words.doc[w]))
        c, d = content[order], words.doc[w][order]
        later = w[order[1:][(c[1:] == c[:-1]) & (d[1:] == d[:-1])]]  # repeats within the document
        np.add.at(change, later, 1)
        np.add.at(change, later + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        masks = []
        for k, own in enumerate(words.words):
            mask = gone[words.starts[k] : words.starts[k + 1]]
            if (rows[k], texts[k]) == before and len(own) >= WINDOW:  # the same row again
                mask = np.ones(len(own), bool)
            before = rows[k], texts[k]
            masks.append(mask)
        return words.words, masks

    return each


def _left(words: list[bytes], mask: np.ndarray) -> bytes:
    return b" ".join([x for x, g in zip(words, mask.tolist()) if not g] if mask.any() else words)


def _without(text: bytes, mask: np.ndarray) -> bytes:
    """The text without the masked words and the white space after each stretch of them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
    kept, at = [], 0
    for first, stop in zip(edges[::2], edges[1::2]):
        kept.append(text[at : starts[first]])
        at = starts[stop]
    left = b"".join(kept) + text[at:]
    return left.rstrip(b" \t\n\v\f\r") if mask[-1] else left


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = _cutter()
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        words, masks = cut(rows, _docs.utf8(batch.column(3)), batch.column(4))
        spans = [np.flatnonzero(np.diff(m, prepend=False, append=False)).tolist() if len(m) else [] for m in masks]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if r[0] == NULL else r[0] for r in rows], pa.int64()),
                pa.array(map(len, words), pa.int64()),
                pa.array([int(np.count_nonzero(m)) for m in masks], pa.int64()),
                pa.array(spans, pa.list_(pa.int64())),
                pa.array(map(_left, words, masks), pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
        )


def _keyed(docs: DataFrame, names: tuple[str, ...] = ROW) -> DataFrame:
    """docs with doc (doc_id, or NULL), key and tie (KEY_BITS and TIE_BITS of a hash of the text)."""
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    bits = lambda start, n: F.conv(F.substring(digest, start, n // 4), 16, 10).cast("long")
    # Plainly never null: else a join would filter one side below the exchange that both sides share.
    return docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias(names[0]),
        F.coalesce(bits(1, KEY_BITS), F.lit(0)).alias(names[1]),
        F.coalesce(bits(17, TIE_BITS), F.lit(0)).alias(names[2]),
    )


def _never_null(df: DataFrame, n: int) -> DataFrame:
    """The first n columns, of longs, as columns that plainly hold no null, so that no join filters below an exchange."""
    return df.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in df.columns[:n]), *df.columns[n:])


def _marks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, key, tie and text, dealt out by row; and doc, key, tie and marks: spans that start earlier elsewhere, with the
    digest of their source."""
    spark = docs.sparkSession
    _docs.bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(_docs.texts(docs)).select(*ROW, F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("anchor", "path").orderBy("doc", "key", "place")
    at = F.struct("doc", "key", "place")

    def sourced(rows: DataFrame) -> DataFrame:
        """Rows with `nth` among those of their anchor and path, and where an earlier one is, if there is one."""
        # Ranks, not numbers: wholly equal rows have the same place, and are told apart at the end.
        ranked = rows.withColumns({"nth": F.dense_rank().over(in_order), "first": F.first(at).over(in_order)})
        known = F.struct(F.col("sdoc").alias("doc"), F.col("skey").alias("key"), F.col("splace").alias("place"))
        source = F.when(F.col("skey").isNotNull(), known).when(F.col("nth") > 1, F.col("first"))
        return ranked.withColumn("source", source).withColumn("tie", F.shiftright("place", WORD_BITS + RUN_BITS))

    again = F.when(F.col("source").isNotNull(), F.struct("place", F.col("source.doc").alias("sdoc"), F.col("source.key").alias("skey"), F.col("source.place").alias("splace")))
    paths = _never_null(keyed.mapInArrow(_path_rows, _PATHS), 5).repartition(parts, "anchor")
    own = lambda c: F.when(F.col("skey").isNull() & F.col("splace").isNull(), F.col(c))
    # Each column takes part, so that this and the join read the same exchange.
    anchors = (
        paths.groupBy("anchor")
        .agg(F.count(own("doc")).alias("_n"), F.min(own("path")).alias("_low"), F.max(own("path")).alias("_high"), F.max("key").alias("_k"), F.max("place").alias("_p"), F.count("sdoc").alias("_d"), F.count("splace").alias("_s"))
        .where("_n > 1 and _k is not null and _p is not null and _d >= 0 and _s >= 0")
        .select(F.col("anchor").alias("_anchor"), (F.col("_low") < F.col("_high")).alias("branches"))
    )
    met = sourced(paths.join(anchors, paths.anchor == anchors._anchor, "left").where("skey is not null or splace is not null or _anchor is not null"))
    met = met.where(f"source is not null or branches or splace = {OPEN}")
    by_doc = met.groupBy(*ROW).agg(F.collect_list(again).alias("again"), F.collect_list(F.when(F.col("source").isNull(), F.col("place"))).alias("open"))
    whole = keyed.repartition(parts, *ROW)
    # Both lists take part in both, so that they read the same exchange.
    opened = by_doc.where((F.size("open") > 0) & (F.size("again") >= 0)).select(*ROW, "open")
    windows = whole.join(opened, list(ROW)).select(*ROW, "text", "open").mapInArrow(_window_rows, _PATHS)
    windows = _never_null(windows, 5).repartition(parts, "anchor", "path")
    repeated = sourced(windows).where("source is not null").groupBy(*ROW).agg(F.collect_list(again).alias("again"))
    every = by_doc.where((F.size("again") > 0) & (F.size("open") >= 0)).select(*ROW, "again").unionByName(repeated)
    spans = every.groupBy(*ROW).agg(F.flatten(F.collect_list("again")).alias("again")).mapInArrow(_compacted, _SPANS)
    spans = _never_null(spans, 9).repartition(parts, *ROW)
    source = ["sdoc", "skey", "stie"]
    asked = spans.groupBy(*source, "sstart", "n").agg(*(F.max(c).alias(f"_{c}") for c in ("start", *ROW)))
    asked = asked.where("_start is not null and _doc is not null and _key is not null and _tie is not null").groupBy(*source).agg(F.collect_list(F.struct("sstart", "n")).alias("spans"))
    sources = whole.join(asked.toDF(*ROW, "spans"), list(ROW)).select(*ROW, "text", "spans")
    told = sources.mapInArrow(_source_rows, "sdoc long, skey long, stie long, sstart long, n long, one long, two long")
    marks = spans.join(told, [*source, "sstart", "n"]).groupBy(*ROW).agg(F.collect_list(F.struct("start", "n", "one", "two")).alias("marks"))
    return whole, marks


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove from each text of `docs` (doc_id, text) the words of windows that start earlier elsewhere.

    A window is WINDOW words in a row in one document; earlier is a smaller doc_id, or in the same document an earlier
    start. Gives doc_id, n_words, n_removed, removed (where removed stretches start and stop, by turns, in words) and
    kept_text (kept words joined by one space).

    Null and empty texts have no words. A null doc_id comes before all others. Rows with equal doc_id are documents of
    their own, in the order of a hash of their texts; of wholly equal rows all but one lose every window. An empty
    table gives no rows. Further columns are not read.
    """
    whole, marks = _marks(docs)
    return (
        whole.join(marks, list(ROW), "left")
        .select(*ROW, "text", "marks")
        .sortWithinPartitions(*ROW)  # brings wholly equal rows together, whatever the join
        .mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, removed array<long>, kept_text string")
    )


def cut(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns, whatever their names; repeated words leave each text with the white space after them.

    Which words those are, and what nulls, ties and repeated rows give, is as in `remove_repeats`. What stays keeps its
    line ends and spaces; texts without repeats stay as they are, null ones too. n_chars, where there is such a column,
    follows the text.
    """
    _, marks = _marks(docs)
    own = [_docs.free_name(docs, n) for n in (*ROW, "marks")]
    names = docs.columns
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, tuple(own[:3])).repartition(parts, *own[:3])
    joined = keyed.join(marks.toDF(*own), own[:3], "left").select(*names, *own).sortWithinPartitions(*own[:3])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _cutter()
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(names)
            rows, texts = list(zip(*(batch.column(n + k).to_pylist() for k in range(3)))), _docs.utf8(batch.column(at))
            _, masks = each(rows, texts, batch.column(n + 3))
            before = batch.column(at).to_pylist()
            after = [_without(t, m).decode("utf-8", "replace") if m.any() else b for t, m, b in zip(texts, masks, before)]
            columns = list(batch.columns[:n])
            columns[at] = pa.array(after, batch.column(at).type)
            if "n_chars" in names and pa.types.is_integer(batch.column(k := names.index("n_chars")).type):
                sizes = [len(a) if m.any() else c for a, m, c in zip(after, masks, batch.column(k).to_pylist())]
                columns[k] = pa.array(sizes, batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
