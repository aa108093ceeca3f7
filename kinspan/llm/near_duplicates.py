"""Near-duplicates by improved consistent weighted sampling.

A text's shingles of SHINGLE words weigh their frequency times their inverse document frequency, which goes from 1 (in
every document) to 2 (in few), so that what many copies share still counts beside an edit's rare shingles. Document
frequencies are counted over all documents in BUCKETS hashed counters, so that the table has one size whatever the
input. A counter up to a FREQUENTth of all that was counted stands for rare shingles, which weigh alike: what chance
lays together in a counter stays far below that, at any number of documents, so a pair's similarity doesn't depend on
that number. For each of SAMPLES hash functions consistent weighted sampling picks a shingle and a level such that two
texts pick the same with the probability of their weighted Jaccard similarity. ROWS samples make a band; texts that
share a band meet in a bucket. Pairs that may be similar are verified on the texts themselves, and verified pairs make
connected components.

That goes in rounds, a few bands each. In a bucket one text of each component so far stands for it; these are paired
with few of them, verified, and joined, so that a group of many copies takes as many pairs as it has texts. Last, all
buckets that still hold several components are looked at whole: every pair across components that may be similar is
verified, in large buckets where blocks of their texts meet. So no pair is left out for one that was not verified.

Texts with the same words are one before any of that. Samples, pairs and components stay in the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.llm import _docs

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Counters of document frequencies, and how many of them go together.
BUCKETS, COUNTERS = 1 << 20, 1 << 12
#: A shingle counts as frequent beyond this part of all counted, and beyond so many documents.
FREQUENT, FEW = 1 << 16, 8
#: Estimated similarity from which a pair is verified: LEAST less 3.4 deviations of the estimate.
MAYBE = 0.62
#: Bands by round; texts that others of their bucket are paired with.
ROUNDS, PIVOTS = (range(1), range(1, 5), range(5, BANDS)), 4
#: Texts of a bucket whose pairs are verified one by one; of larger ones texts, and about bytes, in a block.
SMALL, BLOCK, BLOCK_BYTES = 8, 2048, 8 << 20
#: Shingles that are sampled at once.
CHUNK = 2048
#: Parts of a node with very many links; signatures kept by a worker, of about 1 kB each.
SALTS, KEPT = 8, 20_000
#: Stands for a null doc_id, before all others.
NULL = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(5))
_FACTORS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_SHIFT, _ODD = np.uint64(31), np.uint64(0x9E3779B97F4A7C15)
_LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def _gamma_quantiles() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) distribution, by bisection of its distribution function."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return mid


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantiles()).astype(np.float32)
_UNIFORM = np.float32(1 / 65536)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _SHIFT) * _ODD
    return x ^ x >> _SHIFT


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return low.translate(_LETTERS).split()


class Shingler:
    """Distinct shingles of a text, as sorted hashes, and how often each is there."""

    def __init__(self):
        self.hash_of = _docs.Cache(xxhash.xxh3_64_intdigest)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hash_of.__getitem__, words), np.uint64, len(words))

    def all_shingles(self, hashes: np.ndarray) -> np.ndarray:
        """In order, repeated ones too. A text of fewer words is one shingle."""
        size = min(SHINGLE, len(hashes))
        n = len(hashes) - size + 1 if size else 0
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = _mix(out + hashes[k : n + k] * _FACTORS[k])
        return out

    def shingles(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.all_shingles(hashes), return_counts=True)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int32)  # the upper 20 bits


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """1 + ln(n / df) / ln(n / few): from 1, in all of n documents, to 2, in `few` or fewer."""
    few = max(FEW, df.sum() / FREQUENT)
    if few >= n:
        return np.full(len(df), 2, np.float32)
    return (1 + np.log(n / np.clip(df, few, n)) / np.log(n / few)).astype(np.float32)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """`inverse_frequency` of each hashed counter.

    Every task sends its counters in blocks, which are summed one after another where they meet; BUCKETS numbers reach
    the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, n = Shingler(), np.zeros(BUCKETS, np.uint32), 0
        for batch in batches:
            n += batch.num_rows
            found = []
            for text in _docs.utf8(batch.column(0)):
                found.append(np.unique(_bucket(shingler.shingles(shingler.hashes(words_of(text)))[0])))
            total += np.bincount(np.concatenate(found), minlength=BUCKETS).astype(np.uint32)
        blocks = np.flatnonzero(total.reshape(-1, COUNTERS).any(axis=1))
        parts = [total[b * COUNTERS : (b + 1) * COUNTERS].tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*blocks.tolist(), -1], pa.int32()), pa.array([*parts, int(n).to_bytes(8, "little")], pa.binary())],
            names=["block", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a few blocks, however many tasks sent theirs
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, "<u8" if block < 0 else "<u4").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"]
        )

    _docs.bound_batches(docs.sparkSession)
    kinds = "block int, counts binary"
    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, kinds)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sent.repartition(parts, "block").mapInArrow(add, kinds).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for block, counts in rows:
        part = np.frombuffer(counts, np.int64)
        if block < 0:
            n = int(part[0])
        else:
            df[block * COUNTERS : (block + 1) * COUNTERS] = part
    return inverse_frequency(df, n)


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One hash for each of SAMPLES consistent weighted samples of at least one shingle."""
    best, kept, rows = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.arange(SAMPLES)
    for start in range(0, len(shingles), CHUNK):
        s = shingles[start : start + CHUNK]
        log_w = np.log(weights[start : start + CHUNK])
        x = s ^ _SEEDS[:, None]
        x *= _ODD
        x ^= x >> _SHIFT
        x *= _ODD
        # Of each 64 bits three times 16: for r, for the logarithm of c, for beta.
        drawn = x.view(np.uint16).reshape(SAMPLES, len(s), 4)
        r = _GAMMA.take(drawn[:, :, 3], mode="clip")
        beta = drawn[:, :, 1] * _UNIFORM
        level = log_w / r
        level += beta
        np.floor(level, out=level)
        log_a = level - beta
        log_a += np.float32(1)
        log_a *= r
        np.subtract(_LOG_GAMMA.take(drawn[:, :, 2], mode="clip"), log_a, out=log_a)
        least = log_a.argmin(axis=1)
        value = log_a[rows, least]
        better = value < best
        hashed = _mix(s[least] + level[rows, least].astype(np.int64).astype(np.uint64) * _FACTORS[0])
        best, kept = np.where(better, value, best), np.where(better, hashed, kept)
    return kept


def bands_of(sampled: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTORS[1]
    rows = sampled.reshape(BANDS, ROWS)
    for k in range(ROWS):
        out = _mix(out + rows[:, k] * _FACTORS[2])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of sorted shingles with their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common)


def _signatures(keyed: DataFrame, idf: Broadcast) -> DataFrame:
    """A row for each document: row, doc, key, n_bytes, copy_a and copy_b (a 128-bit hash of its words), bands, brief.

    Documents without words have no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, row = Shingler(), _docs.partition_id() << 33
        table, texts = idf.value, {}

        def work(words: list[bytes]) -> tuple:
            h = shingler.hashes(words)
            shingles, times = shingler.shingles(h)
            sampled = samples(shingles, times.astype(np.float32) * table[_bucket(shingles)])
            return bands_of(sampled).view(np.int64).tolist(), (sampled & np.uint64(255)).astype(np.uint8).tobytes()

        for batch in batches:
            out, texts_here = [], _docs.utf8(batch.column(2))
            for text in texts_here:
                words = words_of(text)
                if not words:
                    out.append((row, row, -1, None, None))  # like no other
                else:
                    digest = xxhash.xxh3_128_digest(b" ".join(words))
                    if digest not in texts:
                        if len(texts) >= KEPT:
                            texts.clear()
                        texts[digest] = work(words)
                    a, b = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    out.append((row, a, b, *texts[digest]))
                row += 1
            rows, a, b, bands, brief = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    batch.column(0),
                    batch.column(1),
                    pa.array(map(len, texts_here), pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(brief, pa.binary()),
                ],
                names=["row", "doc", "key", "n_bytes", "copy_a", "copy_b", "bands", "brief"],
            )

    return keyed.mapInArrow(
        run, "row long, doc long, key binary, n_bytes long, copy_a long, copy_b long, bands array<long>, brief binary"
    )


# --- Candidates ------------------------------------------------------------------------------------------------------


def _alike(briefs: np.ndarray, brief: np.ndarray) -> np.ndarray:
    return np.count_nonzero(briefs == brief, axis=1)


def star_pairs(rows: np.ndarray, briefs: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, row) that may join the components met in one bucket, one text standing for each: linear in number.

    The text that has most of the commonest samples is paired with all that may be similar to it; of the others again,
    PIVOTS times at most. What that leaves apart `small_pairs` and `block_links` look at.
    """
    _, rest = np.unique(roots, return_index=True)
    found = []
    for _ in range(PIVOTS):
        if len(rest) < 2:
            break
        own = briefs[rest]
        if len(rest) == 2:
            pivot = 0
        else:
            common = np.array([np.bincount(column, minlength=256).argmax() for column in own.T], np.uint8)
            pivot = int(_alike(own, common).argmax())
        near = _alike(own, own[pivot]) >= MAYBE * SAMPLES
        near[pivot] = False
        found += [(int(rows[k]), int(rows[rest[pivot]])) for k in rest[near]]
        near[pivot] = True
        rest = rest[~near]
    return found


def small_pairs(rows: np.ndarray, briefs: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """All pairs of a small bucket that may be similar, across components."""
    found = []
    for k in range(1, len(rows)):
        near = (roots[:k] != roots[k]) & (_alike(briefs[:k], briefs[k]) >= MAYBE * SAMPLES)
        found += [(int(rows[k]), int(rows[j])) for j in np.flatnonzero(near)]
    return found


def block_links(rows: np.ndarray, briefs: np.ndarray, roots: np.ndarray, vectors: list[tuple], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, row) between texts of `left` and of `right` (places of rows), as many as join their components.

    Every pair across components that may be similar is verified, on the texts' shingles and weights in `vectors`.
    """
    sizes = np.array([len(s) for s, _ in vectors])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    distinct, where = np.unique(np.concatenate([s for s, _ in vectors]), return_inverse=True)
    weights = np.concatenate([w for _, w in vectors])
    total = np.add.reduceat(weights, starts, dtype=np.float64)
    own, roots, found = np.zeros(len(distinct), np.float32), roots.copy(), []
    for k in left:
        other = right[roots[right] != roots[k]]
        near = other[_alike(briefs[other], briefs[k]) >= MAYBE * SAMPLES]
        if not len(near):
            continue
        mine = slice(starts[k], starts[k] + sizes[k])
        own[where[mine]] = weights[mine]
        common = np.add.reduceat(np.minimum(own[where], weights), starts, dtype=np.float64)[near]
        own[where[mine]] = 0
        for j in near[common >= LEAST * (total[k] + total[near] - common)]:
            if roots[j] != roots[k]:
                found.append((int(rows[k]), int(rows[j])))
                roots[roots == roots[j]] = roots[k]
    return found


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first columns: the key, and the other columns as lists. Sorted input; one run is held."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for values in zip(*columns):
            if values[:keys] != key:
                if held is not None:
                    yield key, list(zip(*held))
                key, held = values[:keys], []
            held.append(values[keys:])
    if held is not None:
        yield key, list(zip(*held))


def _pairs(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["x", "y"])


def _briefs(values: tuple[bytes, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, SAMPLES)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, block, row, brief, root), sorted by band and block, to pairs."""
    found = []
    for _, (rows, briefs, roots) in _groups(batches, 2):
        if len(rows) > 1:
            found += star_pairs(np.array(rows, np.int64), _briefs(briefs), np.array(roots, np.int64))
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, row, brief, root) of small buckets, sorted by band, to pairs."""
    found = []
    for _, (rows, briefs, roots) in _groups(batches, 1):
        found += small_pairs(np.array(rows, np.int64), _briefs(briefs), np.array(roots, np.int64))
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _cross(idf: Broadcast):
    """(band, one, two, block, row, brief, root, text), sorted by the first three, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = _weigher(idf)
        for (_, one, two), (blocks, rows, briefs, roots, texts) in _groups(batches, 3):
            if len(set(roots)) > 1:
                block = np.array(blocks)
                sides = np.flatnonzero(block == one), np.flatnonzero(block == two)
                yield _pairs(block_links(np.array(rows, np.int64), _briefs(briefs), np.array(roots, np.int64), [vector(t) for t in texts], *sides))

    return run


def _buckets(singles: DataFrame) -> DataFrame:
    """nr, band, size, row, brief, n_bytes: texts of each band that two or more share.

    Sizes are summed before they move, so that the bands of single texts are dropped by a join that can be split.
    """
    banded = singles.select(F.posexplode("bands").alias("nr", "band"), "row")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = banded.join(sizes, "band")
    return shared.join(singles.select("row", "brief", "n_bytes"), "row").select("nr", "band", "size", "row", "brief", "n_bytes")


def _with_roots(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(roots.toDF("row", "_root"), "row", "left").withColumn("root", F.coalesce("_root", "row")).drop("_root")


def _blocks(n, n_bytes=0):
    """How many blocks so many texts are dealt out to."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil((F.lit(0) + n_bytes) / BLOCK_BYTES), F.lit(1)).cast("int")


def _block(blocks):
    """One of so many blocks for each row."""
    return F.pmod(F.xxhash64("row", "band"), blocks.cast("long")).cast("int")


def _star_round(buckets: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    dealt = _with_roots(buckets, roots).select("band", _block(_blocks(F.col("size"))).alias("block"), "row", "brief", "root")
    sorted_ = dealt.repartition(parts, "band", "block").sortWithinPartitions("band", "block", "row")
    return sorted_.mapInArrow(_star, "x long, y long")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that hold two components or more: with size, and whether they are of the largest (`is_main`), and
    into how many blocks those and the others go (`main_blocks`, `rest_blocks`)."""
    rooted = _with_roots(buckets, roots)
    counts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    mixed = counts.groupBy("band").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), F.max(F.struct("n", "root", "b")).alias("_main"), F.count("*").alias("_k")).where("_k > 1")
    main = F.col("_main")
    mixed = mixed.select(
        "band", main["root"].alias("_root"), _blocks(main["n"], main["b"]).alias("main_blocks"), _blocks(F.col("_n") - main["n"], F.col("_b") - main["b"]).alias("rest_blocks")
    )
    return rooted.join(mixed, "band").withColumn("is_main", F.col("root") == F.col("_root")).drop("_root")


def _small_round(mixed: DataFrame, parts: int) -> DataFrame:
    dealt = mixed.where(F.col("size") <= SMALL).select("band", "row", "brief", "root").repartition(parts, "band").sortWithinPartitions("band", "row")
    return dealt.mapInArrow(_few, "x long, y long")


def _large_round(mixed: DataFrame, texts: DataFrame, idf: Broadcast, parts: int) -> DataFrame:
    """Links in large buckets, verified where their texts meet.

    A bucket's largest component needs no pairs of its own, so its blocks meet those of the other texts only.
    """
    rest, main = F.col("rest_blocks"), F.col("main_blocks")
    own = F.when(F.col("is_main"), rest + _block(main)).otherwise(_block(rest))
    met = F.sequence(F.lit(0), F.when(F.col("is_main"), rest - 1).otherwise(rest + main - 1))
    spread = mixed.where(F.col("size") > SMALL).withColumn("block", own).withColumn("_met", F.explode(met)).join(texts, "row")
    dealt = spread.select("band", F.least("block", "_met").alias("one"), F.greatest("block", "_met").alias("two"), "block", "row", "brief", "root", "text")
    sorted_ = dealt.repartition(parts, "band", "one", "two").sortWithinPartitions("band", "one", "two", "row")
    return sorted_.mapInArrow(_cross(idf), "x long, y long")


# --- Verification and components -------------------------------------------------------------------------------------


def _weigher(idf: Broadcast):
    shingler, table = Shingler(), idf.value

    def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
        shingles, times = shingler.shingles(shingler.hashes(words_of((text or "").encode())))
        return shingles, times.astype(np.float32) * table[_bucket(shingles)]

    return vector


def _verify(idf: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = _weigher(idf)
        text, known = None, None
        for batch in batches:
            x, y, left, right = (batch.column(k).to_pylist() for k in range(4))
            similar = []
            for k in range(len(x)):
                if right[k] != text:  # sorted by the right text's row
                    text, known = right[k], vector(right[k])
                similar.append(similarity(vector(left[k]), known) >= LEAST)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(similar, pa.bool_())], names=["x", "y", "similar"]
            )

    return run


def _verified(pairs: DataFrame, failed: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """x, y and similar of each pair of rows (x, y) that isn't in `failed` (a, b), whichever way round it came."""
    ends = {"a": F.least("x", "y"), "b": F.greatest("x", "y")}
    once = pairs.withColumns(ends).dropDuplicates(["a", "b"]).join(failed, ["a", "b"], "left_anti").select("x", "y")
    left = once.join(texts.toDF("x", "left"), "x")
    both = left.join(texts.toDF("y", "right"), "y")
    return both.select("x", "y", "left", "right").mapInArrow(_verify(idf), "x long, y long, similar boolean")


def components(links: DataFrame, scratch: _docs.Scratch | None = None) -> DataFrame:
    """node and root (the least node of its component) of each node in `links` (x, y) that isn't its root.

    By alternating stars: links are replaced until each goes from a node to its root; each round's links are cut off
    from their lineage. Joins to a node with very many links are salted.
    """

    scratch = scratch or _docs.Scratch(links.sparkSession, "components")

    def least_of(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def meet(directed: DataFrame, least: DataFrame) -> DataFrame:
        salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return directed.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "_salt"])

    def stars(edges: DataFrame, both: bool) -> DataFrame:
        directed = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v")
        if both:
            directed = directed.unionByName(directed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(directed)
        joined = meet(directed, least)
        if both:
            return joined.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        rest = joined.where("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y"))
        return rest.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    edges = scratch(links.where("x <> y").select("x", "y"), "edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = scratch(stars(stars(edges, True), False), "edges")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))


def _joined(roots: DataFrame, links: DataFrame, scratch: _docs.Scratch) -> DataFrame:
    """node and root of every node that isn't its root, once `links` (x, y) are added.

    Only links between components move through `components`; nodes get their new root by one join.
    """
    far = links.select("x", "y")
    for end in ("x", "y"):
        far = far.join(roots.toDF(end, "_root"), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    new = components(far.where("x <> y").distinct(), scratch).toDF("root", "_new")
    moved = roots.join(new, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return scratch(moved.union(new), "roots")


def classify(docs: DataFrame) -> DataFrame:
    """The near-duplicate class of each row of `docs` (doc_id, text).

    Two documents are linked if their weighted Jaccard similarity is LEAST or more; a class is a connected component.
    Gives doc_id, class_id (the least doc_id of the class), n_class (its documents) and kept (true for one of them, of
    that doc_id); also doc and key, by which a row is found again (see `keys`).

    Texts that differ in case and punctuation alone are alike. A null or empty text, or one without words, is in a
    class of its own; a text of fewer than SHINGLE words is like those of the same words. A null doc_id comes before
    all others. Rows with equal doc_id are documents of their own. An empty table gives no rows. Further columns are
    not read. It runs jobs at once; three small tables that the result is read from stay in the session's shared folder.
    """
    spark = docs.sparkSession
    scratch = _docs.Scratch(spark, "near")
    _docs.bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keys(docs).select("doc", "key", F.col("text").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    signed = scratch(_signatures(keyed, idf), "signed")
    first = F.min(F.struct("doc", "key", "row")).alias("first")
    copies = scratch(signed.groupBy("copy_a", "copy_b").agg(F.min("row").alias("node"), F.count("*").alias("n"), first), "copies")
    singles = signed.where("bands is not null").join(copies.select(F.col("node").alias("row")), "row", "left_semi")
    buckets = scratch(_buckets(singles), "buckets")
    involved = signed.select("row", "doc", "key").join(buckets.select("row").distinct(), "row", "left_semi").select("row", "doc", "key")
    again = Window.partitionBy("doc", "key").orderBy(F.lit(1))  # wholly equal rows
    texts = keyed.join(involved, ["doc", "key"]).withColumn("_n", F.row_number().over(again)).where("_n = 1").select("row", "text")
    texts = scratch(texts, "texts")
    roots = spark.createDataFrame([], "node long, root long")
    failed = spark.createDataFrame([], "a long, b long")
    for bands in ROUNDS:
        pairs = _star_round(buckets.where(F.col("nr").isin(list(bands))), roots, parts)
        tried = scratch(_verified(pairs, failed, texts, idf), "tried")
        failed = failed.union(tried.where("not similar").select(F.least("x", "y"), F.greatest("x", "y")))
        roots = _joined(roots, tried.where("similar"), scratch)
    mixed = scratch(_mixed(buckets, roots), "mixed")
    tried = _verified(_small_round(mixed, parts), failed, texts, idf).where("similar").select("x", "y")
    links = scratch(tried.union(_large_round(mixed, texts, idf, parts)), "tried")
    roots = _joined(roots, links, scratch)
    scratch.drop("buckets", "texts", "tried", "mixed", "edges")
    scratch.drop("roots", but_last=True)
    classes = (
        copies.join(roots, "node", "left")
        .select(F.coalesce("root", "node").alias("root"), "n", "first")
        .groupBy("root")
        .agg(F.sum("n").alias("n_class"), F.min("first").alias("first"))
    )
    told = copies.select("copy_a", "copy_b", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(classes, "root")
    member = signed.select("row", "doc", "key", "copy_a", "copy_b").join(told.select("copy_a", "copy_b", "n_class", "first"), ["copy_a", "copy_b"])
    doc_id = lambda c: F.when(F.col(c) != NULL, F.col(c))
    return member.select(
        doc_id("doc").alias("doc_id"),
        doc_id("first.doc").alias("class_id"),
        "n_class",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "doc",
        "key",
    )


def keys(docs: DataFrame, prefix: str = "", *columns: str) -> DataFrame:
    """doc (doc_id, or the least long for null) and key (128 bits of the text) after the named columns, else doc_id, text."""
    return docs.select(
        *(columns or ("doc_id", "text")),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias(f"{prefix}doc"),
        # Plainly never null: else a join would filter one side below the exchange that both sides share.
        F.coalesce(_docs.row_key(), F.lit(b"")).alias(f"{prefix}key"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class of `classify`, with all its columns, whatever their names.

    Rows without words are classes of their own and all stay, repeated ones too. Of rows with equal doc_id and text one
    stays, at will where further columns differ. Null doc_ids, empty texts and an empty table are as in `classify`.
    """
    own = [_docs.free_name(docs, n) for n in ("doc", "key", "nr")]
    kept = classify(docs).where("kept").select(F.col("doc").alias(own[0]), F.col("key").alias(own[1])).distinct()
    marked = docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias(own[0]),
        F.coalesce(_docs.row_key(), F.lit(b"")).alias(own[1]),
    )
    one = marked.join(kept, own[:2], "left_semi")
    words = F.coalesce(F.col("text").cast("string").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*own[:2]).orderBy(F.lit(1)))
    return one.withColumn(own[2], nth).where((F.col(own[2]) == 1) | ~words).select(*docs.columns)
