"""The ten subcommands as functions over DataFrames. Each is one lazy plan: no files or sorts lie between its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.operators import cut, encode, genetic_map, matrix, merge, windows
from kinspan.sources import readers, writers


def encode_all(raw: DataFrame, samples: DataFrame, positions: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites placed on the map, and segments in ids."""
    sites = genetic_map.sites(positions, points)
    return sites, encode.encode(raw, samples, sites)


def snpdens(sites: DataFrame, window: float = 2.0) -> DataFrame:
    return windows.density(sites, window)


def coverage(segments: DataFrame, sites: DataFrame, window: float = 1.0, sids: DataFrame | None = None) -> DataFrame:
    chosen = segments if sids is None else encode.both_in(segments, sids)
    return windows.coverage(encode.placed(chosen, sites), sites, window)


def labels(sites: DataFrame, window: float = 2.0, least: int = 10, ranges: DataFrame | None = None) -> DataFrame:
    regions = windows.density_regions(sites, window, least)
    return regions if ranges is None else windows.exclude(regions, ranges)


def view_by_name(segments: DataFrame, samples: DataFrame, sites: DataFrame, sample1: str, sample2: str) -> DataFrame:
    """`view` of a pair given by names."""
    shown = encode.decode(encode.pair_by_name(segments, samples, sample1, sample2), samples, sites)
    return shown.withColumns({"hap1": F.col("hap1") - 1, "hap2": F.col("hap2") - 1})


def _matrix_out(totals: DataFrame, d: int, prefix: str, low_cm: float, high_cm: float, sids: DataFrame | None, haplotypes: bool, width_cm: float, ids: tuple[int, ...] = ()) -> DataFrame:
    """Band, then subset of `totals` over d samples; written as a matrix file and, as text, its histogram."""
    found = matrix.band(totals, low_cm, high_cm)
    if sids is not None:
        found = matrix.subset(found, sids, haplotypes, d)
        ids = tuple(sorted(r.sid for r in sids.select("sid").collect()))
        d = len(ids)
    cells = d * (1 + haplotypes)
    writers.matrix_file(found, cells, writers.matrix_name(prefix, low_cm, high_cm), haplotypes, ids)
    writers.histogram_text(matrix.histogram(found, cells, width_cm), f"{prefix}_hist", cells)
    return found


def matrix_report(
    segments: DataFrame,
    d: int,
    prefix: str,
    least_cm: float = 2.0,
    most_cm: float | None = None,
    haplotypes: bool = False,
    low_cm: float = 0.0,
    high_cm: float = 6553.5,
    sids: DataFrame | None = None,
    width_cm: float = 1.0,
) -> DataFrame:
    """Totals of segments of d samples, written under `prefix` as a matrix file with its histogram as text; gives the totals."""
    return _matrix_out(matrix.totals(segments, least_cm, most_cm, haplotypes), d, prefix, low_cm, high_cm, sids, haplotypes, width_cm)


def matrix_files(spark: SparkSession, paths: list[str], prefix: str, low_cm: float = 0.0, high_cm: float = 6553.5, sids: DataFrame | None = None, width_cm: float = 1.0) -> DataFrame:
    """The sum of two or more matrix files of the same samples, written like `matrix_report`."""
    read = [readers.matrix_file(spark, p) for p in paths]
    heads = [head for _, head in read]
    if len(read) < 2 or len({(h["d"], h["haplotypes"], tuple(h["subset"])) for h in heads}) > 1:
        raise ValueError("two files at least, of the same samples")
    head = heads[0]
    if sids is not None and head["subset"]:
        raise ValueError("these matrices are subsets already")
    d = head["d"] // (1 + head["haplotypes"])
    return _matrix_out(matrix.add(*(totals for totals, _ in read)), d, prefix, low_cm, high_cm, sids, head["haplotypes"], width_cm, tuple(head["subset"]))


def label_report(sites: DataFrame, path: str, window: float = 2.0, least: int = 10, ranges: DataFrame | None = None) -> DataFrame:
    """Region labels alone, written as text: no segment is cut."""
    found = labels(sites, window, least, ranges)
    writers.label_text(found, sites, path)
    return found


def view_report(segments: DataFrame, samples: DataFrame, sites: DataFrame, path: str, sid1: int = 1, sid2: int = 0) -> DataFrame:
    """`view`, written as tab-separated text."""
    found = view(segments, samples, sites, sid1, sid2)
    writers.decoded(found, path, compressed=False)
    return found


def coverage_report(segments: DataFrame, sites: DataFrame, path: str, window: float = 1.0, sids: DataFrame | None = None) -> DataFrame:
    """Coverage, written as text; records processed count those that the sub-population leaves out as well."""
    found = coverage(segments, sites, window, sids)
    writers.coverage_text(found, path, window, segments.count())
    return found


def split(segments: DataFrame, sites: DataFrame, window: float = 2.0, least: int = 10, least_cm: float = 2.0, ranges: DataFrame | None = None) -> DataFrame:
    return cut.split(segments, labels(sites, window, least, ranges), sites, least_cm)


def sort(segments: DataFrame, by: str = "pair") -> DataFrame:
    return encode.ordered(segments, by)


def merge_segments(segments: DataFrame, sites: DataFrame, blocks: DataFrame | None, most_discordant: int = 1, most_cm: float = 0.6, on_missing: str = "error") -> DataFrame:
    return merge.merge_with_cm(segments, sites, blocks=blocks, most_discordant=most_discordant, most_cm=most_cm, on_missing=on_missing)


def split_merge(segments: DataFrame, sites: DataFrame, blocks: DataFrame | None, **options) -> DataFrame:
    """Segments cut to regions worth keeping, then merged."""
    kept = split(segments, sites, **options).where("label = 1")
    return merge_segments(kept, sites, blocks)


def matrix_of(
    segments: DataFrame | None = None,
    parts: list[DataFrame] | None = None,
    least_cm: float = 2.0,
    most_cm: float | None = None,
    haplotypes: bool = False,
    low_cm: float = 0.0,
    high_cm: float = 6553.5,
    sids: DataFrame | None = None,
) -> DataFrame:
    """Totals of segments, or the sum of two or more totals; then the band, then the subset."""
    if (segments is None) == (parts is None):
        raise ValueError("give segments or parts")
    if parts is not None and len(parts) < 2:
        raise ValueError("two parts at least")
    found = matrix.totals(segments, least_cm, most_cm, haplotypes) if segments is not None else matrix.add(*parts)
    found = matrix.band(found, low_cm, high_cm)
    return found if sids is None else matrix.subset(found, sids, haplotypes)


def decode(segments: DataFrame, samples: DataFrame, sites: DataFrame, sids: DataFrame | None = None) -> DataFrame:
    return encode.decode(segments, samples, sites, sids)


def view(segments: DataFrame, samples: DataFrame, sites: DataFrame, sid1: int = 1, sid2: int = 0) -> DataFrame:
    """One pair's segments with names and positions; haplotypes stay 0 and 1."""
    shown = encode.decode(encode.pair(segments, sid1, sid2), samples, sites)
    return shown.withColumns({"hap1": F.col("hap1") - 1, "hap2": F.col("hap2") - 1})


def stat(segments: DataFrame, sites: DataFrame) -> DataFrame:
    return windows.length_histogram(encode.placed(segments, sites))
