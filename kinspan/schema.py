"""Schemas of the logical tables. Every table is keyed by chrom, so one plan handles all chromosomes."""

from __future__ import annotations

SEGMENTS = "chrom string, sid1 int, hid1 tinyint, sid2 int, hid2 tinyint, pid1 int, pid2 int"
#: Text form: no header, tab-separated; columns beyond the seventh are not used.
RAW_SEGMENTS = "sample1 string, hap1 int, sample2 string, hap2 int, chrom string, start_bp int, end_bp int, cm double"
SAMPLES = "sid int, name string"
SITES = "chrom string, pid int, bp int, cm float"
GENETIC_MAP = "chrom string, bp bigint, cm double"
MAP_TEXT = "chrom string, id string, cm double, bp bigint"
GENOTYPES = "chrom string, pid int, sid int, a0 tinyint, a1 tinyint"
REGIONS = "chrom string, pid_s int, label tinyint"
EXCLUSIONS = "kind string, left double, right double"
TOTALS = "row int, col int, cm10x bigint"

#: A segment's columns in their total order.
SEGMENT_ORDER = ("sid1", "sid2", "pid1", "pid2", "hid1", "hid2")
#: Allele code of a missing call.
MISSING = 2
