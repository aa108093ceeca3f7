"""kinspan: lazy, multi-chromosome analytics over shared genomic segments, on Spark DataFrames."""
