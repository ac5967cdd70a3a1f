"""framespan: a PySpark engine for segmenting time-indexed signals."""
