"""Operators for preparing training corpora: each takes and returns DataFrames."""
