"""Probanza: data audit, decision and scoring jobs for tabular data on PySpark."""
