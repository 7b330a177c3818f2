"""Repeat-motif analytics over sequences, as Spark DataFrame plans."""
