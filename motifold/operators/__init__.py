"""Operators on sequences, matches, blocks, graphs and intervals; each takes and gives DataFrames."""
