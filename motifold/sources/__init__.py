"""Readers and writers of sequence, graph, read, alignment and interval files."""
