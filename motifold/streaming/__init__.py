"""Streams of reads and events."""
