"""FASTQ reads, by a Python data source: a partition for each file, rows in file order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fasta import FormatError
from .files import expand, open_stream

BATCH = 4096
SCHEMA = "idx long, header string, seq string, plus string, qual string"


def records(lines: Iterator[bytes], name: str = "") -> Iterator[tuple[str, str, str, str]]:
    """Groups of four lines; blank lines before a header are skipped.  Carriage returns stay with their lines."""
    number, any_line = 0, False
    for line in lines:
        if not line.strip(b"\r\n"):
            continue
        any_line = True
        number += 1
        if not line.startswith(b"@"):
            raise FormatError(f"{name} record {number}: header must begin with @")
        rest = [next(lines, None) for _ in range(3)]
        if None in rest:
            raise FormatError(f"{name} record {number}: truncated")
        seq, plus, qual = rest
        if not plus.startswith(b"+"):
            raise FormatError(f"{name} record {number}: third line must begin with +")
        if len(seq.rstrip(b"\r\n")) != len(qual.rstrip(b"\r\n")):
            raise FormatError(f"{name} record {number}: sequence and quality length differ")
        yield tuple(x.removesuffix(b"\n").decode("latin-1") for x in (line, seq, plus, qual))
    if not any_line:
        raise FormatError(f"{name}: empty input")


def lines(stream) -> Iterator[bytes]:
    """Lines of any length, with their line feeds."""
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + bytes(chunk)).split(b"\n")
        yield from (x + b"\n" for x in whole)
    if rest:
        yield rest


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class FastqReader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = expand(path)

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        names, rows, at = SCHEMA.replace(" long", "").replace(" string", "").split(", "), [], part.number << 40
        with open_stream(part.path) as stream:
            for r in records(lines(stream), part.path):
                rows.append((at, *r))
                at += 1
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``"""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options["path"])


def fastq(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").load(path)


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.col("idx").alias("seq_pos"), F.concat_ws("\n", "header", "seq", "plus", "qual").alias("line"))
