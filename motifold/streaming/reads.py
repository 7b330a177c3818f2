"""The read filter on a stream: stateless, so each micro-batch is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..operators import reads


def filter_stream(stream: DataFrame, config: ScanConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seq: str = "seq", hold: bool = True) -> StreamingQuery:
    """Start a query that hands the passing reads of each micro-batch to ``sink``; what it wrote before stays written.

    The filter holds no state, so late or repeated input needs none.  Each batch's progress has, under ``reads``, how many
    reads it had and how many of them were without a sequence.  ``hold`` keeps a micro-batch, so that a sink may go through
    its reads more than once and they still count once; a sink that goes through them once needs no such copy."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist() if hold else batch
        sink(reads.passing(held, config, seq), number)
        if hold:
            held.unpersist()

    lacks = F.col(seq).isNull() | F.col(seq).isin("", "*")
    counted = stream.observe("reads", F.count(F.lit(1)).alias("total"), F.count_if(lacks).alias("missing"))
    writer = counted.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Islands of events on a time axis, as session windows; a gap as long as stated still joins in batch runs."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")
