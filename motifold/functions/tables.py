"""Table functions for SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..config import ScanConfig
from ..operators.matches import Kernel


def register(spark: SparkSession, config: ScanConfig | None = None, name: str = "scan_motifs") -> None:
    """Make ``SELECT ... FROM t, LATERAL scan_motifs(seq)`` give ``pos, len, is_forward, is_canonical, motif`` of each match.

    A null or empty text has no matches; small letters count as capitals.  Whole contigs belong to ``matches``, which cuts
    them; this function takes each text as one."""
    patterns = (config or ScanConfig()).expanded()

    class ScanMotifs:
        def __init__(self):
            self.kernel = Kernel(patterns)

        def eval(self, seq):
            data = np.frombuffer((seq or "").upper().encode("ascii", "replace"), np.uint8)
            _, place, pattern = self.kernel.find(data, np.array([0, len(data)]))
            for at, i in zip(place.tolist(), pattern.tolist(), strict=True):
                p = self.kernel.patterns[i]
                yield at, p.length, p.is_forward, p.is_canonical, p.pattern

    spark.udtf.register(name, udtf(ScanMotifs, returnType="pos: long, len: int, is_forward: boolean, is_canonical: boolean, motif: string"))
