"""A scan of sequences, as one lazy plan: contigs, matches, blocks, classes, summary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..config import ScanConfig
from ..operators import blocks as B
from ..operators import classify, summary, windows
from ..operators import contigs as C
from ..operators import matches as M


@dataclass
class Scan:
    """``sequences`` has ``seq_pos, header, seq``.  A tips-only scan looks at contigs' ends, a full one at windows, a whole one at all."""

    sequences: DataFrame
    config: ScanConfig

    @cached_property
    def parts(self) -> DataFrame:
        return C.components(self.sequences)

    @cached_property
    def contigs(self) -> DataFrame:
        return C.contigs(self.parts)

    @cached_property
    def gaps(self) -> DataFrame:
        return C.gaps(self.parts)

    @cached_property
    def matches(self) -> DataFrame:
        found = M.matches(self.contigs, self.config.expanded())
        if self.config.whole:
            return found
        if self.config.full:
            return M.in_windows(found, self.config.window, self.config.step)
        return M.in_tips(found, self.config.terminal_limit)

    @cached_property
    def terminal_blocks(self) -> DataFrame:
        return B.with_terminality(B.terminal_blocks(self.matches, self.config), self.config.terminal_limit)

    @cached_property
    def interstitial_blocks(self) -> DataFrame:
        return B.interstitial_blocks(self.matches, self.contigs, self.terminal_blocks, self.config)

    @cached_property
    def windows(self) -> DataFrame:
        return windows.metrics(windows.covered_windows(self.contigs, self.matches, self.config.window, self.config.step))

    @cached_property
    def path_summary(self) -> DataFrame:
        s = classify.path_summary(self.sequences, self.gaps, self.terminal_blocks)
        if not self.config.full:
            return s
        return classify.full_columns(s, self.interstitial_blocks, self.matches, windows.windows(self.contigs, self.config.window, self.config.step))

    @cached_property
    def assembly_summary(self) -> DataFrame:
        if not self.config.full:
            return summary.assembly_summary(self.path_summary, self.contigs, self.terminal_blocks)
        return summary.assembly_summary(self.path_summary, self.contigs, self.terminal_blocks, self.interstitial_blocks, self.matches, windows.windows(self.contigs, self.config.window, self.config.step))
