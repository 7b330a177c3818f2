"""Options of a scan, checked once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .functions.patterns import Pattern, expand, reverse_complement


class OptionError(ValueError):
    """An option that can't be used, alone or with others."""


@dataclass(frozen=True)
class ScanConfig:
    """Defaults are those of an assembly scan; ``for_reads`` gives those of reads."""

    canonical: str = "CCCTAA"
    patterns: tuple[str, ...] = ()
    edit_distance: int = 1
    window: int = 1000
    step: int = 1000
    terminal_limit: int = 50_000
    max_match_distance: int = 50
    min_block_length: int = 300
    max_block_distance: int = 500
    min_block_density: float = 0.5
    min_matches: int = 2
    repeats: bool = False
    gc: bool = False
    entropy: bool = False
    matches: bool = False
    its: bool = False
    manual_curation: bool = False
    includes: tuple[str, ...] = ()
    include_prefixes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    exclude_prefixes: tuple[str, ...] = ()
    full: bool = field(default=False)
    whole: bool = False  # all matches of contigs, also those far from their ends and across windows
    length_given: bool = False  # whether min_block_length is somebody's choice

    def __post_init__(self):
        if re.search(r"\d", self.canonical) or not self.canonical:
            raise OptionError("the canonical repeat must be letters")
        a = self.canonical.upper()
        b = reverse_complement(a)
        object.__setattr__(self, "canonical", min(a, b))
        object.__setattr__(self, "patterns", tuple(p.upper() for p in self.patterns))
        if any(not p or re.search(r"\d", p) for p in self.patterns):
            raise OptionError("patterns must be letters")
        for name in ("window", "step", "terminal_limit", "max_match_distance", "min_block_length", "max_block_distance"):
            if getattr(self, name) <= 0:
                raise OptionError(f"{name} must be above 0")
        if self.edit_distance not in (0, 1, 2):
            raise OptionError("edit_distance is 0, 1 or 2")
        if not 0 <= self.min_block_density <= 1:
            raise OptionError("min_block_density lies between 0 and 1")
        if self.step > self.window:
            raise OptionError("step must not exceed window")
        if self.repeats or self.gc or self.entropy or self.matches or self.its:
            object.__setattr__(self, "full", True)
        longest = max((p.length for p in self.expanded()), default=1)
        if self.full and (self.step < longest or 0 < self.window - self.step < longest):
            raise OptionError("step, and the overlap of windows if there is one, must reach the longest pattern")
        for p in (*self.include_prefixes, *self.exclude_prefixes):
            if not p.strip():
                raise OptionError("a prefix must not be empty")

    @property
    def reverse(self) -> str:
        return reverse_complement(self.canonical)

    def expanded(self) -> list[Pattern]:
        """All patterns to look for, in alphabetical order."""
        return expand(self.patterns or (self.canonical, self.reverse), self.canonical, self.edit_distance)

    def for_reads(self) -> ScanConfig:
        """Reads have no inner part: all of one is terminal, and blocks may be short."""
        shorter = 42 if not self.length_given and self.min_block_length == ScanConfig.min_block_length else self.min_block_length
        return replace(self, terminal_limit=(1 << 31) - 1, min_block_length=shorter, full=False, repeats=False, gc=False, entropy=False, matches=False, its=False)


def prefix_list(text: str) -> tuple[str, ...]:
    """Prefixes between commas, trimmed; an empty one, also after the last comma, is an error."""
    found = tuple(x.strip() for x in text.split(","))
    if not all(found):
        raise OptionError("empty prefix in list")
    return found
