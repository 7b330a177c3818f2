"""The pattern dictionary: small, so worked out on the driver and sent to all tasks."""

from __future__ import annotations

import itertools
from typing import NamedTuple

# Letters of IUPAC and the bases that they stand for; complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}
_COMPLEMENT = str.maketrans("ACGTRYMKBVDHSWN", "TGCAYRKMVBHDSWN")


class Pattern(NamedTuple):
    pattern: str
    is_forward: bool
    is_canonical: bool
    length: int


def reverse_complement(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def readings(seed: str) -> list[str]:
    """What an IUPAC string can stand for; nothing if it has another letter."""
    return ["".join(x) for x in itertools.product(*(IUPAC.get(c, "") for c in seed))]


def neighbours(s: str, most: int) -> set[str]:
    """Strings that differ from s in up to ``most`` letters, itself left out."""
    out = set()
    for k in range(1, most + 1):
        for places in itertools.combinations(range(len(s)), k):
            for letters in itertools.product("ACGT", repeat=k):
                t = list(s)
                for i, c in zip(places, letters, strict=True):
                    t[i] = c
                out.add("".join(t))
    return out - {s}


def distance(a: str, b: str) -> int:
    """Letters that differ where the shorter string fits the longer one best."""
    a, b = sorted((a, b), key=len)
    return min(sum(x != y for x, y in zip(a, b[i : i + len(a)], strict=True)) for i in range(len(b) - len(a) + 1))


def is_forward(reading: str, canonical: str) -> bool:
    """Nearer to the canonical repeat than to its reverse complement, or as near."""
    return distance(reading, canonical) <= distance(reading, reverse_complement(canonical))


def expand(seeds, canonical: str, edit_distance: int) -> list[Pattern]:
    """Readings of the seeds with up to ``edit_distance`` substitutions, and the reverse complements of all of these.

    A string that two seeds reach on different strands counts as forward if one of them says so."""
    found: dict[str, bool] = {}
    for reading in (r for seed in seeds for r in readings(seed)):
        forward = is_forward(reading, canonical)
        for variant in (reading, *(neighbours(reading, edit_distance) if edit_distance else ())):
            for s, f in ((variant, forward), (reverse_complement(variant), not forward)):
                found[s] = found.get(s, False) or f
    both = {canonical, reverse_complement(canonical)}
    return [Pattern(s, found[s], s in both, len(s)) for s in sorted(found)]
