"""Synthetic sequences by recipe, and expected rows, from FIXTURES.md."""

from __future__ import annotations

import re
from pathlib import Path

TEXT = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
# Fixed value: the filler that recipes repeat.
FILLER = "ACGATCGATCGACTGACTGACGATCGATCGACTGACTGACGATCGATCGACTGACTGACGATCGATCGACTGACTGACGATCGATCGACTGACTG"


def filler(n: int) -> str:
    return (FILLER * (n // len(FILLER) + 1))[:n]


def build(layout: str) -> str:
    out = []
    layout = re.sub(r"\((\w+)\)×(\d+)", lambda m: f" ={m[1]}*{m[2]} ", layout)
    layout = re.sub(r"\b([ACGT]{4,})×(\d+)", lambda m: f" ={m[1]}*{m[2]} ", layout)
    for token in layout.split():
        if token[0] == "=":
            unit, n = token[1:].split("*")
            out.append(unit * int(n))
        else:
            kind, n = token[0], int(token[1:])
            out.append({"p": "CCCTAA" * n, "q": "TTAGGG" * n, "F": filler(n), "X": filler(n), "N": "N" * n}[kind])
    return "".join(out)


def recipes() -> dict[str, list[tuple[str, str]]]:
    """Fixture name -> sequences."""
    found: dict[str, str] = {}
    table = TEXT[TEXT.index("| fixture | layout | line |") : TEXT.index("Comments in that script")]
    for line in table.splitlines()[2:]:
        cells = [c.strip() for c in line.strip("|").split("|")]
        if len(cells) == 3:
            name, layout = cells[0], cells[1]
            if name == "incomplete_p / incomplete_q":
                a, b = layout.split("/")
                found["incomplete_p"], found["incomplete_q"] = a, b
            elif " / " in name:
                base, second = name.split(" / ")
                a, b = layout.split("/")
                stem = base.rsplit("_", 1)[0] if second != "_long" or not base.endswith("start") else base
                found[base], found[(base if base.endswith("start") and second == "_long" else stem) + second] = a, b
            else:
                found[name] = layout
    decoded = re.search(r"Layouts decoded from the files.*?: (.*?)\.\n", TEXT, re.S)[1]
    for part in decoded.split("; "):
        name, layout = part.split(" = ")
        found[name.strip("`")] = layout
    found["multi"] = "p100 F2000 q100"
    out = {}
    for name, layout in found.items():
        if name.endswith(".gfa"):
            continue
        out[name] = [build(layout)] if name != "multi" else [build("p100 F2000 q100"), build("F2000"), build("F2400 q100")]
    return out


def goldens() -> list[dict]:
    """fixture, flags, rows, scaffold_n50, contig_n50, mean."""
    rows = []
    table = TEXT[TEXT.index("| fixture | flags | path rows") :]
    for line in table.splitlines()[2:]:
        cells = [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]
        if len(cells) != 6 or cells[0].endswith(".gz"):
            continue
        paths = [p.replace("\\*", "*").strip() for p in cells[2].split(";")]
        rows.append({"fixture": cells[0].removesuffix(".fa"), "flags": "" if cells[1] == "–" else cells[1], "rows": paths, "scaffold_n50": int(cells[3]), "contig_n50": int(cells[4]), "mean": None if cells[5] == "–" else float(cells[5])})
    return rows
