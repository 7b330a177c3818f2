"""Personal data, with offset-preserving deobfuscation.

Base detectors run on the text as it is.  Transducers then rewrite disguises (homoglyphs and invisible characters, digits
in words, at/dot in words or brackets) into plain characters, each of which remembers the source characters it stands
for; the detectors run again, and what they find by way of a rewritten character is mapped back to source spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LONG, STRING, schema
from .shingles import text_bytes

KINDS = ("email", "ip", "card", "phone")
# The base patterns, said so that no character is looked at from many starts: an address is looked for
# from its @ to both sides, the numbers of an ip begin where no digit stands before.
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Characters that look like others, in pairs.
_ALIKE = dict(zip("АВСЕНІЈКМОРЅТХУасеіјорѕхуԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABCEHIJKMOPSTXYaceijopsxydqwABEZHIKMNOPTYXoav", strict=True))
_ALIKE |= dict(zip("∙․。．﹒｡＠﹫＋﹢‐‑‒–−－﹣", "......@@++-------", strict=True))
_ALIKE |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
_ALIKE |= {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_UNSEEN = "­​‌‍⁠﻿"
# Names of digits in English, Spanish, French, German.
_DIGITS = {w: str(d) for words in ("zero one two three four five six seven eight nine", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun") for d, w in enumerate(words.split())} | {"oh": "0"}

_PLAIN = {ord(k): v for k, v in _ALIKE.items()} | {ord(k): None for k in _UNSEEN}
_CHARS = re.compile("[" + re.escape("".join(_ALIKE)) + _UNSEEN + "]")
_NAME = "(?:" + "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True)) + ")"
_NUMBER = re.compile(rf"(?i)\b(?:({_NAME})|[0-9]++)\b")
_GAP = re.compile(r"[\s,.-]+")
_PLUS = re.compile(rf"(?i)\bplus\s+(?=[0-9]|{_NAME}\b)")
_AT = r"(?:[\[({<]\s*(?:at|arroba|@)\s*[\])}>])"
_DOT = r"(?:[\[({<]\s*(?:dot|punto|point|punkt|\.)\s*[\])}>])"
_BRACKETS = re.compile(rf"(?i)(?<=[A-Za-z0-9])\s*(?:({_AT})|({_DOT}))\s*(?=[A-Za-z0-9])")
_SPOKEN = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9](?:\s+at\s+|\s*@\s*)[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)+")
_SPOKEN_IP = re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?:\s+dot\s+[0-9]{1,3}){3}(?![0-9.])")
_SAID_AT, _SAID_DOT = re.compile(r"(?i)\s+at\s+|\s*@\s*"), re.compile(r"(?i)\s+dot\s+")
_DIGIT = re.compile("[0-9]")
# parts that a rewritten disguise can't be without; texts that lack them needn't be looked at by the dearer patterns
_IN_BRACKETS, _SOME_AT, _SOME_DOT = re.compile(rf"(?i){_AT}|{_DOT}"), re.compile(r"(?i)@|\sat\s"), re.compile(r"(?i)\sdot\s")
_SEPARATORS = str.maketrans({**dict.fromkeys(",.-", " "), "ı": "i", "İ": "i"})
_STARTS_WITH_NAME = re.compile(rf"{_NAME}\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _ip(found: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in found.split("."))


def _phone(found: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in found) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0  # what lies before free is taken, or holds no part of an address
    while at >= 0:
        local, domain = _LOCAL_BACKWARDS.match(text[free:at][::-1]), _DOMAIN.match(text, at + 1)
        if local and domain:
            yield at - local.end(), domain.end()
        free = domain.end() if local and domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = []
    out += ((0, a, b) for a, b in _emails(text))
    if _DIGIT.search(text):
        out += ((1, *m.span()) for m in _IP.finditer(text) if _ip(m[0]))
        out += ((2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _card(m[0]))
        if "+" in text:
            out += ((3, *m.span()) for m in _PHONE.finditer(text) if _phone(m[0]))
    return out


class Tape:
    """A rewritten text; each character knows the source span that it stands for, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.start, self.end, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, apart) of the present text."""
        if not edits:
            return
        a, b, by = zip(*edits, strict=True)
        self._moved(np.array(a), np.array(b), np.array([len(x) for x in by]))
        cuts = zip((0, *b), (*a, len(self.text)), strict=True)
        self.text = "".join(x for (lo, hi), new in zip(cuts, (*by, ""), strict=True) for x in (self.text[lo:hi], new))

    def _moved(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
        """Where characters come from once spans [a, b) are texts of other sizes; what follows a removed one is new too."""
        n = len(self.start)
        shift = np.concatenate([[0], np.cumsum(size - (b - a))])
        kept = np.ones(n, bool)
        kept[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))] = False
        old = np.flatnonzero(kept)
        to = old + shift[np.searchsorted(a, old, "right")]
        put = np.repeat(a + shift[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        start, end, new = (np.empty(n + int(shift[-1]), x.dtype) for x in (self.start, self.end, self.new))
        start[to], end[to], new[to] = self.start[old], self.end[old], self.new[old]
        start[put], end[put], new[put] = np.repeat(self.start[a], size), np.repeat(self.end[b - 1], size), True
        gone = (b + shift[1:])[size == 0]
        new[gone[gone < len(new)]] = True
        self.start, self.end, self.new = start, end, new

    def plain(self) -> None:
        """Characters that look like others become these; unseen ones go."""
        at = np.array([m.start() for m in _CHARS.finditer(self.text)], np.int64)
        if len(at):
            self._moved(at, at + 1, np.array([self.text[i] not in _UNSEEN for i in at]).astype(np.int64))
            self.text = self.text.translate(_PLAIN)

    def apply(self, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        self.rewrite([e for m in pattern.finditer(self.text) for e in by(m)])


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit names and digits become digits without gaps: from a run's first name to its last two names in a row,
    if there are three names at least or digits between."""
    words = text.translate(_SEPARATORS).casefold().split()
    # of three names the last but one stands between separators
    if not any(w in _DIGITS and _STARTS_WITH_NAME.match(after) for w, after in zip(words, words[1:], strict=False)):
        return []
    out = []

    def end(run: list[re.Match]) -> None:
        first = next((i for i, m in enumerate(run) if m[1]), len(run))
        last = next((j for j in range(len(run) - 1, first + 1, -1) if run[j][1] and run[j - 1][1]), None)
        if last is not None:
            for i in range(first, last + 1):
                out.append((run[i].start() if i == first else run[i - 1].end(), run[i].end(), _DIGITS[run[i][1].translate(_SEPARATORS).casefold()] if run[i][1] else run[i][0]))

    run: list[re.Match] = []
    for m in _NUMBER.finditer(text):
        if run and not _GAP.fullmatch(text, run[-1].end(), m.start()):
            end(run)
            run = []
        run.append(m)
    end(run)
    return out


def _spoken(m: re.Match) -> list[tuple[int, int, str]]:
    """``name at host dot com``: the last label has two letters or more and no digits, and either an @ stands there or
    both at and a dot are spoken."""
    last = m[0].rsplit(None, 1)[-1].rsplit(".", 1)[-1].rsplit("@", 1)[-1]
    at = _SAID_AT.search(m[0])
    dots = [(m.start() + x.start(), m.start() + x.end(), ".") for x in _SAID_DOT.finditer(m[0], at.end())]
    if len(last) < 2 or not last.isalpha() or not dots and "@" not in at[0]:
        return []
    return [*([] if at[0] == "@" else [(m.start() + at.start(), m.start() + at.end(), "@")]), *dots]


def disguised_spans(text: str, base: list[tuple[int, int, int]], odd: bool = True) -> list[tuple[int, int, int]]:
    """Spans that only show once disguises are undone, in source offsets; none lies in a base span of its kind.

    ``odd``: whether the text may hold characters that look like others."""
    tape = Tape(text)
    if odd:
        tape.plain()
    tape.apply(_PLUS, lambda m: [(*m.span(), "+")])
    if _IN_BRACKETS.search(tape.text):
        tape.apply(_BRACKETS, lambda m: [(*m.span(), "@" if m[1] else ".")])
    if _SOME_AT.search(tape.text):
        tape.apply(_SPOKEN, _spoken)
    tape.rewrite(_spelled(tape.text))
    if _SOME_DOT.search(tape.text):
        tape.apply(_SPOKEN_IP, lambda m: [(m.start() + x.start(), m.start() + x.end(), ".") for x in _SAID_DOT.finditer(m[0])])
    if not tape.new.any():  # no span is kept without a rewritten character
        return []
    found = base_spans(tape.text)
    runs = ((3, *m.span()) for m in re.finditer(r"(?<![0-9+])[0-9]{7,15}(?![0-9])", tape.text) if tape.new[m.start() : m.end()].all() and text[tape.start[m.start()]].isalpha())
    out, inside = [], {}  # by kind, which borders lie inside of spans that are there
    there = set(base)
    for kind, a, b in base:
        inside.setdefault(kind, np.zeros(len(text) + 1, bool))[a + 1 : b] = True
    for kind, a, b in [*found, *runs]:
        if not tape.new[a:b].any():
            continue
        s, e = int(tape.start[a]), int(tape.end[b - 1])
        borders = inside.setdefault(kind, np.zeros(len(text) + 1, bool))
        # it may hold others, but not cut them, lie in one or be one
        if not borders[s] and not borders[e] and (kind, s, e) not in there:
            borders[s + 1 : e] = True
            there.add((kind, s, e))
            out.append((kind, s, e))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised`` of each row.

    The counts and the digest are of base spans; ``spans`` has all, by kind, then start.  Offsets count code points and
    ends are exclusive.  Null text is empty: no spans.  Null ids stay null, repeated rows each give a row, and columns
    other than ``doc_id`` and ``text`` are ignored."""
    fields = schema(doc_id=LONG, **{f"n_{k}": LONG for k in KINDS}, base_sha256=STRING, spans=STRING, n_disguised=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data, off = text_bytes(batch.column(1))
            # letters like a-z are neither ASCII nor Latin-1, whose letters begin with C3 in UTF-8
            odd = np.concatenate([[0], np.cumsum((data >= 0xC4) | (data == 0xC2))])[off]
            for i, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                base = base_spans(text)
                more = disguised_spans(text, base, odd[i + 1] > odd[i])
                rows.append((*(sum(s[0] == k for s in base) for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields.names[1:]]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=fields.names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)
