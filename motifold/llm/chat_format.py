"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\ncontent<|im_end|>\\n``.  In contents ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so no
content can hold a control string, and what was there can be had back; line feeds in roles become ``&#10;``.

Headers, contents and ends of all turns of an Arrow batch are segments: their lengths give cumulative offsets, offsets
give scatter indices, and numpy copies all of them into one preallocated buffer, which with the offsets of conversations
is the Arrow column that comes out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LONG, STRING, schema
from .shingles import text_bytes

# The template's control strings.
BEGIN, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"
FIELDS = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "&", "&amp;"), "<|", "&lt;|")


def unescaped(text: str) -> str:
    return text.replace("&#10;", "\n").replace("&lt;", "<").replace("&amp;", "&")


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Scatter pieces data[start : start + size] to out[to : to + size]."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + within] = data[np.repeat(start, size) + within]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list[list[dict]]]:
    """Formatted conversations, and the code-point spans of what is learned, of whole conversations that begin at first."""
    n = len(roles)
    roles, texts = roles.fill_null(""), texts.fill_null("")
    kinds = pc.dictionary_encode(roles)
    names = pc.replace_substring(escaped(kinds.dictionary), "\n", "&#10;")
    heads = pa.array([f"{BEGIN}{x}{AFTER_ROLE}" for x in names.to_pylist()], pa.string())
    kind = np.asarray(kinds.indices)
    body = escaped(texts)
    (head_data, head_at), (body_data, body_at) = text_bytes(heads), text_bytes(body)
    end = np.frombuffer(END.encode(), np.uint8)
    size = np.empty((n, 3), np.int64)
    size[:, 0], size[:, 1], size[:, 2] = np.diff(head_at)[kind], np.diff(body_at), len(end)
    at = np.zeros(3 * n + 1, np.int64)
    np.cumsum(size.ravel(), out=at[1:])
    out = np.empty(at[-1], np.uint8)
    _copy(out, at[:-1:3], head_data, head_at[kind], size[:, 0])
    _copy(out, at[1:-1:3], body_data, body_at[:-1], size[:, 1])
    _copy(out, at[2:-1:3], end, np.zeros(n, np.int64), size[:, 2])
    offsets = np.append(at[:-1:3][first], at[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))
    # the same in code points, for the spans
    chars = np.empty((n, 3), np.int64)
    chars[:, 0], chars[:, 1], chars[:, 2] = np.asarray(pc.utf8_length(heads))[kind], np.asarray(pc.utf8_length(body)), len(END)
    ends = np.cumsum(chars.sum(1))
    begun = np.repeat((ends - chars.sum(1))[first], np.diff(np.append(first, n)))
    stop = ends - len(END) - begun
    learned = np.asarray(pc.equal(roles, LEARNED))
    loss: list[list[dict]] = [[] for _ in first]
    which = np.searchsorted(first, np.arange(n), "right") - 1
    for i in np.flatnonzero(learned):
        loss[which[i]].append({"start": int(stop[i] - chars[i, 1]), "stop": int(stop[i])})
    return formatted, loss


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss`` of each conversation; ``loss`` has the code-point spans of assistant texts.

    Rows are taken by turn (nulls first), ties by role, then text; repeated rows are turns like others.  Null texts and
    roles are empty; rows without a conv_id are one conversation, whose id is null.  Columns other than ``conv_id, turn,
    role, text`` are ignored.  A partition is read in order and written as its conversations end, so what a task holds
    is a batch and its longest conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids, roles, texts = (rows.column(i).chunk(0) for i in range(3))
            key, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])))
            text, loss = assemble(roles, texts, first)
            turns = np.diff(np.append(first, len(key)))
            return pa.RecordBatch.from_pydict({"conv_id": ids.take(pa.array(first)), "n_turns": pa.array(turns), "formatted": text.cast(pa.string()), "loss": pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            last = ids[-1]
            key = np.asarray(pc.fill_null(pc.equal(ids, last), False) if last.is_valid else ids.is_null())
            cut = int(batch.num_rows - key[::-1].cumprod().sum())  # rows before the last conversation
            same = rest and rest[-1].column(0)[-1] == ids[0] or rest and not rest[-1].column(0)[-1].is_valid and not ids[0].is_valid
            if cut or rest and not same:
                whole = [*rest, batch.slice(0, cut)] if cut else rest
                yield out(pa.Table.from_batches([b for b in whole if b.num_rows]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield out(pa.Table.from_batches(rest))

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FIELDS)


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in text.split(BEGIN)[1:]:
        role, _, content = part.partition(AFTER_ROLE)
        turns.append((unescaped(role), content.removesuffix(END).replace("&lt;", "<").replace("&amp;", "&")))
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """What the output of ``formatted`` holds, read back from it: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                whole, learned, n = hashlib.sha256(), hashlib.sha256(), 0
                for role, content in turns:
                    whole.update(f"{role}\n{content}\n".encode())
                for span in loss:
                    part = text[span["start"] : span["stop"]].replace("&lt;", "<").replace("&amp;", "&")
                    learned.update(part.encode())
                    n += len(part)
                rows.append((len(turns), whole.hexdigest(), n, learned.hexdigest(), len(text)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted(conversations).select("conv_id", "formatted", "loss").mapInArrow(run, schema(conv_id=LONG, n_turns=LONG, turns_sha256=STRING, loss_chars=LONG, loss_sha256=STRING, formatted_chars=LONG))
