"""Operator 7: chat formatting by columnar byte assembly.

Template: each turn is ``<|role|>``, its escaped role, ``<|text|>``, its escaped text,
``<|end|>``. Escaping is reversible: a backslash becomes two, and ``<|`` becomes ``<\\|``, so
no control string can occur inside a role or a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
FORMATTED = "conv_id bigint, formatted string, loss array<struct<start:bigint,length:bigint>>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: str) -> str:
    """The inverse of ``escape``: a backslash stands before the character that it guards."""
    if "\\" not in text:
        return text
    return "\\".join(part.replace("<\\|", "<|") for part in text.split("\\\\"))


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, trained: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal ``conv``: headers and contents are scattered into one buffer that has been sized before.

    trained: the turns under the loss mask; their spans count code points of the formatted text.
    """
    n = len(conv)
    parts = [pa.array([ROLE] * n, pa.large_string()), escape(role), pa.array([TEXT] * n, pa.large_string()), escape(text), pa.array([END] * n, pa.large_string())]
    raw = [words.text_buffer(p) for p in parts]
    lengths = np.stack([np.diff(offsets) for _, offsets in raw], axis=1)
    points = np.stack([pc.utf8_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], axis=1)
    begins = np.zeros(n * len(parts) + 1, np.int64)
    np.cumsum(lengths.ravel(), out=begins[1:])
    out = pa.allocate_buffer(int(begins[-1]))
    target = np.frombuffer(out, np.uint8)
    starts = begins[:-1].reshape(n, len(parts))
    for k, (data, offsets) in enumerate(raw):
        target[np.arange(len(data)) + np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])] = data
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if n else np.zeros(0, np.int64)
    cuts = np.r_[starts[first, 0], begins[-1]] if n else np.zeros(1, np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts.astype(np.int64)), out)
    before = np.cumsum(points.ravel()).reshape(n, len(parts)) - points
    group = np.cumsum(np.isin(np.arange(n), first)) - 1
    spans = np.flatnonzero(trained)
    loss = pa.StructArray.from_arrays([pa.array(before[spans, 3] - before[first, 0][group[spans]]), pa.array(points[spans, 3])], ["start", "length"])
    bounds = np.searchsorted(group[spans], np.arange(len(first) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(conv[first]), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(bounds), loss)], ["conv_id", "formatted", "loss"])


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One formatted text for each conv_id of ``turns`` (conv_id, turn, role, text), turns by ``turn``, with its loss spans.

    Equal turns stand in the order of role and text; repeated rows are turns of their own. Null
    texts and roles count as empty, a null turn stands first; rows without a conv_id belong to no conversation and are
    left out. Other columns are not read; an empty table gives no rows. Rows are sorted in
    Spark's spilling sort by conversation; a worker holds a slice of rows and the longest conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            role = pc.fill_null(rows.column("role"), "")
            trained = pc.equal(role, trained_role).to_numpy(zero_copy_only=False)
            return assemble(rows.column("conv_id").to_numpy(zero_copy_only=False), role, pc.fill_null(rows.column("text"), ""), trained)

        for batch in batches:
            for part in words.sliced(batch):
                conv = part.column("conv_id").to_numpy(zero_copy_only=False)
                changes = np.flatnonzero(conv[1:] != conv[:-1])
                last = int(changes[-1]) + 1 if len(changes) else 0
                if held and held[0].column("conv_id")[0].as_py() != conv[0]:
                    yield flush(pa.Table.from_batches(held))
                    held = []
                if last:
                    yield flush(pa.Table.from_batches([*held, part.slice(0, last)]))
                    held = []
                held.append(part.slice(last))
        if held:
            yield flush(pa.Table.from_batches(held))

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").where("conv_id is not null")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = formatted.split(END)[:-1]
    return [(unescape(role), unescape(text)) for role, text in (t.removeprefix(ROLE).split(TEXT) for t in turns)]


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = parse(text)
                seen = hashlib.sha256()
                for role, said in turns:
                    seen.update(f"{role}\n{said}\n".encode())
                masked = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                rows.append((conv, len(turns), seen.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
