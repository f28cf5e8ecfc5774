"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, length) over immutable
buffers: its text and the sentinels. A cut splits a descriptor, an arrangement
permutes descriptors, the inverse permutation over the output's own buffer
gives the text back, and hashes read the descriptors one after another. Bytes
are copied once, when an output column is made.

Everything is local to a row: no shuffle, no state between rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from toolframe.llm.common import ship, slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Which of prefix (0), middle (1) and suffix (2) stands behind which sentinel, in order of the output.
FORMS = {"psm": ((0, 0), (1, 2), (2, 1)), "spm": ((1, 2), (0, 0), (2, 1))}


class PieceTable:
    """Descriptors over buffers; at first one that spans the whole of buffer 0."""

    def __init__(self, *buffers: bytes):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = [(0, 0, len(buffers[0]))]

    def cut(self, piece: int, at: int) -> None:
        """Split a descriptor behind its first ``at`` bytes; either part may be empty."""
        buffer, start, length = self.pieces[piece]
        self.pieces[piece: piece + 1] = [(buffer, start, at), (buffer, start + at, length - at)]

    def arrange(self, order: list[int | tuple[int, int, int]]) -> None:
        """Take the descriptors in a new order; a descriptor itself is put in as it stands."""
        self.pieces = [self.pieces[x] if isinstance(x, int) else x for x in order]

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start: start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def text(self) -> str:
        return b"".join(self.stream()).decode()


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Three different texts, none within another, none that can overlap itself: else an output could be read in two ways."""
    for i, a in enumerate(sentinels):
        if not a or any(a[:k] == a[-k:] for k in range(1, len(a))) or any(a in b for j, b in enumerate(sentinels) if i != j):
            raise ValueError(f"not usable as a sentinel: {a!r}")


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i: i + 4], "big") for i in (0, 4, 8, 12)]


def unit_ends(data: bytes) -> np.ndarray:
    """Where the lines end, in bytes; a line takes its line feed along."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def _chars(data: memoryview) -> int:
    """Code points of well-formed UTF-8: all bytes but the continuation bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def arranged(data: bytes, doc_id: int | None, rate: int, spm_rate: int, seed: int, marks: tuple[bytes, ...]) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(lines, form, prefix_chars, middle_chars, piece table of the output) of one text."""
    ends, table = unit_ends(data), PieceTable(data, *marks)
    n, h = len(ends), draws(doc_id, seed)
    if not data or any(m in data for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, table
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    table.cut(0, a)
    table.cut(1, b - a)
    prefix, middle, _ = table.stream()
    sizes = _chars(prefix), _chars(middle)
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    table.arrange([x for mark, part in FORMS[form] for x in ((1 + mark, 0, len(marks[mark])), part)])
    return n, form, *sizes, table


def restored(output: bytes, form: str, marks: tuple[bytes, ...]) -> PieceTable:
    """The text's piece table over its output: cut at the sentinels, leave them out, permute back."""
    table = PieceTable(output)
    if form == "plain":
        return table
    for i, (mark, _) in enumerate(FORMS[form]):  # the last descriptor is what hasn't been cut yet
        start = table.pieces[-1][1]
        at = output.find(marks[mark], start)
        if at < 0:
            raise ValueError(f"no {marks[mark].decode()} in an output of form {form}")
        table.cut(2 * i, at - start)
        table.cut(2 * i + 1, len(marks[mark]))
    place = {part: 2 * (i + 1) for i, (_, part) in enumerate(FORMS[form])}
    table.arrange([place[part] for part in range(3)])
    return table


def _with_columns(df: DataFrame, made: list[tuple[str, T.DataType, pa.DataType]], values, text: str) -> DataFrame:
    """df with columns made from its Arrow batches (in runs of bounded size); columns of the same names are replaced."""
    ship(df.sparkSession)
    names = {name for name, _, _ in made}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            columns = zip(*values({c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}), strict=True)
            arrays = [pa.array(v, k) for v, (_, _, k) in zip(columns, made, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + arrays, names=kept + [m[0] for m in made])

    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text, ...) with n, form, prefix_chars, middle_chars, output and output_sha256.

    n: lines of the text. form: psm (prefix, suffix, middle), spm (suffix,
    prefix, middle) or plain. A text is plain, its output the text itself and
    both lengths null, where it is null (read as empty) or empty, holds a
    sentinel, or is drawn out by ``rate`` (per cent that are transformed).
    spm_rate: per cent of the transformed ones in the form spm. All draws hash
    (seed, doc_id), so rows that repeat an id are drawn alike and any
    partitioning gives the same result; a null id is drawn as an empty one.
    Lengths count code points. All rows and other columns stay; columns named
    like a result are replaced. No rows give no rows.
    """
    check_sentinels(sentinels)
    marks = tuple(s.encode() for s in sentinels)

    def values(columns):
        for doc, text in zip(columns["doc_id"].to_pylist(), columns["text"].to_pylist(), strict=True):
            n, form, prefix, middle, table = arranged((text or "").encode(), doc, rate, spm_rate, seed, marks)
            yield n, form, prefix, middle, table.text(), table.sha256()

    made = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()),
            ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string()), ("output_sha256", T.StringType(), pa.string())]
    return _with_columns(docs, made, values, "text")


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """outputs (form, output, ...) with the exact text back in ``restored`` and its digest in restored_sha256.

    Reads form and output alone. A null output or form is read as empty and
    plain. An output without the sentinels of its form raises.
    """
    check_sentinels(sentinels)
    marks = tuple(s.encode() for s in sentinels)

    def values(columns):
        for form, output in zip(columns["form"].to_pylist(), columns["output"].to_pylist(), strict=True):
            table = restored((output or "").encode(), form or "plain", marks)
            yield table.text(), table.sha256()

    return _with_columns(outputs, [("restored", T.StringType(), pa.string()), ("restored_sha256", T.StringType(), pa.string())], values, "output")


def digests(outputs: DataFrame) -> DataFrame:
    """The contract's row per document, the text rebuilt from form and output."""
    return restore(outputs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
