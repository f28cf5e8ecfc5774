"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from toolframe.session import scratch_path, written  # noqa: F401  the shared folder's tables

MAX_CHARS = 1 << 20  # code points that one numpy pass holds at once


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python tasks can import it wherever the driver runs."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not root.is_dir():  # a package that is itself in an archive was shipped by its user
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="toolframe-ship-")), "toolframe_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join(root.name, f.relative_to(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_chars: int = MAX_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_chars bytes of a string column, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
        at = (np.cumsum(sizes) // max_chars).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, kept per worker up to the longest input seen."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        m = max(n, 2 * len(_POWERS), 1 << 16)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, _BASE, np.uint64)]))
            _INVERSE = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, inverse, np.uint64)]))
    return _POWERS, _INVERSE


def word_hashes(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of bytes outside ``space``, and where each run starts.

    data: bytes; space: boolean, true where a byte separates words. The hash
    of a run depends on its bytes alone (polynomial over 2^64, then mixed).
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        value = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(value), starts


WHITE = np.zeros(256, bool)  # the contract's word separators: space, tab to carriage return
WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_words(text: str, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text in order; A-Z lower-cased if asked. Works through long texts in runs that end between words."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if lower:
        data = _LOWER[data]
    out, at = [], 0
    while at < len(data):
        end = min(at + MAX_CHARS, len(data))
        while end < len(data):  # go on to the next separator
            gaps = np.flatnonzero(WHITE[data[end: end + MAX_CHARS]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + MAX_CHARS, len(data))
        run = data[at:end]
        out.append(word_hashes(run, WHITE[run])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)
