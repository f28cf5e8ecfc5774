"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its
letters: the first letter's vector rotated twice, the second's once, the
third's as it is, multiplied componentwise. A document bundles (sums) its
trigram vectors by count; a language's prototype bundles its training
documents. A document gets the language whose prototype has the highest
cosine. Both passes are narrow: training sums prototypes by component with
map-side combining and brings one vector per language to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolframe.llm.common import mix64, ship, slices

DIMENSIONS = 512
CHUNK_CHARS = 1 << 17  # trigrams counted together
COMPACT = 128  # letters of a worker's table; texts with others are counted by sorting
GATHER = 1 << 12  # trigram vectors added up at once
TABLE_ROWS = 1 << 16  # trigram vectors a worker keeps; beyond, the table starts anew
_SPACE = np.uint64(32)
_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Is a code point a letter? Built once per worker."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """Rows of +1 and -1, a fixed function of the code point."""
    seed = mix64(points.astype(np.uint64) + np.uint64(0x51ED270B))
    words = mix64(seed[:, None] + np.arange(-(-dims // 64), dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")[:, :dims]
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str) -> np.ndarray:
    """Codes of all letter trigrams of a lower-cased text; other characters are one space, also at both ends. Empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other characters the first stays, as a space
    x = np.concatenate([[_SPACE], np.where(letter, points, 32)[keep].astype(np.uint64), [_SPACE]])
    if not letter[-1] and keep[-1]:
        x = x[:-1]  # the run at the end is the closing space already
    if len(x) > 1 and x[1] == _SPACE:
        x = x[1:]
    return x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:]


def trigram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    mask = np.uint64((1 << 21) - 1)
    parts = [codes >> np.uint64(42), codes >> np.uint64(21) & mask, codes & mask]
    points, where = np.unique(np.concatenate(parts), return_inverse=True)
    letters = letter_vectors(points, dims)
    a, b, c = np.split(where, 3)
    out = np.roll(letters, 2, axis=1)[a]
    out *= np.roll(letters, 1, axis=1)[b]
    out *= letters[c]
    return out


class Bundler:
    """Trigram vectors by row, kept per worker; adds up the rows that a text's trigrams point to."""

    def __init__(self, dims: int):
        self.dims = dims
        self.compact = np.zeros(0x110000, np.uint8)  # 0: not in the table
        self.letters = 0
        self._empty()

    def _empty(self) -> None:
        self.slot = np.full(COMPACT ** 3, -1, np.int32)
        self.rows, self.used = np.empty((4096, self.dims), np.int8), 0

    def _rows(self, codes: np.ndarray) -> np.ndarray | None:
        """Row of each trigram, or None where the compact table doesn't hold all letters."""
        mask = np.uint64((1 << 21) - 1)
        a, b, c = ((codes >> np.uint64(s) & mask).astype(np.int64) for s in (42, 21, 0))
        small = self.compact[c]
        if not (small.all() and self.compact[a[:1]].all() and self.compact[b[:1]].all()):
            for p in np.unique(np.concatenate([a, b, c])):
                if not self.compact[p]:
                    if self.letters == COMPACT - 1:
                        return None
                    self.letters += 1
                    self.compact[p] = self.letters
            small = self.compact[c]
        key = (self.compact[a].astype(np.int32) * COMPACT + self.compact[b]) * COMPACT + small
        found = self.slot[key]
        if (found < 0).any():
            fresh, first = np.unique(key[found < 0], return_index=True)
            if self.used + len(fresh) > TABLE_ROWS:
                self._empty()
                fresh, first = np.unique(key, return_index=True)
                own = codes[first]
            else:
                own = codes[found < 0][first]
            while self.used + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.slot[fresh] = np.arange(self.used, self.used + len(fresh))
            self.rows[self.used: self.used + len(fresh)] = trigram_vectors(own, self.dims)
            self.used += len(fresh)
            found = self.slot[key]
        return found

    def add(self, codes: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors."""
        out = np.zeros(self.dims)
        for at in range(0, len(codes), CHUNK_CHARS):
            part = codes[at: at + CHUNK_CHARS]
            rows = self._rows(part)
            if rows is None:
                ids, n = np.unique(part, return_counts=True)
            else:
                counts = np.bincount(rows, minlength=self.used)
                ids = np.flatnonzero(counts)
                n = counts[ids]
            for i in range(0, len(ids), GATHER):
                some = ids[i: i + GATHER]
                vectors = trigram_vectors(some, self.dims) if rows is None else self.rows[some]
                out += n[i: i + GATHER].astype(np.float32) @ vectors.astype(np.float32)
        return out


_BUNDLERS: dict[int, Bundler] = {}


def bundles(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector per text, has any letter)."""
    if dims not in _BUNDLERS:
        _BUNDLERS[dims] = Bundler(dims)
    bundler = _BUNDLERS[dims]
    out, some = np.zeros((len(texts), dims)), np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        codes = trigrams(t)
        if len(codes):
            out[i], some[i] = bundler.add(codes), True
    return out, some


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype per language from all rows with a text and a language.

    Rows without either teach nothing. The number of languages times dims
    values come to the driver; labels must be languages, not free text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, text):
            labels = np.asarray(b.column(1).to_pylist(), dtype=object)
            vectors, some = bundles(b.column(0).to_pylist(), dims)
            for x in sorted(set(labels[some])):
                own = vectors[some & (labels == x)].sum(axis=0)
                sums[x] = sums[x] + own if x in sums else own
        for x, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * dims, pa.string()), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], names=["lang", "d", "v"])

    ship(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    sums = rows.mapInArrow(run, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("x")).select("lang", F.transform("x", lambda y: y["v"]).alias("x")).collect()
    return {r["lang"]: np.asarray(r["x"]) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", prefix: str = "lang_") -> DataFrame:
    """docs with lang_pred and lang_score (the cosine, 0 to 1), which replace columns of those names.

    Null texts, texts without a letter and an empty training set give "und"
    and 0; ties go to the language whose name sorts first. Whole texts are
    read. Rows are independent; no rows give no rows.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names] or [[]])
    pred, score = f"{prefix}pred", f"{prefix}score"
    keep = [c for c in docs.columns if c not in (pred, score)]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            found, value = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if names:
                vectors, some = bundles([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()], matrix.shape[1])
                cosine = np.round(vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None], 9)
                best = cosine.argmax(axis=1)
                value = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                found = [names[k] if s else "und" for k, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(value)], names=[*b.schema.names, pred, score])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


CHANCE = 1e-4  # that noise reaches the bound for some language
GROWTH = 0.036  # cosine per root of a text's distinct trigrams that texts in a learned language reach at least, before noise
SPREADS = 3  # standard deviations of a cosine's noise by which such a text may fall below


def noise_bound(languages: int, dims: int = DIMENSIONS) -> float:
    """What the best of so many cosines of unrelated profiles reaches with a chance of CHANCE: each spreads by one over the root of the dimensions."""
    return math.sqrt(2 * math.log(max(languages, 1) / CHANCE) / dims)


def least_score(distinct: int, languages: int, dims: int = DIMENSIONS) -> float:
    """The least cosine at which a text with so many distinct trigrams is taken to be in a learned language.

    The cosine of a text in its own language grows with the root of its
    distinct trigrams, and spreads as noise does; a text below what its length
    lets expect goes, at most the noise bound is asked. A word or two can't be
    told from noise and stay.
    """
    return min(noise_bound(languages, dims), GROWTH * math.sqrt(distinct) - SPREADS / math.sqrt(dims))


def known(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs in a learned language (see ``least_score``), all columns as they are.

    Texts that are null or without a letter go; with no prototypes all rows go.
    Trigrams are counted over the whole text, and only where the cosine is
    below the noise bound, since longer texts aren't asked for more.
    """
    ship(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names] or [[]])

    def stays(x: str, some: bool, score: float) -> bool:
        if not some or not names:
            return False
        bound = noise_bound(len(names), matrix.shape[1])
        return score >= bound or score >= least_score(len(np.unique(trigrams(x))), len(names), matrix.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            vectors, some = bundles(texts, matrix.shape[1] or DIMENSIONS)
            best = (vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]).max(axis=1) if names else np.zeros(len(texts))
            yield b.filter(pa.array([stays(x, s, v) for x, s, v in zip(texts, some, best, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def evaluate(docs: DataFrame) -> DataFrame:
    """The contract's row per document: learned on the other folds, predicted for all."""
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
