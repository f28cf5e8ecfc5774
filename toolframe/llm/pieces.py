"""SentencePiece (BPE) encoding by a table of prefixes, and decoding.

For every prefix of a piece of text the last token of its encoding is unique.
An automaton over the vocabulary gives all tokens that end at a position; the
one that belongs there is the one that is compatible with the last token of
the prefix before it (the pair, merged by the model's own rule, stays that
pair). Ids are recovered backwards from the table.

Text is cut before runs of the space symbol: no token of the vocabulary holds
that symbol after another one (checked when the model is loaded), so no merge
crosses such a cut, and encodings of words are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from toolframe.llm.common import ship, slices

SPACE = "▁"
CACHE_WORDS = 400_000  # words of each of the two generations a worker keeps
CACHE_CHARS = 64  # longer words are encoded each time


class PieceTable:
    """The model's merge rule, its automaton and the prefix tables."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(pieces)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in normal}
        self.score = {pieces[i]: sp.get_score(i) for i in normal}
        self.byte = {int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if sp.is_byte(i)}
        if len(self.byte) != 256 or sp.normalize("a  é ") != f"{SPACE}a{SPACE}{SPACE}é{SPACE}":
            raise ValueError("this encoder needs a BPE model with byte fallback and identity normalisation")
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.inner = {p[i: i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pieces, self.size = pieces, [len(p) for p in pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1 and self._merged(p) == [p]:  # a token that its own text doesn't merge into is never used
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.chars = {c for p in self.ids for c in p}
        if not all(c in self.ids for c in self.chars):
            raise ValueError("this encoder needs every character of a token to be a token")
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.chars)))}]+)")
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _merged(self, text: str) -> list[str]:
        """The model's merge rule on a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Does the pair, merged by the model's rule, stay that pair?"""
        a, b = self.pieces[left], self.pieces[right]
        known = a[-1] + b[0] not in self.inner or self._merged(a + b) == [a, b]
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        self.pairs[left << 20 | right] = known
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary: fill the table of last tokens by prefix, then walk it backwards.

        Exactly one token fits an end. Where none of the automaton's matches
        does, it is the character's own token, which needs no match and no test.
        """
        last, size, pairs, ids = [-1] * (len(text) + 1), self.size, self.pairs, self.ids
        for end, token in self.automaton.iter(text):  # by end, longest first
            if last[end + 1] < 0:
                before = end + 1 - size[token]
                if before:
                    left = last[before]
                    if left < 0:
                        left = last[before] = ids[text[before - 1]]
                    fits = pairs.get(left << 20 | token)
                    if fits is None:
                        fits = self._compatible(left, token)
                    if not fits:
                        continue
                last[end + 1] = token
        out, i = [], len(text)
        while i:
            token = last[i]
            if token < 0:
                token = ids[text[i - 1]]
            out.append(token)
            i -= size[token]
        return out[::-1]

    def _encode(self, word: str) -> tuple[bytes, str]:
        if 1 < len(word) <= CACHE_CHARS and word[-2:] not in self.inner:  # nothing merges across the last character's border
            a, b = self.word(word[:-1]), self.word(word[-1])
            return a[0] + b[0], f"{a[1]},{b[1]}"
        if self.chars.issuperset(word):
            ids = self._known(word)
        else:
            ids = []
            for part in self.unknown.split(word):  # characters outside the vocabulary become bytes; no token holds one
                if part and part[0] in self.chars:
                    ids += self._known(part)
                else:
                    ids += [self.byte[b] for b in part.encode("utf-8")]
        return array("i", ids).tobytes(), ",".join(map(str, ids))

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids as 32-bit integers in bytes, and as decimals joined by commas."""
        got = self.new.get(word) or self.old.get(word)
        if got is None:
            got = self._encode(word)
        if len(word) <= CACHE_CHARS and word not in self.new:
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def words(self, text: str) -> list[str]:
        whole = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return [whole]
        if SPACE + SPACE in whole or whole.endswith(SPACE):
            return re.findall(f"{SPACE}+[^{SPACE}]*", whole)
        return [SPACE + w for w in whole[1:].split(SPACE)]

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the ids as decimals joined by commas."""
        if not text:
            return [], ""
        words = self.words(text)
        found = list(map(self.new.get, words))
        if None in found:
            found = [f or self.word(w) for f, w in zip(found, words, strict=True)]
        ids = array("i", b"".join([f[0] for f in found]))
        return ids.tolist(), ",".join([f[1] for f in found])


_TABLES: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """One table per worker process and model."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs (all columns, whatever their names, but one named ids) with ``ids``: array of int, no begin or end ids.

    Null and empty texts have no ids; texts are encoded whole. Rows are
    independent, so repeated rows and empty tables need no care. The model
    file must lie at the same path on every executor.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(model)
        for b in slices(batches, text):
            ids = pa.array([pieces.encode(t or "")[0] for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (with ``ids``) and the column ``decoded``; null ids decode to the empty text."""
    from pyspark.sql import types as T

    ship(encoded.sparkSession)
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*encoded.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = table(model).sp
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = pa.array([sp.decode(x or []) for x in part.column(part.schema.get_field_index("ids")).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return encoded.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text: encoding, decoding and hashing in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in slices(batches, "text"):
            n, own, back = [], [], []
            for t in b.column(1).to_pylist():
                ids, said = pieces.encode(t or "")
                n.append(len(ids))
                own.append(sha(said))
                back.append(sha(pieces.sp.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
