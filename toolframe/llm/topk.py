"""Exact top-k search by inner product over a bit-sliced index.

Rows are dealt into blocks. Within a block every quantised component becomes
one bitmap per binary digit (bit j of component d over all rows of the block).
A query's score is a sum of shifted slices: its component is written in signed
binary digits, a positive digit adds the slices of that component, a negative
one adds their complements and a constant. Full adders over whole bitmaps
reduce all slices of one weight to one result slice and carries into the next
weight. The k best rows are then selected from the most significant result
slice downward; rows that still tie at the end have equal scores and are
resolved by id. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.llm.common import ship

BLOCK_ROWS = 16384  # rows of one index block
QUERY_ROWS = 4096  # queries answered together against one block


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


class Index:
    """Bit slices of one block. ids ascend; values: (rows, dimensions) of signed integers."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.low = values.min(axis=0)
        lifted = values - self.low
        self.bits = [int(x).bit_length() for x in lifted.max(axis=0)]
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int64)
        words = -(-len(ids) // 64)
        self.slices = np.zeros((2 * int(self.first[-1]), words), np.uint64)
        half = int(self.first[-1])
        for d, bits in enumerate(self.bits):
            for j in range(bits):
                self.slices[self.first[d] + j] = self._packed((lifted[:, d] >> j) & 1, words)
        self.slices[half:] = ~self.slices[:half]
        self.rows = self._packed(np.ones(len(ids), np.uint8), words)

    @staticmethod
    def _packed(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def _terms(self, query: list[int]) -> tuple[dict[int, list[int]], int]:
        """Slices to add by weight, and the constant: the score is the constant plus the sum of slice << weight."""
        terms: dict[int, list[int]] = {}
        half, constant = int(self.first[-1]), 0
        for d, q in enumerate(query):
            constant += q * int(self.low[d])
            size, triple = abs(q), 3 * abs(q)
            for digits, sign in (((triple & ~size) >> 1, 1), ((size & ~triple) >> 1, -1)):  # signed digits without neighbours
                sign = sign if q > 0 else -sign
                b = 0
                while digits:
                    if digits & 1:
                        at = int(self.first[d]) + (half if sign < 0 else 0)
                        for j in range(self.bits[d]):
                            terms.setdefault(b + j, []).append(at + j)
                        if sign < 0:
                            constant -= ((1 << self.bits[d]) - 1) << b
                    digits >>= 1
                    b += 1
        return terms, constant

    def _sum(self, terms: dict[int, list[int]]) -> list[np.ndarray]:
        """Result slices, least significant first."""
        out, carries, weight = [], [], 0
        last = max(terms, default=-1)
        while weight <= last or carries:
            own = [self.slices[terms[weight]]] if weight in terms else []
            rows = np.concatenate(own + carries) if own or carries else np.zeros((1, len(self.rows)), np.uint64)
            carries = []
            while len(rows) > 2:
                n = len(rows) // 3
                a, b, c = rows[:n], rows[n: 2 * n], rows[2 * n: 3 * n]
                half = a ^ b
                carry = half & c
                carry |= a & b
                carries.append(carry)
                half ^= c
                rows = np.concatenate([half, rows[3 * n:]]) if len(rows) > 3 * n else half
            if len(rows) == 2:
                carry = rows[0] & rows[1]
                if carry.any():
                    carries.append(carry[None])
                rows = (rows[0] ^ rows[1])[None]
            out.append(rows[0])
            weight += 1
        return out

    def top(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but those of the query's own id; ties to smaller ids."""
        terms, constant = self._terms(query)
        result = self._sum(terms)
        open_, taken = self.rows.copy(), np.zeros_like(self.rows)
        for r in range(int(np.searchsorted(self.ids, query_id)), int(np.searchsorted(self.ids, query_id, side="right"))):
            open_[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        n_taken = 0
        if int(np.bitwise_count(open_).sum()) > k:
            for s in reversed(result):
                high = open_ & s
                n = n_taken + int(np.bitwise_count(high).sum())
                if n > k:
                    open_ = high
                else:
                    taken |= high
                    n_taken = n
                    open_ &= ~s
                    if n == k:
                        open_[:] = 0
                        break
        bits = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        rows = [*bits(taken).tolist(), *bits(open_)[: k - n_taken].tolist()]  # what is open now ties at the boundary
        score = lambda r: constant + sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << w for w, s in enumerate(result))
        return [(int(self.ids[r]), score(r)) for r in rows]


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows.

    Returns query_id, rank (from 1), vec_id, score. Rows without an id, and
    vectors that are null, empty or hold null or non-finite components, take
    no part; a query is compared with vectors of its own length. Fewer than k
    candidates give all of them; ties go to smaller ids. Repeated rows of one
    id are separate candidates, but none of them answers that id's query, and
    a query id is asked once (its smallest vector). A component whose
    quantised value doesn't fit a long, or a score that doesn't, raises. Other
    columns are ignored; no rows give no rows.

    Each (row block, query block) pair is one task group of bounded size; rows
    travel once per query block, queries once per row block, and only k rows
    per query and row block come back.
    """
    ship(vectors.sparkSession)
    v = (vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
                .select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col), scale).alias("v"), is_query.alias("ask")))
    n, asked = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("ask"), 1))).first()
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))
    key = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    rows = v.select(dim, key(row_blocks).alias("rb"), every(query_blocks).alias("qb"), "id", "v")
    asks = v.where("ask").groupBy("id").agg(F.min("v").alias("v")).select(dim, every(row_blocks).alias("rb"), key(query_blocks).alias("qb"), "id", "v")

    def answer(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(queries):
            index = Index(mine["id"].to_numpy(np.int64), np.stack(mine["v"].to_numpy()).astype(np.int64))
            for q, vector in zip(queries["id"], queries["v"], strict=True):
                out += [(int(q), *hit) for hit in index.top(int(q), [int(x) for x in vector], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = rows.groupBy("dim", "rb", "qb").cogroup(asks.groupBy("dim", "rb", "qb")).applyInPandas(answer, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
