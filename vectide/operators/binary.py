"""One bit for each component: signs packed into words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators.blocks import scan


class BinaryQuantizer:
    def __init__(self, dim: int):
        if dim < 1:
            raise ValueError("dim must be at least 1")
        self.dim, self.words = dim, (dim + 63) // 64
        self.bytes = 8 * self.words

    def encode(self, rows: DataFrame) -> DataFrame:
        """(id, words)"""
        return rows.select("id", V.sign_words(F.col("vec"), self.dim).alias("words"))

    def decode(self, codes: DataFrame) -> DataFrame:
        return codes.select("id", V.sign_values(F.col("words"), self.dim).alias("vec"))

    def search(self, codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, distance): greatest inner products of whole queries with the signs; the distance is the negated product."""
        dim = self.dim

        def score(q, x):
            bits = np.unpackbits(np.ascontiguousarray(x["words"]).view(np.uint8), axis=1, bitorder="little")[:, :dim]
            a = q["vec"].astype(np.float64)
            return a.sum(axis=1)[:, None] - 2 * (a @ bits.T.astype(np.float64))

        return scan(codes, queries, ["words"], ["vec"], score, k)

    def nearest_codes(self, codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, distance): least Hamming distances between codes, by bit counts; asked has query_id and words."""

        def score(q, x):
            out = np.zeros((len(q["words"]), len(x["words"])))
            for j in range(x["words"].shape[1]):
                out += np.bitwise_count(q["words"][:, j, None].view(np.uint64) ^ x["words"][:, j].view(np.uint64))
            return out

        return scan(codes, asked, ["words"], ["words"], score, k)
