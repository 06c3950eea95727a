"""Product quantizer: a codebook for each part of the vectors, and search by tables of sub-distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import kmeans
from vectide.operators.blocks import scan


class ProductQuantizer:
    """m parts of dim / m components, with `centroids` codewords each."""

    def __init__(self, spark: SparkSession, dim: int, m: int, centroids: int = 256):
        if m < 1 or dim < 1 or dim % m:
            raise ValueError("dim must be a multiple of m")
        self.spark, self.dim, self.m, self.k, self.sub = spark, dim, m, centroids, dim // m
        self.books: np.ndarray | None = None

    def train(self, rows: DataFrame, rounds: int = 15, seed: int = 1337) -> ProductQuantizer:
        """Lloyd's rounds in all parts at once, one pass over the rows for each round; with fewer rows than codewords, the rest of a
        book are zeros. No rows: nothing happens. Starts are distinct rows, and the i-th codeword without a row takes the row that
        fits i-th worst."""
        rows = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
        start = kmeans.first_rows(rows, self.k, seed)
        if not len(start):
            return self
        books = np.ascontiguousarray(start.reshape(len(start), self.m, self.sub).transpose(1, 0, 2))
        for _ in range(rounds):
            books = self._round(rows, books)
        self.books = np.zeros((self.m, self.k, self.sub))
        self.books[:, : books.shape[1]] = books
        return self

    def _round(self, rows: DataFrame, books: np.ndarray) -> np.ndarray:
        """New codewords: means of their rows' parts, summed where the rows lie."""
        tables, (m, k, sub) = _tables(self.spark, books), books.shape

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((m, k, sub)), np.zeros((m, k), dtype=np.int64)
            for pdf in parts:
                for at in range(0, len(pdf), 256):
                    x = np.stack(pdf["vec"].iloc[at : at + 256].to_list())
                    own = tables(x).argmin(axis=2)
                    for j in range(m):
                        np.add.at(total[j], own[:, j], x[:, j * sub : (j + 1) * sub])
                        n[j] += np.bincount(own[:, j], minlength=k)
            j, c = np.nonzero(n)
            if len(j):  # a task may have no rows, and Arrow takes no array column from an empty frame
                yield pd.DataFrame({"m": j.astype(np.int32), "c": c.astype(np.int32), "n": n[j, c], "s": list(total[j, c])})

        part = rows.select("vec").mapInPandas(sums, "m int, c int, n long, s array<double>")
        each = [F.sum(F.get("s", F.lit(d))).alias(f"s{d}") for d in range(sub)]
        new, seen = books.copy(), np.zeros((m, k), dtype=bool)
        for r in part.groupBy("m", "c").agg(F.sum("n").alias("n"), *each).collect():  # one row for each codeword
            new[r.m, r.c] = np.array([r[f"s{d}"] for d in range(sub)]) / r.n
            seen[r.m, r.c] = True
        for j in np.flatnonzero(~seen.all(axis=1)):
            own = rows.select("id", F.slice("vec", int(j) * sub + 1, sub).alias("vec"))
            empty = np.flatnonzero(~seen[j])
            far = kmeans.assign(own, books[j]).orderBy(F.desc("cdist"), "id").limit(len(empty)).select("vec").collect()
            for c, r in zip(empty, far):
                new[j, c] = r.vec
        return new

    def distance(self, queries: DataFrame, codes: DataFrame) -> DataFrame:
        """(query_id, id, distance): squared L2 of each query's vector to what the code of the same row stands for, without tables;
        queries has query_id, id and vec."""
        both = queries.join(self.decode(codes).withColumnRenamed("vec", "d"), "id")
        return both.select("query_id", "id", V.l2_squared(F.col("vec"), F.col("d")).alias("distance"))

    def _need(self) -> np.ndarray:
        if self.books is None:
            raise RuntimeError("the quantizer is not trained")
        return self.books

    def codebook(self) -> DataFrame:
        """(m, c, centroid)"""
        return self.spark.createDataFrame([(j, c, [float(v) for v in x]) for j, b in enumerate(self._need()) for c, x in enumerate(b)], "m int, c int, centroid array<double>")

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Squared distances (rows, m, k) between the parts of rows and the codewords."""
        parts = x.reshape(len(x), self.m, 1, self.sub)
        return ((parts - self._need()[None]) ** 2).sum(axis=3)

    def encode(self, rows: DataFrame) -> DataFrame:
        """(id, code): the nearest codeword of each part, the lowest number among equals."""
        self._need()
        tables = _tables(self.spark, self.books)

        @F.pandas_udf("array<smallint>")
        def code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in parts:
                out = []
                for at in range(0, len(v), 256):
                    out += list(tables(np.stack(v.iloc[at : at + 256].to_list()).astype(np.float64)).argmin(axis=2).astype(np.int16))
                yield pd.Series(out)

        return rows.select("id", code(F.col("vec").cast("array<double>")).alias("code"))

    def decode(self, codes: DataFrame) -> DataFrame:
        """(id, vec): the codewords side by side."""
        self._need()
        sent, m = self.spark.sparkContext.broadcast(self.books), self.m

        @F.pandas_udf("array<double>")
        def value(code: pd.Series) -> pd.Series:
            c = np.stack(code.to_list()).astype(np.int64) if len(code) else np.zeros((0, m), np.int64)
            return pd.Series(list(sent.value[np.arange(m), c].reshape(len(c), -1)))

        return codes.select("id", value("code").alias("vec"))

    def query_tables(self, queries: DataFrame) -> DataFrame:
        """(query_id, lut): m * k sub-distances of each query."""
        self._need()
        tables = _tables(self.spark, self.books)

        @F.pandas_udf("array<double>")
        def lut(v: pd.Series) -> pd.Series:
            return pd.Series(list(tables(np.stack(v.to_list()).astype(np.float64)).reshape(len(v), -1)) if len(v) else [])

        return queries.select("query_id", lut(F.col("vec").cast("array<double>")).alias("lut"))

    def search(self, codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, distance): least sums of sub-distances over all codes."""
        m, width = self.m, self.k

        def score(q, x):
            at = x["code"].astype(np.int64) + np.arange(m) * width
            out = np.zeros((len(q["lut"]), len(at)))
            for j in range(m):
                out += q["lut"][:, at[:, j]]
            return out

        return scan(codes, self.query_tables(queries), ["code"], ["lut"], score, k)


def _tables(spark: SparkSession, books: np.ndarray):
    sent = spark.sparkContext.broadcast(books)

    def run(x: np.ndarray) -> np.ndarray:
        b = sent.value
        return ((x.reshape(len(x), b.shape[0], 1, b.shape[2]) - b[None]) ** 2).sum(axis=3)

    return run
