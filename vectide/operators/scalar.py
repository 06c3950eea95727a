"""Scalar quantizers with one global range: 256 levels (one byte) and 16 levels (two codes in a byte); two-stage search on the latter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators.blocks import best, scan

#: Elements that the range is read from: those of the first rows by id.
CALIBRATION = 100_000


def range_of(rows: DataFrame, dim: int, low: float = 0.0005, high: float = 0.9995) -> DataFrame:
    """One row (lo, hi): two order statistics of the first CALIBRATION elements, rows in order of id.

    The ranks are floor((m - 1) * share) in single precision. Equal ends are put 1e-5 apart.
    """
    if not 0 <= low < high <= 1:
        raise ValueError("need 0 <= low < high <= 1")
    need = -(-CALIBRATION // dim)
    values = rows.orderBy("id").limit(need).select("id", F.posexplode("vec").alias("pos", "x"))
    values = values.where(F.col("x").isNotNull()).orderBy("id", "pos").limit(CALIBRATION)
    m = values.count()
    if not m:
        raise ValueError("no rows to calibrate on")
    rank = lambda share: int(np.floor(np.float32(m - 1) * np.float32(share)))
    ordered = F.sort_array(F.collect_list(F.col("x").cast("double")))
    ends = values.agg(F.get(ordered, F.lit(rank(low))).alias("lo"), F.get(ordered, F.lit(rank(high))).alias("hi"))
    return ends.select("lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-5).otherwise(F.col("hi")).alias("hi"))


@dataclass
class ScalarQuantizer:
    """levels: 255 or 15. Codes are arrays of small integers; with 15 levels they may be packed."""

    dim: int
    levels: int = 255
    lo: float | None = None
    hi: float | None = None

    def __post_init__(self):
        if self.dim < 1 or self.levels not in (15, 255):
            raise ValueError("dim must be at least 1 and levels 15 or 255")

    def train(self, rows: DataFrame, low: float = 0.0005, high: float = 0.9995) -> ScalarQuantizer:
        self.lo, self.hi = range_of(rows, self.dim, low, high).first()
        return self

    @property
    def step(self) -> float:
        self._need()
        return (self.hi - self.lo) / self.levels

    def _need(self) -> None:
        if self.lo is None:
            raise RuntimeError("the quantizer is not trained")

    def code(self, v: Column) -> Column:
        self._need()
        return V.scalar_code(v, F.lit(self.lo), F.lit(self.hi), self.levels)

    def value(self, code: Column) -> Column:
        self._need()
        return V.scalar_value(code, F.lit(self.lo), F.lit(self.hi), self.levels)

    def encode(self, rows: DataFrame) -> DataFrame:
        """(id, code): bytes as small integers; two codes in each with 15 levels."""
        code = self.code(F.col("vec"))
        return rows.select("id", (V.pack_nibbles(code, self.dim) if self.levels == 15 else code).cast("array<smallint>").alias("code"))

    def decode(self, codes: DataFrame) -> DataFrame:
        code = F.col("code").cast("array<int>")
        return codes.select("id", self.value(V.unpack_nibbles(code, self.dim) if self.levels == 15 else code).alias("vec"))

    def rows_of(self, codes: DataFrame, first: int, last: int) -> DataFrame:
        """(id, vec): decoded rows with ids first .. last - 1; the bounds reach the scan of the codes."""
        return self.decode(codes.where(F.col("id").between(first, last - 1)))

    def distance(self, q: Column, code: Column) -> Column:
        """Squared L2 between a vector and what a code stands for."""
        code = code.cast("array<int>")
        return V.l2_squared(q, self.value(V.unpack_nibbles(code, self.dim) if self.levels == 15 else code))


def mean_squared_error(rows: DataFrame, decoded: DataFrame) -> DataFrame:
    """One row (mse): mean of the squared differences of all components; 0 without any."""
    both = rows.select("id", "vec").join(decoded.select("id", F.col("vec").alias("d")), "id")
    return both.agg(F.coalesce(F.sum(V.l2_squared(F.col("vec"), F.col("d"))) / F.nullif(F.sum(F.size("vec")), F.lit(0)), F.lit(0.0)).alias("mse"))


def coarse_scan(codes: DataFrame, queries: DataFrame, sq: ScalarQuantizer, k: int) -> DataFrame:
    """(query_id, rank, id, distance): nearest packed codes to each whole query."""
    lo, step, dim = sq.lo, sq.step, sq.dim

    def score(q, x):
        b = x["code"].astype(np.int64)
        c = np.empty((len(b), 2 * b.shape[1]))
        c[:, 0::2], c[:, 1::2] = b & 15, b >> 4
        v, a = lo + c[:, :dim] * step, q["vec"].astype(np.float64)
        return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ v.T + (v * v).sum(axis=1), 0)

    return scan(codes, queries, ["code"], ["vec"], score, k)


def two_stage(rows: DataFrame, queries: DataFrame, sq: ScalarQuantizer, top_k: int, coarse: int = 100) -> DataFrame:
    """The `coarse` nearest packed codes of each query, then the top_k of these by exact squared L2."""
    if sq.levels != 15:
        raise ValueError("two-stage search needs 15 levels")
    near = coarse_scan(sq.encode(rows), queries, sq, max(top_k, coarse, 1)).select("query_id", "id")
    met = near.join(rows.select("id", "vec"), "id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    return best(met.select("query_id", "id", V.l2_squared(F.col("vec"), F.col("q")).alias("distance")), max(top_k, 0))
