"""Four-bit codes in blocks of 32 vectors, scanned by byte tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.operators.blocks import HITS, QUERIES, Best, best, scan, sent

BLOCK, CODES = 32, 16
#: Stored blocks that are scanned together.
BLOCKS = 256


class FastScan:
    """m parts with 16 codewords each; codes (id, code) come from a product quantizer of 16 centroids."""

    def __init__(self, dim: int, m: int):
        if m < 1 or dim < 1 or dim % m:
            raise ValueError("dim must be a positive multiple of m")
        self.dim, self.m, self.sub = dim, m, dim // m

    def pack(self, codes: DataFrame) -> DataFrame:
        """(block, m, bytes): for 32 vectors in order of id from 0, byte j holds vector j in its low half and vector 16 + j in the
        high half; places without a vector are 0. Ids must be 0, 1, 2, ..."""
        flat = codes.select("id", F.posexplode("code").alias("m", "c"))
        row = F.pmod("id", F.lit(BLOCK))
        value = F.when(row >= 16, F.shiftleft(F.col("c").cast("int").bitwiseAND(F.lit(15)), 4)).otherwise(F.col("c").cast("int").bitwiseAND(F.lit(15)))
        byte = flat.groupBy(F.floor(F.col("id") / BLOCK).alias("block"), "m", F.pmod(row, F.lit(16)).cast("int").alias("j")).agg(F.sum(value).cast("int").alias("v"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.coalesce(F.try_element_at("got", j), F.lit(0)))
        return byte.groupBy("block", "m").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("got")).select("block", "m", filled.alias("bytes"))

    def store(self, codes: DataFrame) -> DataFrame:
        """(block, lanes, packed): the same bytes with all parts of a block in one row, to be written and searched; lanes has a bit for
        each of the 32 places that holds a vector."""
        m = self.m
        row = F.struct(F.pmod("id", F.lit(BLOCK)).cast("int").alias("lane"), F.col("code").cast("array<int>").alias("code"))
        held = codes.groupBy(F.floor(F.col("id") / BLOCK).alias("block")).agg(F.collect_list(row).alias("rows"))  # 32 at most

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                lanes, packed = [], []
                for rows in pdf["rows"]:
                    wide = np.zeros((BLOCK, m), np.uint8)
                    for r in rows:
                        wide[r["lane"]] = np.asarray(r["code"]) & 15
                    lanes.append(sum({1 << r["lane"] for r in rows}))
                    packed.append((wide[:16] | wide[16:] << 4).T.tobytes())
                yield pd.DataFrame({"block": pdf["block"], "lanes": lanes, "packed": packed})

        return held.mapInPandas(run, "block long, lanes long, packed binary")

    def codes_of(self, stored: DataFrame) -> DataFrame:
        """(id, code) of stored blocks."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                ids, code = self._unpacked(pdf)
                yield pd.DataFrame({"id": ids, "code": list(code.astype(np.int16))})

        return stored.mapInPandas(run, "id long, code array<smallint>")

    def _unpacked(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the vectors in stored blocks, and their codes (vectors, m)."""
        byte = np.frombuffer(b"".join(pdf["packed"]), np.uint8).reshape(len(pdf), self.m, 16)
        code = np.concatenate([byte & 15, byte >> 4], axis=2).transpose(0, 2, 1)
        there = (pdf["lanes"].to_numpy(np.int64)[:, None] >> np.arange(BLOCK)) & 1 > 0
        return (pdf["block"].to_numpy(np.int64)[:, None] * BLOCK + np.arange(BLOCK))[there], code[there]

    def byte_tables(self, tables: DataFrame) -> DataFrame:
        """(query_id, lut): query tables brought to 0 .. 255 by their least and greatest entry; all 0 if these are within 1e-7."""
        lo, hi = F.array_min("lut"), F.array_max("lut")
        scaled = F.transform("lut", lambda d: F.floor((d - lo) * 255 / (hi - lo) + 0.5).cast("int"))
        return tables.select("query_id", F.when(hi - lo < 1e-7, F.transform("lut", lambda d: F.lit(0))).otherwise(scaled).alias("lut"))

    def search(self, stored: DataFrame, byte_tables: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, distance) over stored blocks: least sums of table entries, kept to 16 bits.

        Tables of a checked size are sent to where blocks lie, and only k rows of a task for each query move on; larger sets of tables
        are dealt in blocks."""
        m = self.m

        def score(q, x):
            lut, code = q["lut"].astype(np.int64), x["code"].astype(np.int64)
            out = np.zeros((len(lut), len(code)), np.int64)
            for j in range(m):
                out += lut[:, code[:, j] + j * CODES]
            return (out & 0xFFFF).astype(np.float64)

        asked = sent(byte_tables, "query_id", ["lut"]) if k >= 1 else None
        if asked is None:
            return scan(self.codes_of(stored), byte_tables, ["code"], ["lut"], score, k)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = asked.value
            found = Best(q_ids, k)
            for pdf in parts:
                for at in range(0, len(pdf) if len(q_ids) else 0, BLOCKS):
                    ids, code = self._unpacked(pdf.iloc[at : at + BLOCKS])
                    for b in range(0, len(q_ids), QUERIES):
                        some = {"lut": q["lut"][b : b + QUERIES]}
                        found.see(np.arange(b, min(b + QUERIES, len(q_ids))), ids, score(some, {"code": code}))
            yield found.rows()

        return best(stored.select("block", "lanes", "packed").mapInPandas(run, HITS), k)
