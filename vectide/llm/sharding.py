"""Assigning rows to shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import save

STEP = np.uint64(2862933555777941757)
#: Rows of one file that are numbered together; bounds every window group whatever the keys are.
BLOCK = 65536


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each 64-bit key among n shards: each key jumps ahead until it would pass n.

    Going from n to n + 1 shards moves a key into the new shard or not at all.
    """
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(key), dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            key[live] = key[live] * STEP + np.uint64(1)
            far = (at[live] + 1) * (2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
            ahead[live] = far.astype(np.int64)
            live = live[ahead[live] < n]
    return at.astype(np.int32)


def jump_column(n: int):
    """Column function: integer key to shard 0 .. n - 1 (a null key counts as 0)."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(np.int64), n))

    return shard


def assign(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row; key and shard count alone decide the shard.

    size: UTF-8 bytes of the text plus 1 (null text: 1, with checksum 0). slot: gapless from 0 in each shard. grown_shard:
    the shard if there were one more. A null key counts as 0 and stays null in the result. Rows with the same key
    share a shard, whatever their number; an empty table gives no rows; other columns are ignored.

    The shard column is written once; slots come from windows over blocks of at most BLOCK rows of one file, and the
    blocks' offsets from a running sum over their counts, so no task holds a shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    whole = F.coalesce(F.col(text), F.lit(""))
    flat = save(
        docs.select(
            F.col(key),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            jump_column(n_shards)(F.col(key).cast("long")).alias("shard"),
            jump_column(n_shards + 1)(F.col(key).cast("long")).alias("grown_shard"),
        ),
        "shards",
    )
    at = flat.select(
        "*",
        F.col("_metadata.file_name").alias("__file"),
        (F.col("_metadata.row_index") / BLOCK).cast("long").alias("__block"),
        F.col("_metadata.row_index").alias("__row"),
    )
    block = ["shard", "__file", "__block"]
    counts = at.groupBy(*block).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(*block).orderBy("__row")) - 1
    return (
        at.withColumn("__local", local)
        .join(offsets, block)
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("__base") + F.col("__local")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
