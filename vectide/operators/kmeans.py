"""Lloyd's algorithm on DataFrames: one pass per round, partial sums where the rows lie, centroids on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import TINY, Metric, parse_metric
from vectide.operators.blocks import metric_scores


def unit(x: np.ndarray) -> np.ndarray:
    size = np.einsum("...i,...i->...", x, x)[..., None]
    return np.where(size > TINY, x / np.sqrt(np.maximum(size, TINY)), x)


def first_rows(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """k rows' vectors in the order of (id * 2654435761 + seed) mod 2 ** 32, then id: a start that any engine can repeat."""
    order = F.pmod(F.col("id") * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))
    got = rows.orderBy(order, "id").limit(k).select(F.col("vec").cast("array<double>").alias("v")).collect()
    return np.array([r.v for r in got], dtype=np.float64)


def assign(rows: DataFrame, centroids: np.ndarray, metric: str | Metric = "l2") -> DataFrame:
    """rows with list_id and cdist: the nearest centroid, the lowest number among equals. Centroids are a bounded table: k x dim."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    score = metric_scores(metric)

    @F.pandas_udf("list_id int, cdist double")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in parts:
            d = score({"vec": np.stack(v.to_list()).astype(np.float64)}, {"vec": sent.value}) if len(v) else np.zeros((0, 1))
            own = d.argmin(axis=1)
            yield pd.DataFrame({"list_id": own.astype(np.int32), "cdist": d[np.arange(len(d)), own]})

    return rows.withColumn("__n", nearest(F.col("vec").cast("array<double>"))).select(*rows.columns, "__n.list_id", "__n.cdist")


def step(rows: DataFrame, centroids: np.ndarray, metric: str | Metric = "l2", reseed: bool = True) -> np.ndarray:
    """One round: means of the members (brought to unit norm unless squared L2); the i-th empty list takes the row that fits i-th worst."""
    k, dim = centroids.shape
    sphere = parse_metric(metric) is not Metric.L2
    placed = assign(rows, centroids, metric)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, dim)), np.zeros(k, dtype=np.int64)
        for pdf in parts:
            own = pdf["list_id"].to_numpy()
            np.add.at(total, own, np.stack(pdf["vec"].to_list()).astype(np.float64))
            n += np.bincount(own, minlength=k)
        full = np.flatnonzero(n)
        if len(full):  # a task may have no rows, and Arrow takes no array column from an empty frame
            yield pd.DataFrame({"list_id": full.astype(np.int32), "n": n[full], "s": list(total[full])})

    part = placed.select("list_id", "vec").mapInPandas(sums, "list_id int, n long, s array<double>")
    flat = part.select("list_id", "n", F.posexplode("s").alias("pos", "s")).groupBy("list_id", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    got = flat.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("s"), F.first("n").alias("n")).collect()
    new, seen = centroids.copy(), np.zeros(k, dtype=bool)
    for r in got:
        new[r.list_id] = np.array([x.s for x in r.s]) / r.n
        seen[r.list_id] = True
    if sphere:
        new[seen] = unit(new[seen])
    empty = np.flatnonzero(~seen)
    if reseed and len(empty):
        far = placed.orderBy(F.desc("cdist"), "id").limit(len(empty)).select(F.col("vec").cast("array<double>").alias("v")).collect()
        for j, r in zip(empty, far):
            new[j] = unit(np.array(r.v)) if sphere else np.array(r.v)
    return new


def train(rows: DataFrame, k: int, metric: str | Metric = "l2", rounds: int = 15, seed: int = 42) -> np.ndarray:
    """Centroids after a fixed number of rounds from first_rows(). Fewer rows than k are an error."""
    start = first_rows(rows, k, seed)
    if len(start) < k:
        raise ValueError("fewer rows than lists")
    centroids = start if parse_metric(metric) is Metric.L2 else unit(start)
    for _ in range(rounds):
        centroids = step(rows, centroids, metric)
    return centroids
