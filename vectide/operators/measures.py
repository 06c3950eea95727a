"""Measures of rankings, and of the shape of a set of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V


def per_query(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg, average_precision) of every query in truth; both have (query_id, rank, id), ranks from 1.

    Relevant are the first k of truth (all of it for the reciprocal rank, which has no cut-off). Recall is divided by k also if
    there are fewer; gains are 0 or 1; a query without hits has 0; k < 1 gives 0, but for the reciprocal rank.
    """
    every = truth.select("query_id").distinct()
    if k < 1:
        one = per_query(truth, found, 1).select("query_id", "reciprocal_rank")
        return one.select("query_id", F.lit(0.0).alias("recall"), "reciprocal_rank", F.lit(0.0).alias("ndcg"), F.lit(0.0).alias("average_precision"))
    hits = found.join(truth.select("query_id", "id", F.col("rank").alias("true_rank")).distinct(), ["query_id", "id"])
    first = hits.groupBy("query_id").agg((1 / F.min("rank")).alias("reciprocal_rank"))
    near = hits.where((F.col("rank") <= k) & (F.col("true_rank") <= k))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("nth", nth).groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"), F.sum(F.col("nth") / F.col("rank")).alias("precision")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("wanted")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    wanted = truth.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("wanted")).withColumn("ideal", ideal)
    out = every.join(wanted, "query_id").join(first, "query_id", "left").join(near, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id",
        zero(F.col("n") / k).alias("recall"),
        zero(F.col("reciprocal_rank")).alias("reciprocal_rank"),
        zero(F.col("gain") / F.col("ideal")).alias("ndcg"),
        zero(F.col("precision") / F.col("wanted")).alias("average_precision"),
    )


def means(truth: DataFrame, found: DataFrame, k: int, asked: int | None = None) -> DataFrame:
    """One row (mean_recall, mrr, mean_ndcg, map): means over all queries of truth; a query that found nothing counts as 0 in each.

    asked: how many lists of hits there are, empty ones too; if truth has another number of queries, or none, all four are 0.
    """
    q = per_query(truth, found, k)
    names = (("recall", "mean_recall"), ("reciprocal_rank", "mrr"), ("ndcg", "mean_ndcg"), ("average_precision", "map"))
    ok = F.lit(True) if asked is None else F.count("*") == asked
    return q.agg(*(F.when(ok, F.coalesce(F.avg(c), F.lit(0.0))).otherwise(0.0).alias(n) for c, n in names))


def reciprocal_rank_of(found: DataFrame, id: int) -> DataFrame:
    """(query_id, reciprocal_rank): one over the rank of the row `id` in each query's hits, 0 where it isn't among them."""
    rank = F.min(F.when(F.col("id") == id, F.col("rank")))
    return found.groupBy("query_id").agg(F.coalesce(1 / rank, F.lit(0.0)).alias("reciprocal_rank"))


def pair_cosines(rows: DataFrame, shift: int, pairs: int = 10_000, seed: int = 42) -> DataFrame:
    """(id, other, cosine) of pairs of rows with ids id and (id + shift) mod n, for `pairs` ids at most (a sampling operator), the first
    in the order of (id * 2654435761 + seed) mod 2 ** 32, then id, over all rows. Ids are 0 .. n - 1."""
    n = rows.agg(F.max("id") + 1).first()[0] or 1
    order = F.pmod(F.col("id") * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))
    left = rows.orderBy(order, "id").limit(pairs).select("id", "vec", F.pmod(F.col("id") + shift, F.lit(n)).alias("other"))
    right = rows.select(F.col("id").alias("other"), F.col("vec").alias("w"))
    return left.join(right, "other").select("id", "other", (1 - V.cosine_distance(F.col("vec"), F.col("w"))).alias("cosine"))


def geometry(rows: DataFrame, shift: int = 7, pairs: int = 10_000, top: int = 10) -> DataFrame:
    """One row (mean_cosine, std_cosine, top_share, is_anisotropic): cosines of random pairs, and the share of the `top` largest
    squared singular values of the centred unit vectors. The moments are summed where the rows lie; dim x dim numbers are collected."""
    dim = rows.select(F.size("vec")).first()[0]

    def moments(parts):
        import pandas as pd

        s, m, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for pdf in parts:
            x = np.stack(pdf["u"].to_list()).astype(np.float64)
            s, m, n = s + x.sum(axis=0), m + x.T @ x, n + len(x)
        yield pd.DataFrame({"n": [n], "s": [s], "m": [m.ravel()]})

    part = rows.select(V.normalize(F.col("vec")).alias("u")).mapInPandas(moments, "n long, s array<double>, m array<double>")
    add = lambda c: part.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i")
    n = part.agg(F.sum("n")).first()[0]
    s, m = (np.array([r.x for r in add(c).collect()]) for c in ("s", "m"))
    values = np.sort(np.linalg.eigvalsh(m.reshape(dim, dim) / n - np.outer(s / n, s / n)))[::-1]
    share = float(values[:top].sum() / values.sum())
    cos = pair_cosines(rows, shift, pairs).agg(F.avg("cosine").alias("mean_cosine"), F.stddev_pop("cosine").alias("std_cosine"))
    return cos.select("mean_cosine", "std_cosine", F.lit(share).alias("top_share"), ((F.col("mean_cosine") > 0.25) | (F.lit(share) > 0.5)).alias("is_anisotropic"))
