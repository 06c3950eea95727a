"""Exact search: one query over all rows, many queries at once, and an index that rows are added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import Metric, distance, parse_metric
from vectide.operators.blocks import metric_scores, scan

SCHEMA = "id bigint, vec array<float>"


def _literal(spark_values) -> F.Column:
    return F.array(*(F.lit(float(x)) for x in spark_values))


def linear_scan(base: DataFrame, query, k: int, metric: str | Metric = "l2", ahead: int = 8) -> DataFrame:
    """(rank, id, distance): the k rows of (id, vec) nearest to one vector, by distance, then id. k <= 0: none.

    ahead is accepted and has no effect: reading ahead is the engine's business. Vectors of other lengths are an error.
    """
    dim = len(query)
    if k <= 0 or dim == 0:
        return base.select(F.lit(0).alias("rank"), "id", F.lit(0.0).alias("distance")).limit(0)
    checked = F.when(F.size("vec") == dim, distance(metric, F.col("vec"), _literal(query))).otherwise(F.raise_error(F.lit("vectors have another dimension than the query")).cast("double"))
    top = base.select("id", checked.alias("distance")).orderBy("distance", "id").limit(k)
    return top.select(F.row_number().over(Window.orderBy("distance", "id")).alias("rank"), "id", "distance")


def linear_scan_vectors(base: DataFrame, query, k: int, method: str = "cosine") -> DataFrame:
    """linear_scan() with the other default: cosine."""
    return linear_scan(base, query, k, parse_metric(method))


def batch_linear_scan(base: DataFrame, queries: DataFrame, k: int, tile_size: int = 2048, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows for every row of queries (query_id, vec)."""
    if tile_size < 1:
        raise ValueError("tile_size must be at least 1")
    return scan(base, queries, ["vec"], ["vec"], metric_scores(metric), k)


class FlatIndex:
    """An exact index over rows (id, vec). Ids are given, or go on from the number of rows."""

    def __init__(self, spark: SparkSession, dim: int, metric: str | Metric = "l2"):
        if dim < 1:
            raise ValueError("dim must be at least 1")
        self.spark, self.dim, self.metric = spark, dim, parse_metric(metric)
        self.reset()

    def reset(self) -> None:
        self.rows = self.spark.createDataFrame([], SCHEMA)

    def reserve(self, n: int) -> None:
        """Nothing to do: rows are held by the engine."""

    def add(self, rows: DataFrame, ids: bool = True) -> FlatIndex:
        """Appends rows with columns id and vec, or with vec only if ids is False."""
        if rows.where(F.size("vec") != self.dim).limit(1).count():
            raise ValueError(f"vectors must have {self.dim} components")
        if not ids:
            counted = rows.rdd.zipWithIndex().map(lambda p: (p[1], p[0]["vec"]))  # numbers that go on need the order of partitions
            rows = self.spark.createDataFrame(counted, SCHEMA).withColumn("id", F.col("id") + self.size())
        self.rows = self.rows.unionByName(rows.select(F.col("id").cast("bigint"), F.col("vec").cast("array<float>")))
        return self

    def size(self) -> int:
        return self.rows.count()

    def empty(self) -> bool:
        return not self.rows.limit(1).count()

    def get(self, id: int):
        found = self.rows.where(F.col("id") == id).first()
        return None if found is None else list(found["vec"])

    def search(self, query, k: int) -> DataFrame:
        if len(query) != self.dim:
            raise ValueError(f"the query must have {self.dim} components")
        return linear_scan(self.rows, query, k, self.metric)

    def batch_search(self, queries: DataFrame, k: int, tile_size: int = 2048) -> DataFrame:
        return batch_linear_scan(self.rows, queries, k, tile_size, self.metric)
