"""Inverted lists: rows by nearest centroid, and search in the lists nearest to a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vectors import Metric, distance, parse_metric
from vectide.operators import kmeans
from vectide.operators.blocks import HITS, QUERIES, TYPES, Best, best, matrix, metric_scores, sent


class IvfFlatIndex:
    """nlist inverted lists under a metric. train(), then add() rows (id, vec), then search."""

    def __init__(self, spark: SparkSession, dim: int, nlist: int, metric: str | Metric = "l2", stored: str = "float"):
        if dim < 1 or nlist < 1:
            raise ValueError("dim and nlist must be at least 1")
        self.spark, self.dim, self.nlist, self.metric = spark, dim, nlist, parse_metric(metric)
        self.centroids: np.ndarray | None = None
        self.stored = stored  # float or double: what the lists keep of each component
        self.postings = spark.createDataFrame([], f"list_id int, id bigint, vec array<{stored}>")

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    def train(self, rows: DataFrame, rounds: int = 15, seed: int = 42) -> IvfFlatIndex:
        self.centroids = kmeans.train(rows, self.nlist, self.metric, rounds, seed)
        return self

    def add(self, rows: DataFrame) -> IvfFlatIndex:
        self._need()
        placed = kmeans.assign(rows.select(F.col("id").cast("bigint"), F.col("vec").cast(f"array<{self.stored}>")), self.centroids, self.metric)
        self.postings = self.postings.unionByName(placed.select("list_id", "id", "vec"))
        return self

    def save(self, path: str) -> None:
        """Postings as Parquet by list, so that a search reads the probed lists only."""
        self.postings.repartition("list_id").write.partitionBy("list_id").parquet(path)

    def _need(self) -> None:
        if not self.is_trained:
            raise RuntimeError("the index is not trained")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, vec, list_id): the nprobe nearest lists of each query, nprobe held to 1 .. nlist."""
        n = max(1, min(nprobe, self.nlist))
        sent, score = self.spark.sparkContext.broadcast(self.centroids), metric_scores(self.metric)

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            d = score({"vec": np.stack(v.to_list()).astype(np.float64)}, {"vec": sent.value}) if len(v) else np.zeros((0, 1))
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return queries.select("query_id", F.col("vec").alias("q"), F.explode(nearest(F.col("vec").cast("array<double>"))).alias("list_id"))

    def batch_search(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        """(query_id, rank, id, distance) among the probed lists; fewer than k rows if those hold fewer; none for k <= 0.

        Queries of a checked size go to the postings, which stay where they lie: each batch's rows of a list and the queries that
        probe it are one matrix product. Larger sets of queries meet the postings in a join."""
        self._need()
        queries = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"))
        asked = sent(queries, "query_id", ["vec"]) if k > 0 else None
        if asked is None:
            met = self.probes(queries, nprobe).join(self.postings, "list_id")
            return best(met.select("query_id", "id", distance(self.metric, F.col("vec"), F.col("q")).alias("distance")), max(k, 0))
        n, score = max(1, min(nprobe, self.nlist)), metric_scores(self.metric)
        by_query = np.argsort(score({"vec": asked.value[1]["vec"]}, {"vec": self.centroids}), axis=1, kind="stable")[:, :n] if len(asked.value[0]) else np.zeros((0, n), int)
        probing = [np.flatnonzero((by_query == j).any(axis=1)) for j in range(self.nlist)]

        stored = TYPES[self.stored]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = asked.value
            found = Best(q_ids, k)
            for part in parts:
                of, ids = part["list_id"].to_numpy(zero_copy_only=False), part["k"].to_numpy(zero_copy_only=False)
                x = matrix(part["vec"], stored) if part.num_rows else None
                for j in np.unique(of):
                    rows, at = np.flatnonzero(of == j), probing[j]
                    for b in range(0, len(at), QUERIES):
                        found.see(at[b : b + QUERIES], ids[rows], score({"vec": q["vec"][at[b : b + QUERIES]]}, {"vec": x[rows]}))
            yield pa.RecordBatch.from_pandas(found.rows(), preserve_index=False)

        return best(self.postings.select("list_id", F.col("id").alias("k"), "vec").mapInArrow(run, HITS), k)

    def search(self, query, k: int, nprobe: int = 1) -> DataFrame:
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, vec array<double>")
        return self.batch_search(one, k, nprobe).drop("query_id")

    def total_vectors(self) -> int:
        return self.postings.count()

    def lists(self) -> DataFrame:
        """(list_id, n) of all lists, empty ones too."""
        every = self.spark.range(self.nlist).select(F.col("id").cast("int").alias("list_id"))
        return every.join(self.postings.groupBy("list_id").agg(F.count("*").alias("n")), "list_id", "left").fillna(0, ["n"])

    def list_stats(self) -> DataFrame:
        """One row: total, least, most, mean, upper median, population deviation and number of empty lists."""
        n = F.col("n")
        middle = F.get(F.sort_array(F.collect_list(n)), F.floor(F.count("*") / 2).cast("int"))
        return self.lists().agg(
            F.sum(n).alias("total"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("mean_size"),
            middle.alias("median_size"), F.stddev_pop(n).alias("stddev_size"), F.count_if(n == 0).alias("empty_lists"),
        )
