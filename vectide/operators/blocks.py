"""Exact scoring of a set of queries against all rows, in blocks of both, and the best k of each query.

Rows stay where they lie. A set of queries of a checked size is sent to all tasks; each batch of rows and all queries are one matrix
product, and a task passes on k rows for each query. Larger sets of queries are dealt in blocks to groups of row blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vectors import TINY, Metric, parse_metric

#: Rows of a block, queries of a block, and bytes of queries that are sent to all tasks at most.
ROWS, QUERIES, SENT = 8192, 512, 64 << 20
#: Numpy's name of what an array column holds; blocks keep the stored type.
TYPES = {"float": "f4", "double": "f8", "tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8"}
Arrays = dict[str, np.ndarray]


def _types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    return {c: TYPES[df.schema[c].dataType.elementType.simpleString()] for c in columns}


def matrix(column, dtype: str) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix. Null vectors or components and other lengths are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if column.null_count or flat.null_count or (len(column) and len(flat) % len(column)):
        raise ValueError("vectors are null or of several lengths")
    if len(column) and (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any():
        raise ValueError("vectors are of several lengths")
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), len(flat) // max(1, len(column)))


class Best:
    """The best k of each query (distance, then id) of what has been seen."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.q, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(len(q_ids), np.inf)  # of each query with k rows so far, the worst one's distance

    def meet(self, at: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, metric: str | Metric) -> None:
        """The queries numbered `at`, with vectors q, and rows x with these ids. Products leave rounding errors that differ between equal
        rows; what may be near enough is measured again, so that equal rows tie and go by id."""
        d, pairs = metric_scores(metric)({"vec": q}, {"vec": x}), metric_pairs(metric)
        size = np.ones(len(q)) if parse_metric(metric) is Metric.COSINE else np.einsum("ij,ij->i", q, q) + np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0)
        self.see(at, ids, d, 4 * (x.shape[1] + 8) * np.finfo(float).eps * size, lambda i, j: pairs(q, x, i, j))

    def see(self, at: np.ndarray, ids: np.ndarray, d: np.ndarray, slack: np.ndarray | float = 0.0, again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """d: distances of the queries numbered `at` to rows with these ids, each query's within slack / 2; again: exact ones by place in d."""
        bound = self.bound[at]
        open_ = np.isinf(bound) if d.shape[1] > self.k else np.zeros(len(at), bool)
        if open_.any():
            worst = np.partition(d[open_], self.k - 1, axis=1)[:, self.k - 1]
            bound[open_] = np.where(np.isnan(worst), np.inf, worst)
        q, r = np.nonzero(d <= (bound + slack)[:, None])
        if len(q):
            near = d[q, r] if again is None else again(q, r)
            self.q, self.id, self.d = np.concatenate([self.q, at[q]]), np.concatenate([self.id, ids[r]]), np.concatenate([self.d, near])
        if open_.any() or len(self.q) > 2 * self.k * len(self.q_ids):
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.id, self.d, self.q))
        q = self.q[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        at = np.arange(len(q))
        nth = at - np.maximum.accumulate(np.where(first, at, 0)) if len(q) else at
        order = order[nth < self.k]
        self.q, self.id, self.d = self.q[order], self.id[order], self.d[order]
        last = nth[nth < self.k] == self.k - 1
        self.bound[self.q[last]] = self.d[last]

    def rows(self) -> pd.DataFrame:
        self.cut()
        return pd.DataFrame({"query_id": self.q_ids[self.q], "id": self.id, "distance": self.d})


HITS = "query_id long, id long, distance double"


def sent(queries: DataFrame, key: str, columns: list[str]):
    """(ids, matrices by column) of the queries, broadcast, if they have SENT bytes at most; else None."""
    types = _types(queries, columns)
    size = queries.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in columns)).first()
    if size["n"] * 8 + sum(size[c] * np.dtype(types[c]).itemsize for c in columns) > SENT:
        return None
    got = queries.select(F.col(key).alias("k"), *columns).toArrow()
    return queries.sparkSession.sparkContext.broadcast((got["k"].to_numpy().astype(np.int64), {c: matrix(got[c], types[c]) for c in columns}))


def pack(df: DataFrame, key: str, columns: list[str], rows: int) -> DataFrame:
    """Blocks (ids, one binary matrix for each array column, in the stored type) of up to `rows` rows of a partition."""
    types = _types(df, columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, rows):
                some = part.slice(at, rows)
                out = {"ids": pa.array([some["k"].to_numpy(zero_copy_only=False).astype(np.int64)], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array([matrix(some[c], types[c]).tobytes()], pa.binary()) for c in columns})

    schema = ", ".join(["ids array<bigint>", *(f"{c} binary" for c in columns)])
    return df.select(F.col(key).alias("k"), *columns).mapInArrow(run, schema)


def best(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """(query_id, rank, id, distance): the k smallest (distance, id) of each query, rank from 1."""
    order = Window.partitionBy(query).orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, "rank", "id", "distance")


def scan(base: DataFrame, queries: DataFrame, columns: list[str], query_columns: list[str], score: Callable[[Arrays, Arrays], np.ndarray], k: int, id: str = "id", query_id: str = "query_id", metric: str | Metric | None = None) -> DataFrame:
    """best() of all rows for every query. score(queries, rows) gives a matrix of distances from matrices by column name. With a metric,
    columns are vec on both sides and equal rows tie exactly."""
    if k < 1:
        return base.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("distance")).limit(0)
    types, asked = _types(base, columns), sent(queries, query_id, query_columns)
    if asked is None:
        return best(_dealt(base, queries, columns, query_columns, score, k, id, query_id, metric), k)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        q_ids, q = asked.value
        found = Best(q_ids, k)
        for part in parts:
            for at in range(0, part.num_rows if len(q_ids) else 0, ROWS):
                some = part.slice(at, ROWS)
                x, ids = {c: matrix(some[c], types[c]) for c in columns}, some["k"].to_numpy(zero_copy_only=False)
                for b in range(0, len(q_ids), QUERIES):
                    if metric is not None:
                        found.meet(np.arange(b, min(b + QUERIES, len(q_ids))), ids, q["vec"][b : b + QUERIES], x["vec"], metric)
                        continue
                    found.see(np.arange(b, min(b + QUERIES, len(q_ids))), ids, score({c: m[b : b + QUERIES] for c, m in q.items()}, x))
        yield pa.RecordBatch.from_pandas(found.rows(), preserve_index=False)

    return best(base.select(F.col(id).cast("long").alias("k"), *columns).mapInArrow(run, HITS), k)


def _dealt(base: DataFrame, queries: DataFrame, columns: list[str], query_columns: list[str], score, k: int, id: str, query_id: str, metric: str | Metric | None = None) -> DataFrame:
    """Hits of sets of queries that are too large to be sent: blocks of queries meet groups of row blocks, as many groups as blocks
    of rows up to the number of shuffle partitions."""
    types, q_types = _types(base, columns), _types(queries, query_columns)
    groups = int(min(max(1, -(-base.count() // ROWS)), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = pack(base, id, columns, ROWS).withColumn("deal", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(groups)).cast("int"))
    asked = pack(queries.select(F.col(query_id), *(F.col(c).alias(f"q_{c}") for c in query_columns)), query_id, [f"q_{c}" for c in query_columns], QUERIES)
    asked = asked.withColumnRenamed("ids", "q_ids").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                ids, q_ids = np.asarray(r.ids), np.asarray(r.q_ids)
                x = {c: np.frombuffer(getattr(r, c), types[c]).reshape(len(ids), -1) for c in columns}
                q = {c: np.frombuffer(getattr(r, f"q_{c}"), q_types[c]).reshape(len(q_ids), -1) for c in query_columns}
                found = Best(q_ids, k)
                if metric is None:
                    found.see(np.arange(len(q_ids)), ids, score(q, x))
                else:
                    found.meet(np.arange(len(q_ids)), ids, q["vec"], x["vec"], metric)
                yield found.rows()

    return asked.join(rows, "deal").mapInPandas(run, HITS)


def metric_scores(metric: str | Metric) -> Callable[[Arrays, Arrays], np.ndarray]:
    """Distances of all pairs of two matrices named vec, by matrix product in doubles; squared L2 is kept from falling below 0."""
    m = parse_metric(metric)

    def score(q: Arrays, x: Arrays) -> np.ndarray:
        a, b = q["vec"].astype(np.float64, copy=False), x["vec"].astype(np.float64, copy=False)
        dot = a @ b.T
        if m is Metric.IP:
            return np.negative(dot, out=dot)
        n, k = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        if m is Metric.L2:
            dot *= -2
            dot += n[:, None]
            dot += k
            return np.maximum(dot, 0, out=dot)
        size = np.sqrt(n[:, None] * k)
        return np.where(size <= TINY, 0.0, 1 - np.clip(dot / np.maximum(size, TINY), -1, 1))

    return score


def metric_pairs(metric: str | Metric) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Distances of the rows of two matrices that i and j pair, summed component by component in order."""
    m = parse_metric(metric)

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.add.accumulate(a * b, axis=1)[:, -1]

    def pairs(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for at in range(0, len(i) if x.shape[1] else 0, ROWS):
            a, b = x[j[at : at + ROWS]].astype(np.float64, copy=False), q[i[at : at + ROWS]].astype(np.float64, copy=False)
            if m is Metric.COSINE:
                size = np.sqrt(dot(a, a) * dot(b, b))
                out[at : at + ROWS] = np.where(size <= TINY, 0.0, 1 - np.clip(dot(a, b) / np.maximum(size, TINY), -1, 1))
            else:
                out[at : at + ROWS] = -dot(a, b) if m is Metric.IP else dot(a - b, a - b)
        return out

    return pairs
