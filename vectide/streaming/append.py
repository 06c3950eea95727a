"""Appending a stream of rows to the inverted lists of a trained index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectide.operators.ivf import IvfFlatIndex
from vectide.operators import kmeans


def append_postings(rows: DataFrame, index: IvfFlatIndex, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that gives each arriving row (id, vec) its list and writes it as Parquet by list. Each row is looked at
    on its own, so there is no state; the sink's log makes each batch count once."""
    if not index.is_trained:
        raise RuntimeError("the index is not trained")
    placed = kmeans.assign(rows, index.centroids, index.metric).select("list_id", "id", "vec")
    return placed.writeStream.format("parquet").partitionBy("list_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
