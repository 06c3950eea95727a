"""Files of records [int32 length][values], little endian: floats (fvecs), bytes (bvecs), integers (ivecs)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

KINDS = {"fvecs": ("<f4", "array<float>"), "bvecs": ("u1", "array<smallint>"), "ivecs": ("<i4", "array<int>")}


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _head(fs, at, kind: str) -> tuple[bytes, int, int]:
    """(first four bytes, size of a record, number of records); what is no file of whole records is an error."""
    if not fs.exists(at):
        raise FileNotFoundError(str(at))
    size = fs.getFileStatus(at).getLen()
    if size < 4:
        raise ValueError("no record in the file")
    stream = fs.open(at)
    head = bytes(stream.read() for _ in range(4))
    stream.close()
    dim = struct.unpack("<i", head)[0]
    record = 4 + dim * np.dtype(KINDS[kind][0]).itemsize
    if dim < 1 or size % record:
        raise ValueError(f"{size} bytes are no whole number of records of length {dim}")
    return head, record, size // record


def read_row(spark: SparkSession, path: str, row: int, kind: str | None = None) -> np.ndarray:
    """One vector by its place from 0: the file is opened at the record, and nothing else of it is read."""
    kind = kind or path.rsplit(".", 1)[-1]
    at, fs = _at(spark, path)
    head, record, n = _head(fs, at, kind)
    if not 0 <= row < n:
        raise IndexError(f"row {row} of {n}")
    stream = fs.open(at)
    try:
        stream.seek(row * record)
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, record))
    finally:
        stream.close()
    if data[:4] != head:
        raise ValueError("a record has another length")
    return np.frombuffer(data, KINDS[kind][0], offset=4)


def read_vecs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(id, vec) with ids from 0 in file order; read by splits of whole records, by any file system Spark knows.

    A missing or empty file, a length below 1, a size that is no multiple of a record, and a record of another length are errors.
    """
    kind = kind or path.rsplit(".", 1)[-1]
    dtype, column = KINDS[kind]
    at, fs = _at(spark, path)
    head, record, _ = _head(fs, at, kind)
    raw = spark.sparkContext.binaryRecords(path, record).zipWithIndex().map(lambda p: (p[1], bytes(p[0])))
    flat = spark.createDataFrame(raw, StructType([StructField("id", LongType()), StructField("r", BinaryType())]))

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if any(r[:4] != head for r in pdf["r"]):
                raise ValueError("a record has another length")
            yield pd.DataFrame({"id": pdf["id"], "vec": [np.frombuffer(r, dtype, offset=4) for r in pdf["r"]]})

    return flat.mapInPandas(decode, f"id bigint, vec {column}")


def write_vecs(rows: DataFrame, path: str, kind: str | None = None) -> None:
    """One file with the rows (id, vec) in order of id. Rows are encoded where they lie; the file is written through one stream, a
    batch at a time. All vectors must have one length."""
    kind = kind or path.rsplit(".", 1)[-1]
    dtype, _ = KINDS[kind]

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            dims = {len(v) for v in pdf["vec"]}
            data = b"".join(struct.pack("<i", len(v)) + np.asarray(v).astype(dtype).tobytes() for v in pdf["vec"])
            yield pd.DataFrame({"n": [max(dims) if len(dims) == 1 else -1], "b": [data]})

    at, fs = _at(rows.sparkSession, path)
    stream = fs.create(at, True)
    dim = None
    try:
        for r in rows.select("id", "vec").orderBy("id").mapInPandas(encode, "n int, b binary").toLocalIterator():
            if r.n < 1 or dim not in (None, r.n):
                raise ValueError("vectors of several lengths")
            dim = r.n
            stream.write(bytearray(r.b))
    finally:
        stream.close()


def random_vectors(spark: SparkSession, n: int, dim: int, kind: str = "fvecs", seed: int = 42) -> DataFrame:
    """(id, vec): normal floats, bytes 0 .. 255, or integers 0 .. 1e6."""
    value = {"fvecs": lambda i: F.randn(seed), "bvecs": lambda i: F.floor(F.rand(seed) * 256), "ivecs": lambda i: F.floor(F.rand(seed) * 1_000_001)}[kind]
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), value).cast(KINDS[kind][1]).alias("vec"))


def uniform(spark: SparkSession, low: float, high: float, shape: tuple[int, ...], seed: int | None = None) -> DataFrame:
    """(id, value): as many uniform numbers as the shape has places."""
    r = F.rand() if seed is None else F.rand(seed)
    return spark.range(int(np.prod(shape))).select("id", (r * (high - low) + low).alias("value"))


def cone(spark: SparkSession, n: int, dim: int, strength: float = 0.0, seed: int = 42) -> DataFrame:
    """(id, vec): normal vectors moved along the diagonal unit vector; strength 0 gives a sphere."""
    move = strength / float(np.sqrt(dim))
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.randn(seed) + move).cast("array<float>").alias("vec"))
