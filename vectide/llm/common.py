"""Helpers shared by the operators: tables in the shared scratch folder, bound lambda values, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than blank and \t \n \v \f \r.
BLANKS = "\t\n\x0b\x0c\r"

#: Settings while a table is written: once it is there, nothing reads the shuffle files that led to it; and rows that hold
#: whole texts or sets go to Python a few at a time, so that long ones fit.
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset, a temporary one (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="vectide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str, partitions: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared scratch folder and reads it back: a cut in the lineage that survives lost executors.

    partitions: coalesces before the write. batch_bytes: Python gets no further row in a batch that has so many bytes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = WHILE_SAVING | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by save() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, so that an operator's own columns clash with none."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array. Plain splitting at one character avoids regular expressions."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """rows joined with facts on keys. facts has one row for each key, and how many rows have it in `count`.

    Keys that more than 1 / share of the counted rows have are `share` at most; these are sent to all tasks, so that no task gets
    all rows of a key. facts is read several times: give a written table.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * share > F.lit(total)
    hot = F.broadcast(facts.where(is_hot))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(facts.where(~is_hot), keys))


#: Bits of the table of maybe_in(). Its size is fixed: where it fills up, more rows pass, and the exact join that follows drops them.
FILTER_BITS = 1 << 20


def maybe_in(wanted: DataFrame, *columns: str) -> Column:
    """A condition on rows with these columns that holds for all of `wanted` and for few others.

    The wanted rows' hashes set bits of a table of FILTER_BITS bits, made by pre-aggregated sums and sent as a literal, so that wide
    rows that nobody asks for are dropped before they are exchanged.
    """
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    table = wanted.select(bit.alias("b")).groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v"))
    longs = [0] * (FILTER_BITS // 64)
    for w, v in table.collect():
        longs[w] = v
    literal = F.expr(f"cast(split('{','.join(map(str, longs))}', ',') as array<bigint>)")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    return F.get(literal, (bit / 64).cast("int")).bitwiseAND(one) != 0


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges: (id, component) with component = smallest id reachable.

    Alternating large-star and small-star steps; each round shuffles the edges once per step, minima are
    pre-aggregated by Spark, and no vertex's neighbours are ever gathered in one place. Each round is written to
    the shared scratch folder. Null ends and self-loops are dropped. No edges give no rows.
    """
    spark = edges.sparkSession
    cur = save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "cc"
    )
    for _ in range(most_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: neighbours above u go to the smallest of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = save(large, "cc")
        # small-star: u and its neighbours below u go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        small = save(small, "cc")
        # a fixed point is reached when the edges are stars: no vertex is both a centre and a leaf, and leaves have one centre
        leaves = small.groupBy("u").agg(F.count("*").alias("n"))
        many = leaves.where("n > 1").limit(1).count()
        chained = many or small.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        drop(cur, large)
        cur = small
        if not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    done = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = done.unionByName(done.select(F.col("component").alias("id"), "component").distinct())
    out._scratch = cur._scratch
    return out
