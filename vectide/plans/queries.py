"""Queries over the embeddings table, one for each operator or group of operators, and their SQL for DuckDB.

Rows are unit vectors, on which the metrics agree, so most queries work on copies that are scaled by 1 + id % 7. Where an
operator searches, the queries are all rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import kmeans
from vectide.operators.binary import BinaryQuantizer
from vectide.operators.fastscan import FastScan
from vectide.operators.flat import FlatIndex, batch_linear_scan, linear_scan, linear_scan_vectors
from vectide.operators.ivf import IvfFlatIndex
from vectide.operators.kdforest import KdForest, SearchParams, TreeParams
from vectide.operators.measures import geometry, means, pair_cosines, per_query, reciprocal_rank_of
from vectide.operators.product import ProductQuantizer
from vectide.operators.scalar import ScalarQuantizer, coarse_scan, mean_squared_error, range_of, two_stage
from vectide.sources import vecs

K, NLIST, M, BOOK = 10, 8, 8, 16
ONE = 7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return unit_rows(spark, sf).select("id", F.transform(V.doubles(F.col("vec")), lambda x: x * (1 + F.col("id") % 7)).alias("vec"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vec")


def dim_of(rows: DataFrame) -> int:
    return rows.select(F.size("vec")).first()[0]


def one(rows: DataFrame, id: int = ONE) -> list[float]:
    return list(rows.where(F.col("id") == id).first()["vec"])


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in names})


def listed(df: DataFrame, column: str, value: str, places: int | None = 6) -> DataFrame:
    """One row for each component: the other columns, pos from 0, and the value."""
    others = [c for c in df.columns if c != column]
    out = df.select(*others, F.posexplode(column).alias("pos", value))
    return out if places is None else rounded(out, value, places=places)


def text(column: Column) -> Column:
    return F.array_join(column.cast("array<string>"), ",")


# SQL pieces
VS = "v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings)"


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def sql_distance(metric: str, a: str, b: str) -> str:
    ip = f"list_inner_product({a}, {b})"
    if metric == "l2":
        return sql_l2(a, b)
    return f"-{ip}" if metric == "ip" else f"1 - greatest(-1, least(1, {ip} / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))))"


def sql_top(source: str, k: int = K) -> str:
    """The first k of (query_id, id, distance)."""
    return f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({source})) WHERE rank <= {k}"


def sql_knn(metric: str, k: int = K) -> str:
    return f"WITH {VS} " + sql_top(f"SELECT q.id AS query_id, v.id, {sql_distance(metric, 'v.v', 'q.v')} AS distance FROM v q, v WHERE q.id % 20 = 0", k)


def sql_scan(metric: str, idexpr: str = "v.id") -> str:
    return f"WITH {VS} SELECT CAST(row_number() OVER (ORDER BY d, id) AS INTEGER) AS rank, id, round(d, 6) AS distance FROM (SELECT {idexpr} AS id, {sql_distance(metric, 'v.v', 'q.v')} AS d FROM v, v q WHERE q.id = {ONE} ORDER BY 2, 1 LIMIT {K})"


def sql_all(metric: str) -> str:
    return f"WITH {VS} SELECT v.id, round({sql_distance(metric, 'v.v', 'q.v')}, 6) AS distance FROM v, v q WHERE q.id = {ONE}"


# distances and normalization
def _all(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = scaled(spark, sf)
        q = F.array(*(F.lit(x) for x in one(rows)))
        return rows.select("id", F.round(V.distance(metric, F.col("vec"), q), 6).alias("distance"))

    run.__name__ = f"dist_{metric}"
    return run


def _scan(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = scaled(spark, sf)
        search = linear_scan_vectors if metric == "cosine" else linear_scan
        return rounded(search(rows, one(rows), K, *([metric] if metric == "ip" else [])), "distance")

    run.__name__ = f"linear_scan_{metric}"
    return run


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = scaled(spark, sf)
        return rounded(batch_linear_scan(rows, asked(rows), K, metric=metric), "distance")

    run.__name__ = f"knn_{metric}_batch"
    return run


for _m in ("l2", "ip", "cosine"):
    query(sql_all(_m))(_all(_m))
    query(sql_scan(_m))(_scan(_m))
    query(sql_knn(_m))(_knn(_m))


@query(f"WITH {VS} SELECT v.id, round({sql_distance('cosine', 'v.v', 'q.v')}, 6) AS exact, true AS close FROM v, v q WHERE q.id = {ONE}")
def dist_cosine_fast(spark: SparkSession, sf: str) -> DataFrame:
    """The exact distance, and whether the approximate one is within 0.005 of it."""
    rows = scaled(spark, sf)
    q = F.array(*(F.lit(x) for x in one(rows)))
    exact = V.cosine_distance(F.col("vec"), q)
    return rows.select("id", F.round(exact, 6).alias("exact"), (F.abs(V.cosine_distance_fast(F.col("vec"), q) - exact) < 0.005).alias("close"))


@query(f"WITH {VS} SELECT id, round(1 / sqrt(list_inner_product(v, v)), 6) AS exact, true AS close FROM v")
def fast_rsqrt(spark: SparkSession, sf: str) -> DataFrame:
    """The exact value, and whether the approximate one is within two thousandths of it."""
    n = V.norm_squared(F.col("vec"))
    return scaled(spark, sf).select("id", F.round(1 / F.sqrt(n), 6).alias("exact"), (F.abs(V.fast_rsqrt(n) * F.sqrt(n) - 1) < 0.002).alias("close"))


@query(f"WITH {VS} SELECT id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, round(unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS value FROM v")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return listed(scaled(spark, sf).select("id", V.normalize(F.col("vec")).alias("vec")), "vec", "value")


@query(sql_scan("ip", "v.id + 1000"))
def flat_custom_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    index = FlatIndex(spark, dim_of(rows), "ip").add(rows.select((F.col("id") + 1000).alias("id"), "vec"))
    return rounded(index.search(one(rows), K), "distance", places=4)


ORACLE["flat_custom_ids"] = ORACLE["flat_custom_ids"].replace("round(d, 6)", "round(d, 4)")


# scalar quantizers
RANGE = """e AS (SELECT x, row_number() OVER (ORDER BY id, pos) AS k FROM (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS m FROM e WHERE k <= 100000),
b AS (SELECT max(CASE WHEN r = CAST(floor(CAST(m - 1 AS FLOAT) * CAST(0.0005 AS FLOAT)) AS BIGINT) THEN x END) AS lo,
             max(CASE WHEN r = CAST(floor(CAST(m - 1 AS FLOAT) * CAST(0.9995 AS FLOAT)) AS BIGINT) THEN x END) AS hi FROM o)"""


def sql_code(levels: int) -> str:
    return f"""c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, lo, (hi - lo) / {levels} AS step,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor((greatest(lo, least(hi, x)) - lo) / ((hi - lo) / {levels}) + 0.5) AS INTEGER)) AS code FROM embeddings, b)"""


def _sq(rows: DataFrame, levels: int) -> ScalarQuantizer:
    return ScalarQuantizer(dim_of(rows), levels).train(rows)


@query(f"WITH {RANGE} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round((hi - lo) / 255, 8) AS step8, round((hi - lo) / 15, 8) AS step4 FROM b")
def sq_train(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    ends = range_of(rows, dim_of(rows))
    step = F.col("hi") - F.col("lo")
    return ends.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round(step / 255, 8).alias("step8"), F.round(step / 15, 8).alias("step4"))


@query(f"WITH {RANGE}, {sql_code(255)} SELECT id, CAST(unnest(range(len(code))) AS INTEGER) AS pos, CAST(unnest(code) AS SMALLINT) AS code FROM c")
def sq8_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    return listed(_sq(rows, 255).encode(rows).withColumnRenamed("code", "codes"), "codes", "code", None)


@query(f"WITH {RANGE}, {sql_code(255)} SELECT id, CAST(unnest(range(len(code))) AS INTEGER) AS pos, round(unnest(list_transform(code, lambda x: lo + x * step)), 6) AS value FROM c")
def sq8_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    sq = _sq(rows, 255)
    return listed(sq.decode(sq.encode(rows)), "vec", "value")


def sql_mse(levels: int) -> str:
    d = sql_l2("v", "list_transform(code, lambda x: lo + x * step)")
    return f"WITH {RANGE}, {sql_code(levels)} SELECT round(sum({d}) / sum(len(v)), 10) AS mse FROM c"


def _mse(levels: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = unit_rows(spark, sf)
        sq = _sq(rows, levels)
        return rounded(mean_squared_error(rows, sq.decode(sq.encode(rows))), "mse", places=10)

    run.__name__ = f"sq{8 if levels == 255 else 4}_mse"
    return run


query(sql_mse(255))(_mse(255))
query(sql_mse(15))(_mse(15))


def _integer(name: str, f: Callable[[Column, Column], Column]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = unit_rows(spark, sf)
        codes = _sq(rows, 255).encode(rows)
        q = F.array(*(F.lit(x) for x in codes.where(F.col("id") == ONE).first()["code"]))
        return codes.select("id", f(F.col("code"), q).alias("distance"))

    run.__name__ = name
    return run


query(f"WITH {RANGE}, {sql_code(255)} SELECT c.id, CAST({sql_l2('c.code', 'q.code')} AS BIGINT) AS distance FROM c, c q WHERE q.id = {ONE}")(_integer("sq8_int_l2", V.integer_l2))
query(f"WITH {RANGE}, {sql_code(255)} SELECT c.id, CAST(list_sum(list_transform(list_zip(c.code, q.code), lambda t: t[1] * t[2])) AS BIGINT) AS distance FROM c, c q WHERE q.id = {ONE}")(
    _integer("sq8_int_ip", V.integer_ip)
)


@query(f"WITH {RANGE}, {sql_code(15)} SELECT id, array_to_string(list_transform(range(1, len(code) + 1, 2), lambda i: code[i] + 16 * coalesce(code[i + 1], 0)), ',') AS bytes FROM c")
def sq4_pack(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    return _sq(rows, 15).encode(rows).select("id", text(F.col("code")).alias("bytes"))


SQ4_DISTANCE = sql_l2("list_transform(c.code, lambda x: c.lo + x * c.step)", "q.v")


@query(f"WITH {RANGE}, {sql_code(15)} " + sql_top(f"SELECT q.id AS query_id, c.id, {SQ4_DISTANCE} AS distance FROM c, c q WHERE q.id % 20 = 0"))
def sq4_adc_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    sq = _sq(rows, 15)
    return rounded(coarse_scan(sq.encode(rows), asked(rows), sq, K), "distance")


@query(f"WITH {RANGE}, {sql_code(15)} SELECT c.id, round({SQ4_DISTANCE}, 6) AS distance FROM c, c q WHERE q.id = {ONE}")
def sq4_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    sq = _sq(rows, 15)
    q = F.array(*(F.lit(float(x)) for x in one(rows)))
    return sq.encode(rows).select("id", F.round(sq.distance(q, F.col("code")), 6).alias("distance"))


@query(
    f"WITH {RANGE}, {sql_code(15)}, near AS ({sql_top(f'SELECT q.id AS query_id, c.id, {SQ4_DISTANCE} AS distance FROM c, c q WHERE q.id % 20 = 0', 50)}) "
    + sql_top(f"SELECT near.query_id, near.id, {sql_l2('a.v', 'q.v')} AS distance FROM near JOIN c a ON a.id = near.id JOIN c q ON q.id = near.query_id")
)
def two_stage_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    return rounded(two_stage(rows, asked(rows), _sq(rows, 15), K, 50), "distance")


# signs
def sql_words(dim: int = 64) -> str:
    return """w AS (SELECT id, v, list_transform(range((len(v) + 63) // 64), lambda k: (lambda_sum)) AS words FROM v)""".replace(
        "lambda_sum",
        "list_sum(list_transform(range(64), lambda i: CASE WHEN v[64 * k + i + 1] >= 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE 1::HUGEINT << i::INTEGER END)::HUGEINT ELSE 0::HUGEINT END))::BIGINT",
    )


SIGNS = "s AS (SELECT id, v, list_transform(v, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM v)"


@query(f"WITH {VS}, {sql_words()} SELECT id, array_to_string(words, ',') AS words FROM w")
def bq_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    return BinaryQuantizer(dim_of(rows)).encode(rows).select("id", text(F.col("words")).alias("words"))


@query(f"WITH {VS}, {SIGNS} SELECT id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS value FROM s")
def bq_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    bq = BinaryQuantizer(dim_of(rows))
    return listed(bq.decode(bq.encode(rows)), "vec", "value", None)


@query(f"WITH {VS}, {SIGNS} SELECT s.id, CAST(len(list_filter(list_zip(s.s, q.s), lambda t: t[1] <> t[2])) AS INTEGER) AS distance FROM s, s q WHERE q.id = {ONE}")
def bq_hamming(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    codes = BinaryQuantizer(dim_of(rows)).encode(rows)
    q = F.array(*(F.lit(x) for x in codes.where(F.col("id") == ONE).first()["words"]))
    return codes.select("id", V.hamming(F.col("words"), q).cast("int").alias("distance"))


@query(f"WITH {VS}, {SIGNS} " + sql_top("SELECT q.id AS query_id, s.id, CAST(len(list_filter(list_zip(s.s, q.s), lambda t: t[1] <> t[2])) AS DOUBLE) AS distance FROM s, s q WHERE q.id % 20 = 0"))
def bq_hamming_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    bq = BinaryQuantizer(dim_of(rows))
    codes = bq.encode(rows)
    return bq.nearest_codes(codes, codes.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), K)


BQ_TOP = sql_top("SELECT q.id AS query_id, s.id, -list_inner_product(q.v, s.s) AS distance FROM s, s q WHERE q.id % 20 = 0")


@query(f"WITH {VS}, {SIGNS} {BQ_TOP}")
def bq_asym_ip_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    bq = BinaryQuantizer(dim_of(rows))
    return rounded(bq.search(bq.encode(rows), asked(rows), K), "distance")


@query(f"WITH {VS}, {SIGNS} SELECT s.id, round(list_inner_product(q.v, s.s), 6) AS value FROM s, s q WHERE q.id = {ONE}")
def bq_asym_ip(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    dim = dim_of(rows)
    q = F.array(*(F.lit(x) for x in one(rows)))
    return BinaryQuantizer(dim).encode(rows).select("id", F.round(V.sign_inner_product(q, F.col("words"), dim), 6).alias("value"))


# measures: signs against exact inner products
MEASURED = f"""WITH {VS}, {SIGNS}, truth AS ({sql_top("SELECT q.id AS query_id, v.id, -list_inner_product(v.v, q.v) AS distance FROM v q, v WHERE q.id % 20 = 0")}),
found AS ({BQ_TOP}), hit AS (SELECT f.query_id, f.rank, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS nth FROM found f JOIN truth t ON f.query_id = t.query_id AND f.id = t.id),
m AS (SELECT q.query_id, coalesce(count(h.rank) / {K}.0::DOUBLE, 0) AS recall, coalesce(1.0::DOUBLE / min(h.rank), 0) AS reciprocal_rank,
  coalesce(sum(1 / log2(h.rank + 1)), 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, {K + 1}) t(r)) AS ndcg, coalesce(sum(h.nth::DOUBLE / h.rank), 0) / {K} AS average_precision
  FROM (SELECT DISTINCT query_id FROM truth) q LEFT JOIN hit h ON q.query_id = h.query_id GROUP BY q.query_id)"""


def _measured(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = scaled(spark, sf)
    bq = BinaryQuantizer(dim_of(rows))
    return batch_linear_scan(rows, asked(rows), K, metric="ip"), bq.search(bq.encode(rows), asked(rows), K)


@query(MEASURED + " SELECT query_id, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, round(average_precision, 6) AS average_precision FROM m")
def ir_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(per_query(*_measured(spark, sf), K), "recall", "reciprocal_rank", "ndcg", "average_precision")


@query(MEASURED + " SELECT round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS mean_ndcg, round(avg(average_precision), 6) AS map FROM m")
def ir_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(means(*_measured(spark, sf), K), "mean_recall", "mrr", "mean_ndcg", "map")


# inverted lists
FIRST = f"""f AS (SELECT row_number() OVER (ORDER BY (id * 2654435761 + 42) % 4294967296, id) - 1 AS l, v FROM v QUALIFY l < {NLIST}),
a AS (SELECT v.id, any_value(v.v) AS v, min({{'d': {sql_l2('v.v', 'f.v')}, 'l': l}}).l AS l FROM v, f GROUP BY v.id),
c AS (SELECT l, list(x ORDER BY pos) AS v FROM (SELECT l, pos, avg(x) AS x FROM (SELECT l, unnest(range(len(v))) AS pos, unnest(v) AS x FROM a) GROUP BY l, pos) GROUP BY l)"""
POSTED = f"p AS (SELECT v.id, any_value(v.v) AS v, min({{'d': {sql_l2('v.v', 'c.v')}, 'l': l}}).l AS l FROM v, c GROUP BY v.id)"


@query(f"WITH {VS}, {FIRST} SELECT id, CAST(l AS INTEGER) AS list_id FROM a")
def ivf_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    return kmeans.assign(rows, kmeans.first_rows(rows, NLIST, 42)).select("id", "list_id")


@query(f"WITH {VS}, {FIRST} SELECT CAST(l AS INTEGER) AS list_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, round(unnest(v), 6) AS value FROM c")
def ivf_train_iter(spark: SparkSession, sf: str) -> DataFrame:
    got = kmeans.train(scaled(spark, sf), NLIST, rounds=1)
    flat = [(j, d, float(x)) for j, c in enumerate(got) for d, x in enumerate(c)]
    return rounded(spark.createDataFrame(flat, "list_id int, pos int, value double"), "value")


def _ivf(spark: SparkSession, sf: str, stored: str = "float") -> tuple[IvfFlatIndex, DataFrame]:
    rows = scaled(spark, sf)
    return IvfFlatIndex(spark, dim_of(rows), NLIST, stored=stored).train(rows, rounds=1).add(rows), rows


@query(
    f"WITH {VS}, {FIRST}, {POSTED}, r AS (SELECT q.id AS query_id, q.v AS q, c.l FROM v q, c WHERE q.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {sql_l2('c.v', 'q.v')}, c.l) <= 3) "
    + sql_top(f"SELECT query_id, p.id, {sql_l2('CAST(CAST(p.v AS FLOAT[]) AS DOUBLE[])', 'r.q')} AS distance FROM r JOIN p ON p.l = r.l").replace("round(distance, 6)", "round(distance, 4)")
)
def ivf_search_nprobe(spark: SparkSession, sf: str) -> DataFrame:
    index, rows = _ivf(spark, sf)
    return rounded(index.batch_search(asked(rows), K, 3), "distance", places=4)


@query(sql_knn("l2").replace("round(distance, 6)", "round(distance, 4)"))
def ivf_full_probe(spark: SparkSession, sf: str) -> DataFrame:
    index, rows = _ivf(spark, sf, "double")  # the SQL measures unrounded components
    return rounded(index.batch_search(asked(rows), K, NLIST), "distance", places=4)


@query(
    f"WITH {VS}, {FIRST}, {POSTED}, n AS (SELECT c.l, count(p.id) AS n FROM c LEFT JOIN p ON p.l = c.l GROUP BY c.l) SELECT CAST(sum(n) AS BIGINT) AS total, min(n) AS min_size, max(n) AS max_size, avg(n) AS mean_size, "
    "list_sort(list(n))[count(*) // 2 + 1] AS median_size, round(stddev_pop(n), 6) AS stddev_size, CAST(count(*) FILTER (n = 0) AS BIGINT) AS empty_lists FROM n"
)
def ivf_list_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ivf(spark, sf)[0].list_stats(), "stddev_size")


# product quantizer and four-bit scan
def sql_pq(m: int, sub: int) -> str:
    return f"""b AS (SELECT m, c, v[m * {sub} + 1 : m * {sub} + {sub}] AS x FROM (SELECT row_number() OVER (ORDER BY (id * 2654435761 + 1337) % 4294967296, id) - 1 AS c, v FROM v QUALIFY c < {BOOK}), range({m}) t(m)),
t AS (SELECT v.id, b.m, b.c, {sql_l2(f'v.v[b.m * {sub} + 1 : b.m * {sub} + {sub}]', 'b.x')} AS d FROM v, b),
e AS (SELECT id, m, min({{'d': d, 'c': c}}).c AS c FROM t GROUP BY id, m)"""


def _pq(spark: SparkSession, sf: str, m: int, rounds: int = 0) -> tuple[ProductQuantizer, DataFrame]:
    rows = scaled(spark, sf)
    return ProductQuantizer(spark, dim_of(rows), m, BOOK).train(rows, rounds), rows


@query(
    f"WITH {VS}, {sql_pq(M, 8)}, n AS (SELECT m, c, pos, avg(x) AS x FROM (SELECT e.m, e.c, unnest(range(8)) AS pos, unnest(v[e.m * 8 + 1 : e.m * 8 + 8]) AS x FROM e JOIN v USING (id)) GROUP BY ALL) "
    "SELECT CAST(m AS INTEGER) AS m, CAST(c AS INTEGER) AS c, CAST(pos AS INTEGER) AS pos, round(x, 6) AS value FROM n"
)
def pq_train_iter(spark: SparkSession, sf: str) -> DataFrame:
    return listed(_pq(spark, sf, M, 1)[0].codebook(), "centroid", "value")


@query(f"WITH {VS}, {sql_pq(M, 8)} SELECT id, CAST(m AS INTEGER) AS pos, CAST(c AS SMALLINT) AS code FROM e")
def pq_encode(spark: SparkSession, sf: str) -> DataFrame:
    pq, rows = _pq(spark, sf, M)
    return listed(pq.encode(rows).withColumnRenamed("code", "codes"), "codes", "code", None)


@query(f"WITH {VS}, {sql_pq(M, 8)} SELECT round(sum(d) / (count(DISTINCT id) * {M * 8}), 6) AS mse FROM (SELECT id, m, min(d) AS d FROM t GROUP BY id, m)")
def pq_decode_mse(spark: SparkSession, sf: str) -> DataFrame:
    pq, rows = _pq(spark, sf, M)
    return rounded(mean_squared_error(rows, pq.decode(pq.encode(rows))), "mse")


@query(f"WITH {VS}, {sql_pq(M, 8)} SELECT id AS query_id, CAST(m * {BOOK} + c AS INTEGER) AS pos, round(d, 6) AS value FROM t WHERE id % 20 = 0")
def pq_lut(spark: SparkSession, sf: str) -> DataFrame:
    pq, rows = _pq(spark, sf, M)
    return listed(pq.query_tables(asked(rows)), "lut", "value")


@query(f"WITH {VS}, {sql_pq(M, 8)} " + sql_top("SELECT t.id AS query_id, e.id, sum(t.d) AS distance FROM t JOIN e ON t.m = e.m AND t.c = e.c WHERE t.id % 20 = 0 GROUP BY t.id, e.id").replace("ORDER BY distance, id", "ORDER BY round(distance, 9), id"))
def pq_adc_topk(spark: SparkSession, sf: str) -> DataFrame:
    pq, rows = _pq(spark, sf, M)
    return rounded(pq.search(pq.encode(rows), asked(rows), K), "distance")


FS = f"WITH {VS}, {sql_pq(16, 4)}"
FS_LUT = "r AS (SELECT id, min(d) AS lo, max(d) AS hi FROM t GROUP BY id), u AS (SELECT id, m, c, CASE WHEN hi - lo < 1e-7 THEN 0 ELSE CAST(floor((d - lo) * 255 / (hi - lo) + 0.5) AS INTEGER) END AS d FROM t JOIN r USING (id))"


def _fs(spark: SparkSession, sf: str) -> tuple[FastScan, ProductQuantizer, DataFrame]:
    pq, rows = _pq(spark, sf, 16)
    return FastScan(pq.dim, 16), pq, rows


@query(
    FS + ", g AS (SELECT id // 32 AS block, m, id % 32 % 16 AS j, CAST(sum(CASE WHEN id % 32 >= 16 THEN c * 16 ELSE c END) AS INTEGER) AS v FROM e GROUP BY ALL), "
    "k AS (SELECT DISTINCT block, m FROM g), h AS (SELECT k.block, k.m, j.j, coalesce(g.v, 0) AS v FROM k CROSS JOIN range(16) j(j) LEFT JOIN g ON g.block = k.block AND g.m = k.m AND g.j = j.j) "
    "SELECT CAST(block AS BIGINT) AS block, CAST(m AS INTEGER) AS m, array_to_string(list(v ORDER BY j), ',') AS bytes FROM h GROUP BY block, m"
)
def fastscan_pack(spark: SparkSession, sf: str) -> DataFrame:
    fs, pq, rows = _fs(spark, sf)
    return fs.pack(pq.encode(rows)).select("block", "m", text(F.col("bytes")).alias("bytes"))


@query(FS + f", {FS_LUT} SELECT id AS query_id, CAST(m * 16 + c AS INTEGER) AS pos, d AS value FROM u WHERE id % 20 = 0")
def fastscan_lut(spark: SparkSession, sf: str) -> DataFrame:
    fs, pq, rows = _fs(spark, sf)
    return listed(fs.byte_tables(pq.query_tables(asked(rows))), "lut", "value", None)


@query(FS + f", {FS_LUT} " + sql_top("SELECT u.id AS query_id, e.id, CAST(sum(u.d) % 65536 AS DOUBLE) AS distance FROM u JOIN e ON u.m = e.m AND u.c = e.c WHERE u.id % 20 = 0 GROUP BY u.id, e.id"))
def fastscan_topk(spark: SparkSession, sf: str) -> DataFrame:
    fs, pq, rows = _fs(spark, sf)
    return fs.search(fs.store(pq.encode(rows)), fs.byte_tables(pq.query_tables(asked(rows))), K)


@query(
    FS + ", y AS (SELECT id, list(c ORDER BY m) AS c FROM e GROUP BY id) SELECT id, array_to_string(list_concat(list_transform(range(1, 17, 2), lambda i: 10 * c[i]), list_transform(range(2, 17, 2), lambda i: 10 * c[i])), ',') AS got FROM y"
)
def fastscan_lookup(spark: SparkSession, sf: str) -> DataFrame:
    _, pq, rows = _fs(spark, sf)
    packed = V.pack_nibbles(F.col("code").cast("array<int>"), 16)
    lut = F.array(*(F.lit(10 * i) for i in range(16)))
    return pq.encode(rows).select("id", text(V.lookup_nibbles(lut, packed)).alias("got"))


# trees
TREES = TreeParams(num_trees=4, leaf_max_size=16)


@query(
    "WITH RECURSIVE h AS (SELECT 0 AS level, count(*) AS n FROM embeddings UNION ALL SELECT level + 1, unnest([n // 2, n - n // 2]) FROM h WHERE n > 16) "
    "SELECT CAST(0 AS BIGINT) AS shard, CAST(t AS INTEGER) AS tree, CAST(n AS INTEGER) AS size, CAST(count(*) AS INTEGER) AS leaves FROM h, range(4) t(t) WHERE n <= 16 GROUP BY t, n"
)
def kd_leaf_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return KdForest(scaled(spark, sf), TREES).leaf_sizes()


@query(sql_knn("ip"))
def kd_search_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    return rounded(KdForest(rows, TREES).batch_search(asked(rows), K, SearchParams(1 << 30, "ip")), "distance")


@query()
def kd_search_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf)
    return rounded(KdForest(rows, TREES).batch_search(asked(rows), K, SearchParams(128)), "distance")


# files and the shape of the data
def _round_trip(kind: str, value: Callable[[Column], Column], cast: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        import tempfile
        import uuid

        at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
        path = f"{at.rstrip('/')}/{uuid.uuid4().hex}.{kind}"
        rows = unit_rows(spark, sf).select("id", F.transform("vec", value).alias("vec"))
        vecs.write_vecs(rows, path)
        return listed(vecs.read_vecs(spark, path), "vec", "value", None).select("id", "pos", F.col("value").cast(cast).alias("value"))

    run.__name__ = f"{kind}_round_trip"
    return run


def sql_round_trip(value: str) -> str:
    return f"SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: {value})) AS value FROM embeddings"


query(sql_round_trip("x"))(_round_trip("fvecs", lambda x: x, "double"))
query(sql_round_trip("CAST(floor((x + 1) * 127) AS INTEGER)"))(_round_trip("bvecs", lambda x: F.floor((x.cast("double") + 1) * 127).cast("smallint"), "int"))
query(sql_round_trip("CAST(floor(x * 1000000) AS INTEGER)"))(_round_trip("ivecs", lambda x: F.floor(x.cast("double") * 1000000).cast("int"), "int"))


@query(
    "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, max(vec_id) OVER () + 1 AS n FROM embeddings) SELECT a.id, b.id AS other, "
    "round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS cosine FROM (SELECT * FROM v QUALIFY row_number() OVER (ORDER BY (id * 2654435761 + 42) % 4294967296, id) <= 10000) a JOIN v b ON b.id = (a.id + 7) % a.n"
)
def pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pair_cosines(unit_rows(spark, sf), 7), "cosine")


@query()
def anisotropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry(unit_rows(spark, sf)), "mean_cosine", "std_cosine", "top_share")


@query(f"SELECT round(avg(cosine), 6) AS mean_cosine, round(stddev_pop(cosine), 6) AS std_cosine FROM ({ORACLE['pair_cosine'].replace('round(list', '(list').replace(', 6) AS cosine', ') AS cosine')})")
def cosine_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pair_cosines(unit_rows(spark, sf), 7).agg(F.avg("cosine").alias("mean_cosine"), F.stddev_pop("cosine").alias("std_cosine")), "mean_cosine", "std_cosine")


# a search with misses: found has no rows for queries divisible by 40
@query(
    MEASURED.replace("SELECT f.query_id, f.rank", "SELECT f.query_id, f.rank").replace("AND t.id = f.id", "").replace("AND f.id = t.id)", "AND f.id = t.id WHERE f.query_id % 40 <> 0)")
    + " SELECT round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS mean_ndcg, round(avg(average_precision), 6) AS map FROM m"
)
def ir_means_with_misses(spark: SparkSession, sf: str) -> DataFrame:
    truth, found = _measured(spark, sf)
    return rounded(means(truth, found.where(F.col("query_id") % 40 != 0), K, truth.select("query_id").distinct().count()), "mean_recall", "mrr", "mean_ndcg", "map")


@query(f"WITH {VS}, {SIGNS}, found AS ({BQ_TOP}) SELECT query_id, coalesce(1.0::DOUBLE / min(CASE WHEN id = {ONE} THEN rank END), 0.0::DOUBLE) AS reciprocal_rank FROM found GROUP BY query_id")
def rr_of_one(spark: SparkSession, sf: str) -> DataFrame:
    return reciprocal_rank_of(_measured(spark, sf)[1], ONE)


@query(f"WITH {VS}, {sql_pq(M, 8)}, g AS (SELECT id, round(sum(d), 6) AS distance FROM (SELECT id, m, min(d) AS d FROM t GROUP BY id, m) GROUP BY id) SELECT id AS query_id, id, distance FROM g WHERE id % 20 = 0")
def pq_direct(spark: SparkSession, sf: str) -> DataFrame:
    pq, rows = _pq(spark, sf, M)
    return rounded(pq.distance(asked(rows).withColumn("id", F.col("query_id")), pq.encode(rows)), "distance")


@query(f"WITH {RANGE}, {sql_code(255)} SELECT id, CAST(unnest(range(len(code))) AS INTEGER) AS pos, round(unnest(list_transform(code, lambda x: lo + x * step)), 6) AS value FROM c WHERE id BETWEEN 100 AND 131")
def sq8_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = unit_rows(spark, sf)
    sq = _sq(rows, 255)
    return listed(sq.rows_of(sq.encode(rows), 100, 132), "vec", "value")


@query("SELECT kind, 8 AS dim, 100 AS count FROM (VALUES ('fvecs'), ('bvecs'), ('ivecs'), ('cone')) t(kind)")
def generators(spark: SparkSession, sf: str) -> DataFrame:
    made = [vecs.random_vectors(spark, 100, 8, k).select(F.lit(k).alias("kind"), F.size("vec").alias("dim")) for k in vecs.KINDS]
    made.append(vecs.cone(spark, 100, 8, 3.0).select(F.lit("cone").alias("kind"), F.size("vec").alias("dim")))
    out = made[0]
    for df in made[1:]:
        out = out.union(df)
    return out.groupBy("kind", "dim").count()
