import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import blocks, kmeans
from vectide.operators.binary import BinaryQuantizer
from vectide.operators.fastscan import FastScan
from vectide.operators.flat import FlatIndex, batch_linear_scan, linear_scan, linear_scan_vectors
from vectide.operators.ivf import IvfFlatIndex
from vectide.operators.kdforest import KdForest, SearchParams, TreeParams
from vectide.operators.measures import geometry, means, per_query, reciprocal_rank_of
from vectide.operators.product import ProductQuantizer
from vectide.operators.scalar import ScalarQuantizer, mean_squared_error, two_stage
from vectide.sources import vecs
from vectide.streaming.append import append_postings


def rows_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")


def queries_of(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "query_id bigint, vec array<float>")


def first_ids(df):
    return {r.query_id: r.id for r in df.where("rank = 1").collect()}


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_distances_by_hand(spark):
    a, b, z = lit((1, 2, 3)), lit((4, 5, 6)), lit((0, 0, 0))
    assert value(spark, V.l2_squared(a, b)) == 27 and value(spark, V.l2_squared(a, a)) == 0
    assert value(spark, V.inner_product(a, b)) == 32 and value(spark, V.inner_product(a, lit((-1, -2, -3)))) == -14
    assert value(spark, V.distance("dot", a, b)) == -32 and value(spark, V.distance("no such", a, b)) == 27
    for other, want in ((a, 0), (lit((2, 4, 6)), 0), (lit((-1, -2, -3)), 2), (lit((3, 0, -1)), 1)):
        assert abs(value(spark, V.cosine_distance(a, other)) - want) < 1e-9
    assert value(spark, V.cosine_distance(z, a)) == 0 and value(spark, V.cosine_distance(z, z)) == 0
    assert abs(value(spark, V.cosine_distance_fast(lit((1, 2, 3, 4)), lit((2, 1, 4, 3)))) - value(spark, V.cosine_distance(lit((1, 2, 3, 4)), lit((2, 1, 4, 3))))) < 0.005
    assert value(spark, V.integer_l2(F.array(*map(F.lit, (10, 20, 30))), F.array(*map(F.lit, (15, 25, 40))))) == 150
    assert value(spark, V.integer_l2(F.array_repeat(F.lit(0), 128), F.array_repeat(F.lit(255), 128))) == 8323200


def test_approximate_rsqrt():
    x = np.array([0.5, 1, 2, 4, 16, 100, 1024], np.float32)
    assert (np.abs(V.approximate_rsqrt(x) * np.sqrt(x) - 1) < 0.002).all()
    assert V.approximate_rsqrt(np.array([0.0, -1.0])).tolist() == [0, 0]


def test_normalize(spark):
    got = value(spark, V.normalize(lit((3, 4, 0, 0))))
    assert np.allclose(got, [0.6, 0.8, 0, 0]) and value(spark, V.normalize(lit((1e-9, 0)))) == [1e-9, 0]


def test_metric_ranking_and_defaults(spark):
    rows = rows_of(spark, [(1, 0), (0, 1), (2, 0)])
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(linear_scan(rows, (1, 0), 3, "ip")) == [2, 0, 1]
    assert ids(linear_scan(rows, (1, 0), 3)) == [0, 2, 1]
    assert ids(linear_scan_vectors(rows, (1, 0), 3)) == [0, 2, 1]
    assert ids(linear_scan(rows, (1, 0), 0)) == [] and ids(linear_scan(rows, (1, 0), 9)) == [0, 2, 1]
    with pytest.raises(Exception, match="dimension"):
        linear_scan(rows, (1, 0, 0), 1).collect()


def test_batch_equals_single(spark):
    x = np.array([[3 * i + d for d in range(32)] for i in range(300)], float)
    rows, pick = rows_of(spark, x), [5, 25, 75, 120, 210, 299]
    for metric in ("l2", "ip", "cosine"):
        got = ranked(batch_linear_scan(rows, queries_of(spark, x[pick], pick), 4, metric=metric))
        for i in pick[:2]:
            assert got[i] == [r.id for r in linear_scan(rows, x[i], 4, metric).orderBy("rank").collect()]
    assert first_ids(batch_linear_scan(rows, queries_of(spark, x[pick], pick), 4, tile_size=64)) == {i: i for i in pick}
    with pytest.raises(ValueError):
        batch_linear_scan(rows, queries_of(spark, x[pick], pick), 4, tile_size=0)


def test_flat_index(spark):
    eye = np.eye(4)
    index = FlatIndex(spark, 4).add(rows_of(spark, eye, 1001))
    hit = index.search(eye[2], 2).orderBy("rank").first()
    assert hit.id == 1003 and hit.distance == 0 and index.get(1003) == list(eye[2]) and index.size() == 4
    index.add(rows_of(spark, eye).select("vec"), ids=False)
    assert index.size() == 8 and index.get(7) is not None
    index.reset()
    assert index.empty()
    for bad in (lambda: FlatIndex(spark, 0), lambda: index.add(rows_of(spark, np.eye(3))), lambda: index.search([1.0], 1)):
        with pytest.raises(ValueError):
            bad()


def test_ivf(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 32))
    rows, asked = rows_of(spark, x), queries_of(spark, x[:10])
    for metric in ("l2", "ip"):
        index = IvfFlatIndex(spark, 32, 8, metric)
        with pytest.raises(RuntimeError):
            index.add(rows)
        index.train(rows, rounds=3).add(rows)
        assert ranked(index.batch_search(asked, 5, 8)) == ranked(batch_linear_scan(rows, asked, 5, metric=metric))
        assert index.total_vectors() == 200 and index.list_stats().first().total == 200
        assert index.batch_search(asked, 0, 8).count() == 0
    with pytest.raises(ValueError):
        IvfFlatIndex(spark, 32, 300).train(rows)


def test_kmeans_reseeds_and_stays_on_the_sphere(spark):
    x = [[(-100, -50, 50, 100)[i // 10] + (i % 3) * 0.1] * 2 for i in range(40)]
    rows = rows_of(spark, x)
    index = IvfFlatIndex(spark, 2, 4).train(rows).add(rows)
    stats = index.list_stats().first()
    assert stats.empty_lists == 0 and stats.max_size <= 20
    y = rows_of(spark, np.random.default_rng(2).uniform(2, 10, (40, 16)))
    c = kmeans.train(y, 4, "cosine", 4)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-9)
    same = rows_of(spark, [[1.0, 1.0]] * 5 + [[9.0, 9.0]])
    moved = kmeans.step(same, np.array([[1.0, 1.0], [50.0, 50.0], [60.0, 60.0]]))
    assert moved[1].tolist() == [9, 9] and moved[2].tolist() == [1, 1]


def test_kd_forest(spark, tmp_path):
    x = np.array([[(7 * i + 13 * d) * 0.01 for d in range(16)] for i in range(1000)])
    rows, pick = rows_of(spark, x), [0, 100, 500, 999]
    forest = KdForest(rows, TreeParams(4, 16))
    assert first_ids(forest.batch_search(queries_of(spark, x[pick], pick), 5, SearchParams(512))) == {i: i for i in pick}
    assert (forest.size(), forest.dim(), forest.num_trees) == (1000, 16, 4)
    assert forest.search(x[100], 1, SearchParams(512)).first().id == 100
    with pytest.raises(ValueError):
        forest.search([1.0], 1)
    y = np.array([[(19 * (i * 8 + d) % 251) * 0.05 for d in range(8)] for i in range(500)])
    q = np.array([[(23 * d % 100) * 0.05 for d in range(8)]])
    rows, asked = rows_of(spark, y), queries_of(spark, q)
    exact = set(ranked(batch_linear_scan(rows, asked, 10))[0])
    assert len(exact & set(ranked(KdForest(rows, TreeParams(4, 8)).batch_search(asked, 10, SearchParams(500)))[0])) >= 9
    parts = KdForest(rows, TreeParams(2, 8, shard_rows=100))
    assert set(ranked(parts.batch_search(asked, 10, SearchParams(500)))[0]) == exact
    for forest in (parts, KdForest(rows, TreeParams(3, 8))):
        forest.save(str(tmp_path / "forest"))
        kept = KdForest.load(spark, str(tmp_path / "forest"))
        for checks in (40, 500):
            assert kept.batch_search(asked, 10, SearchParams(checks)).collect() == forest.batch_search(asked, 10, SearchParams(checks)).collect()
        assert (kept.size(), kept.dim(), kept.num_trees) == (500, 8, forest.num_trees)
        assert sorted(kept.leaf_sizes().collect()) == sorted(forest.leaf_sizes().collect())
    with pytest.raises(ValueError):
        TreeParams(leaf_max_size=0)


def test_scalar_quantizer(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 3, (500, 16))
    rows = rows_of(spark, x)
    for levels, odd in ((255, 0), (15, 0)):
        sq = ScalarQuantizer(16, levels)
        with pytest.raises(RuntimeError):
            sq.encode(rows)
        sq.train(rows, 0.0, 1.0)
        back = {r.id: r.vec for r in sq.decode(sq.encode(rows)).collect()}
        assert max(np.abs(np.array(back[i]) - np.float32(x[i])).max() for i in back) <= sq.step + 1e-4
        mse = mean_squared_error(rows, sq.decode(sq.encode(rows))).first().mse
        assert 0.8 < mse / (sq.step**2 / 12) < 1.2
    flat = ScalarQuantizer(4).train(rows_of(spark, [[5.0] * 4] * 10))
    assert flat.lo == 5 and flat.hi > 5
    clipped = np.vstack([[1000, -1000] + [0] * 8, rng.uniform(-1, 1, (999, 10))])
    sq = ScalarQuantizer(10).train(rows_of(spark, clipped))
    assert abs(sq.lo + 1) < 0.05 and abs(sq.hi - 1) < 0.05
    odd = ScalarQuantizer(5, 15).train(rows_of(spark, x[:, :5]))
    code = odd.encode(rows_of(spark, x[:3, :5])).first().code
    assert len(code) == 3 and code[2] < 16
    with pytest.raises(ValueError):
        ScalarQuantizer(4).train(rows, 0.9, 0.1)
    with pytest.raises(ValueError):
        ScalarQuantizer(4).train(rows.limit(0))


def test_two_stage(spark):
    x = np.random.default_rng(4).standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, asked = rows_of(spark, x), queries_of(spark, x[:8])
    exact = ranked(batch_linear_scan(rows, asked, 10))
    got = ranked(two_stage(rows, asked, ScalarQuantizer(32, 15).train(rows), 10, 100))
    assert np.mean([len(set(got[q]) & set(exact[q])) / 10 for q in exact]) >= 0.95


def test_product_quantizer(spark):
    x = np.array([[((i * 32 + d) % 100) * 0.1 for d in range(32)] for i in range(300)])
    rows = rows_of(spark, x)
    pq = ProductQuantizer(spark, 32, 4, 16).train(rows, 3)
    codes = pq.encode(rows)
    assert mean_squared_error(rows, pq.decode(codes)).first().mse < 5
    q = np.array([[(d % 10) * 0.5 for d in range(32)]])
    hits = pq.search(codes, queries_of(spark, q), 300).collect()
    back = {r.id: np.array(r.vec) for r in pq.decode(codes).collect()}
    assert all(abs(h.distance - ((back[h.id] - q[0]) ** 2).sum()) < 1e-6 for h in hits)
    few = ProductQuantizer(spark, 32, 4, 16).train(rows_of(spark, x[:5]), 1)
    assert (few.books[:, 5:] == 0).all()
    for bad in ((32, 5), (32, 0)):
        with pytest.raises(ValueError):
            ProductQuantizer(spark, *bad)
    assert ProductQuantizer(spark, 32, 4).train(rows.limit(0)).books is None


def test_binary_quantizer(spark):
    alternating = [1.5 if d % 2 == 0 else -1.5 for d in range(128)]
    rows = rows_of(spark, [alternating, [1.0] * 128, [-1.0] * 128])
    bq = BinaryQuantizer(128)
    codes = bq.encode(rows)
    words = {r.id: r.words for r in codes.collect()}
    assert words[0] == [0x5555555555555555] * 2 and words[1] == [-1, -1] and words[2] == [0, 0]
    assert bq.decode(codes).where("id = 0").first().vec == [1.0 if v > 0 else -1.0 for v in alternating]
    far = codes.where("id = 1").select(F.col("words").alias("a")).crossJoin(codes.where("id = 2").select(F.col("words").alias("b")))
    assert far.select(V.hamming(F.col("a"), F.col("b")).alias("d")).first().d == 128
    q = np.random.default_rng(5).standard_normal(128)
    got = {r.id: r.v for r in codes.select("id", V.sign_inner_product(lit(q), F.col("words"), 128).alias("v")).collect()}
    assert abs(got[0] - (q * np.sign(alternating)).sum()) < 1e-9
    with pytest.raises(ValueError):
        BinaryQuantizer(0)


def test_fastscan(spark):
    assert FastScan(128, 16).sub == 8
    with pytest.raises(ValueError):
        FastScan(128, 7)
    rng = random.Random(6)
    code = [[rng.randrange(16) for _ in range(8)] for _ in range(67)]
    codes = spark.createDataFrame(list(enumerate(code)), "id bigint, code array<smallint>")
    fs = FastScan(64, 8)
    packed = {(r.block, r.m): r.bytes for r in fs.pack(codes).collect()}
    assert len(packed) == 3 * 8
    for i, c in enumerate(code):
        for m, v in enumerate(c):
            b = packed[(i // 32, m)][i % 16]
            assert (b >> 4 if i % 32 >= 16 else b & 15) == v
    lut = [float(rng.randrange(1000)) for _ in range(8 * 16)]
    tables = fs.byte_tables(spark.createDataFrame([(0, lut), (1, [2.0] * 128)], "query_id bigint, lut array<double>"))
    byte = {r.query_id: r.lut for r in tables.collect()}
    assert min(byte[0]) == 0 and max(byte[0]) == 255 and set(byte[1]) == {0}
    stored = fs.store(codes)
    assert {r.id: list(r.code) for r in fs.codes_of(stored).collect()} == dict(enumerate(code))
    wide = {r.block: (r.lanes, bytes(r.packed)) for r in stored.collect()}
    assert all(list(wide[b][1][m * 16 : m * 16 + 16]) == v for (b, m), v in packed.items())
    assert [wide[b][0] for b in range(3)] == [2**32 - 1, 2**32 - 1, 7]
    hits = {(h.query_id, h.id): h.distance for h in fs.search(stored, tables, 67).collect()}
    assert len(hits) == 2 * 67 and not fs.search(stored, tables, 0).count()
    assert all(hits[(0, i)] == sum(byte[0][m * 16 + v] for m, v in enumerate(c)) for i, c in enumerate(code))
    table = F.array(*(F.lit(10 * i) for i in range(16)))
    got = value(spark, V.lookup_nibbles(table, F.array(*(F.lit((i % 16) | (((15 - i) % 16) << 4)) for i in range(32)))))
    assert got == [10 * (i % 16) for i in range(32)] + [10 * ((15 - i) % 16) for i in range(32)]


def ranking(spark, lists):
    return spark.createDataFrame([(q, r + 1, i) for q, ids in lists.items() for r, i in enumerate(ids)], "query_id bigint, rank int, id bigint")


def test_measures(spark):
    truth = ranking(spark, {0: [10, 20, 30, 40, 50]})
    one = lambda ids, k=5: per_query(truth, ranking(spark, {0: ids}), k).first()
    assert one([10, 20, 30, 40, 50]).recall == 1 and one([10, 99, 30, 40, 88]).recall == 0.6 and one([1, 2, 3, 4, 5]).recall == 0
    assert one([20, 10, 99], 2).recall == 1 and one([10], 10).recall == 0.1
    single = ranking(spark, {0: [42]})
    for ids, want in (([42, 1], 1), ([1, 42], 0.5), ([1, 2, 3, 42], 0.25), ([1, 2], 0)):
        assert per_query(single, ranking(spark, {0: ids}), 1).first().reciprocal_rank == want
    three = ranking(spark, {0: [100, 200, 300]})
    near = per_query(three, ranking(spark, {0: [999, 100, 200]}), 3).first()
    assert 0 < near.ndcg < 1 and abs(near.average_precision - (1 / 2 + 2 / 3) / 3) < 1e-9
    assert abs(per_query(three, ranking(spark, {0: [100, 200, 300]}), 3).first().ndcg - 1) < 1e-12
    both = means(ranking(spark, {0: [10, 20], 1: [30, 40]}), ranking(spark, {0: [10, 20], 1: [30, 99]}), 2).first()
    assert both.mean_recall == 0.75 and both.mrr == 1
    # a query that finds nothing is an empty list and counts as 0; another number of lists than of queries gives 0
    truth, found = ranking(spark, {0: [10], 1: [30]}), ranking(spark, {0: [10]})
    assert tuple(means(truth, found, 1).first()) == tuple(means(truth, found, 1, 2).first()) == (0.5,) * 4
    assert tuple(means(truth, found, 1, 1).first()) == tuple(means(truth.limit(0), found, 1).first()) == (0,) * 4
    assert per_query(truth, found, 0).where("query_id = 0").first().reciprocal_rank == 1
    assert {r.query_id: r.reciprocal_rank for r in reciprocal_rank_of(ranking(spark, {0: [5, 42], 1: [7]}), 42).collect()} == {0: 0.5, 1: 0.0}


def test_geometry(spark):
    sphere = geometry(vecs.cone(spark, 800, 32)).first()
    cone = geometry(vecs.cone(spark, 800, 32, 20.0)).first()
    assert not sphere.is_anisotropic and abs(sphere.mean_cosine) < 0.05 and cone.is_anisotropic and cone.mean_cosine > 0.8


def test_files(spark, tmp_path):
    floats = [[1, 2, 3], [4.5, -5.5, 6.25], [0, 100, -100], [3.14159, 2.71828, 1.41421]]
    for kind, data in (("fvecs", floats), ("bvecs", [[0, 128, 255, 42], [1, 2, 3, 4], [250, 251, 252, 253]]), ("ivecs", [[10, 20], [-1, -5], [100000, 500000]])):
        path = str(tmp_path / f"x.{kind}")
        rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in reversed(list(enumerate(data)))], "id bigint, vec array<double>").repartition(3)
        vecs.write_vecs(rows, path)
        got = [list(r.vec) for r in vecs.read_vecs(spark, path).orderBy("id").collect()]
        assert np.allclose(np.array(got, np.float32), np.array(data, np.float32), atol=0)
        assert all(vecs.read_row(spark, path, i).tolist() == got[i] for i in range(len(data)))
        with pytest.raises(IndexError):
            vecs.read_row(spark, path, len(data))
    with pytest.raises(FileNotFoundError):
        vecs.read_vecs(spark, str(tmp_path / "no.fvecs"))
    short = tmp_path / "short.fvecs"
    short.write_bytes(struct.pack("<i", 128) + b"\0" * 40)
    with pytest.raises(ValueError):
        vecs.read_vecs(spark, str(short))
    mixed = tmp_path / "mixed.fvecs"
    mixed.write_bytes(struct.pack("<i2f", 2, 1, 2) + struct.pack("<i2f", 3, 1, 2))
    with pytest.raises(Exception, match="length"):
        vecs.read_vecs(spark, str(mixed)).collect()
    assert math.prod((3, 4)) == vecs.uniform(spark, 1.0, 2.0, (3, 4)).where("value between 1 and 2").count()


def test_stream_appends_postings(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((40, 4))
    rows = rows_of(spark, x)
    index = IvfFlatIndex(spark, 4, 4).train(rows, rounds=2).add(rows)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_postings(stream, index, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {(r.list_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.list_id, r.id) for r in index.postings.collect()}


def test_queries_that_are_sent_and_dealt_give_the_same(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda d: ((F.col("id") * 7 + d * 13) % 101).cast("float")).alias("vec")).repartition(3)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")
    index = IvfFlatIndex(spark, 16, 4).train(rows, 2).add(rows)
    search = lambda: [sorted(map(tuple, df.collect())) for df in (batch_linear_scan(rows, asked, 7), index.batch_search(asked, 7, 2))]
    sent = search()
    monkeypatch.setattr(blocks, "SENT", 0)
    assert search() == sent and len(sent[0]) == 210
    assert batch_linear_scan(rows, asked.limit(0), 7).collect() == batch_linear_scan(rows.limit(0), asked, 7).collect() == []
    odd = rows.unionByName(spark.createDataFrame([(9000, [1.0])], "id long, vec array<float>"))
    with pytest.raises(Exception, match="several lengths"):
        batch_linear_scan(odd.coalesce(1), asked, 7).collect()
