"""Queries on tables that are laid out or repeated as larger ones are, against their SQL."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from vectide.operators import halves
from vectide.operators.kdforest import KdForest, SearchParams, TreeParams
from vectide.plans.queries import ORACLE, QUERIES, scaled

GIVEN = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture
def one_group(spark, tmp_path):
    """A folder whose table is one row group in several splits, so that most tasks get no rows."""
    pq.write_table(pq.read_table(GIVEN), tmp_path / "embeddings.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    assert spark.read.parquet(f"{tmp_path}/embeddings.parquet").rdd.getNumPartitions() > 4
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def differs(spark, folder, name):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        want = db.sql(ORACLE[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    return sorted(set(got) ^ set(want)) or (len(got) != len(want))


def test_ivf_train_with_tasks_without_rows(spark, one_group):
    assert not differs(spark, one_group, "ivf_train_iter")


def test_list_stats_with_tasks_without_rows(spark, one_group):
    assert not differs(spark, one_group, "ivf_list_stats")


def test_product_training_with_tasks_without_rows(spark, one_group):
    assert not differs(spark, one_group, "pq_train_iter")


def test_leaf_sizes_of_a_forest_in_shards(spark, tmp_path):
    pq.write_table(pq.read_table(GIVEN), tmp_path / "embeddings.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        want = sorted(db.sql(ORACLE["kd_leaf_sizes"]).fetchall())
    forest = KdForest(scaled(spark, str(tmp_path)), TreeParams(num_trees=4, leaf_max_size=16, shard_rows=60))
    assert forest.shards > 4 and sorted(tuple(r) for r in forest.leaf_sizes().collect()) == want


def test_halves_with_ties(spark, monkeypatch):
    monkeypatch.setattr(halves, "FETCHED", 64)  # so that ranges are narrowed in several passes
    for x, ids in ((np.arange(600)[:, None] % 2 * [1.0, 2.0], range(600)), (np.ones((300, 2)), [(-1) ** i * (2**62 + i) for i in range(300)]), (np.ones((300, 2)), [7] * 300)):
        rows = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id bigint, vec array<double>")
        size, left = halves.outline(len(x), 150)
        got = KdForest(rows, TreeParams(2, 8, shard_rows=150)).parts().groupBy("shard").count().collect()
        assert sorted(r["count"] for r in got) == sorted(size[left < 0])


def test_whole_budget_needs_no_walk_and_equal_rows_go_by_id(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    x = np.tile(rng.standard_normal((150, 24)), (3, 1))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vec array<double>")
    asked = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    forest = KdForest(rows, TreeParams(2, 8, shard_rows=200))
    forest.save(str(tmp_path / "forest"))
    for metric in ("l2", "ip", "cosine"):
        d = {"l2": ((x[:, None] - x[None]) ** 2).sum(axis=2), "ip": -(x @ x.T), "cosine": -(x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)}[metric]
        want = {(i, n + 1, int(r)) for i in range(0, 450, 9) for n, r in enumerate(np.lexsort((np.arange(450), d[i].round(9)))[:7])}
        for searched in (forest, KdForest.load(spark, str(tmp_path / "forest"))):
            found = searched.batch_search(asked, 7, SearchParams(450, metric))
            assert {(r.query_id, r.rank, r.id) for r in found.collect()} == want
    capsys.readouterr()
    forest.batch_search(asked, 7, SearchParams(450)).explain()
    assert "CoGroup" not in capsys.readouterr().out


def test_full_probe_with_tasks_without_rows(spark, one_group):
    assert not differs(spark, one_group, "ivf_full_probe")


def test_search_with_tasks_without_rows(spark, one_group):
    assert not differs(spark, one_group, "ivf_search_nprobe")
