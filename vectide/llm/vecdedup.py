"""Near-duplicate vectors over a robust-pruned flat graph that is built on overlapping cluster shards."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import components, drop, save

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Params:
    """cosine: least similarity of a link. overlap: nearest clusters that a vector joins. size: wanted rows in a shard.

    cap: a larger shard is dealt as blocks of two of its parts. sample: rows the cluster centres are fitted on at most.
    centres: most clusters (their table is sent to every worker). near, far: candidates for a row's edges, the nearest in the
    shard and as many spread ones. degree: edges kept of a row, alpha: how much closer an edge's end must be for it to stand in
    for another. beam: width of the search. audits: rows of a shard searched by brute force as well; recall: least share of
    links that the search must find of theirs, or else the beam is doubled, up to `widenings` times. judged: rows at most that are
    compared with all rows, wherever they are; while less than `recall` of their links has been found, the rows are dealt to clusters
    around other centres, up to `partitions` times in all.
    """

    cosine: float = 0.9
    overlap: int = 3
    size: int = 1024
    cap: int = 4096
    sample: int = 20000
    centres: int = 4096
    near: int = 24
    far: int = 8
    degree: int = 16
    alpha: float = 1.2
    beam: int = 16
    audits: int = 48
    recall: float = 0.999
    widenings: int = 4
    judged: int = 2048
    partitions: int = 6
    seed: int = 3


def usable(vector: Column) -> Column:
    """True for a vector that has components, none of them null or non-finite, and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centres(sample: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of k clusters of unit rows: spherical k-means from a random start; empty clusters take rows that fit worst."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        sims = sample @ centres.T
        own, fit = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def prune(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of the rows, up to `degree` of its candidates (indices, -1 for none): the closest first; a candidate that is
    nearer to a chosen one than to the row, by the factor alpha, is left out."""
    none = 9.0
    dist = np.where((cand >= 0) & (cand != rows[:, None]), 1.0 - np.einsum("nd,nmd->nm", x[rows], x[cand]), none)
    out = np.full((len(rows), degree), -1, dtype=np.int64)
    at = np.arange(len(rows))
    for k in range(degree):
        best = dist.argmin(axis=1)
        live = dist[at, best] < none
        if not live.any():
            break
        pick = cand[at, best]
        out[:, k] = np.where(live, pick, -1)
        between = 1.0 - np.einsum("nd,nmd->nm", x[pick], x[cand])
        dist = np.where((alpha * between <= dist) | (cand == pick[:, None]), none, dist)
    return out


def build(x: np.ndarray, p: Params) -> np.ndarray:
    """Edges of a shard's rows: candidates are each row's nearest and some spread ones, pruned; then back edges, pruned again."""
    n = len(x)
    rng = np.random.default_rng(p.seed)
    near = min(p.near, n)
    edges = np.full((n, p.degree), -1, dtype=np.int64)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        sims = x[rows] @ x.T
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        edges[rows] = prune(x, rows, np.hstack([top, rng.integers(0, n, (len(rows), p.far))]), p.degree, p.alpha)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(edges):
        for j in row:
            if j >= 0 and len(back[j]) < 2 * p.degree:
                back[j].append(i)
    wide = np.full((n, 3 * p.degree), -1, dtype=np.int64)
    wide[:, : p.degree] = edges
    for i, b in enumerate(back):
        wide[i, p.degree : p.degree + len(b)] = b
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        edges[rows] = prune(x, rows, wide[rows], p.degree, p.alpha)
    return edges


def search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows found within the range of each query (an index): a greedy walk from `start` with a beam, then
    the range is expanded along edges from every row inside it until no new one comes."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), dtype=bool)
    rows = np.arange(q)
    pool = np.full((q, 1), start, dtype=np.int64)
    sims = np.einsum("qd,qd->q", x[queries], x[pool[:, 0]])[:, None]
    seen[:, start] = True
    done = np.zeros((q, 1), dtype=bool)
    found_q, found_r = [], []
    hit = sims[:, 0] >= p.cosine
    found_q.append(rows[hit])
    found_r.append(pool[hit, 0])
    while True:
        open_sims = np.where(done, -9.0, sims)
        best = open_sims.argmax(axis=1)
        live = np.flatnonzero(open_sims[rows, best] > -9.0)
        if not len(live):
            break
        done[live, best[live]] = True
        nbr = edges[pool[live, best[live]]]
        ok = nbr >= 0
        ok &= ~seen[live[:, None], nbr]
        seen[np.broadcast_to(live[:, None], nbr.shape)[ok], nbr[ok]] = True
        s = np.full((q, nbr.shape[1]), -9.0)
        s[live] = np.where(ok, np.einsum("qd,qmd->qm", x[queries[live]], x[nbr]), -9.0)
        inside = s >= p.cosine
        wide = np.zeros((q, nbr.shape[1]), dtype=np.int64)
        wide[live] = nbr
        if inside.any():
            i, j = np.nonzero(inside)
            found_q.append(i)
            found_r.append(wide[i, j])
        pool, sims = np.hstack([pool, wide]), np.hstack([sims, s])
        done = np.hstack([done, s <= -9.0])
        if pool.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            pool, sims, done = (np.take_along_axis(v, top, axis=1) for v in (pool, sims, done))
    fq, fr = np.concatenate(found_q), np.concatenate(found_r)
    front_q, front_r = fq, fr
    while len(front_q):
        nbr = edges[front_r]
        ok = nbr >= 0
        flat = np.unique((np.broadcast_to(front_q[:, None], nbr.shape)[ok]) * n + nbr[ok])
        a, b = flat // n, flat % n
        new = ~seen[a, b]
        a, b = a[new], b[new]
        seen[a, b] = True
        keep = np.zeros(len(a), dtype=bool)
        for at in range(0, len(a), 65536):
            keep[at : at + 65536] = np.einsum("kd,kd->k", x[queries[a[at : at + 65536]]], x[b[at : at + 65536]]) >= p.cosine
        front_q, front_r = a[keep], b[keep]
        fq, fr = np.concatenate([fq, front_q]), np.concatenate([fr, front_r])
    other = queries[fq] != fr
    return fq[other], fr[other]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable, after pairs (a, b) are joined to the labels so far."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link(vectors: DataFrame, p: Params = Params(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id) for every row: links to other vectors with cosine >= p.cosine in double precision.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; they keep their own id, as does a row
    with a null key. Vectors of one length are compared with one another; each length that occurs takes a run of its own. Rows
    with one key are one vector, the smallest of them. Equal vectors are one node with a count, so copies never meet as pairs. An
    empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = plain.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    lengths = [r.d for r in good.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    of_id = None
    for d in lengths:
        one = _link_nodes(good.where(F.size("v") == d), p)
        of_id = one if of_id is None else of_id.unionByName(one)
    if of_id is None:
        return plain.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = plain.select("id").join(of_id, F.col("id") == F.col("other"), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))


def _first_by_hash(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of nodes with the n smallest hashes of (node, seed)."""
    order = F.xxhash64("node", F.lit(seed))
    last = nodes.select(order.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return nodes.where(order <= F.lit(last))


def _link_nodes(good: DataFrame, p: Params) -> DataFrame:
    """(other, n, c) for rows (id, v) with usable vectors of one length: id, number of links, component.

    Each node joins its nearest clusters; each cluster, or pair of parts of a large one, is a shard of bounded size, in which a
    pruned graph is built. The nodes' edges of all shards are united, each shard is searched along them from its medoid for all its
    rows, and every link is checked in double precision. Two shards that both find a pair count it once: in the first one that the
    two share; a shard in which no beam passes its audit is searched by brute force. Then some rows are compared with all rows; as
    long as too few of their links have been found, all nodes are dealt again around other centres, so that pairs which a border had
    parted meet, and the new edges join the graph. Each partition costs as much as the first, so the whole grows with the rows. Only
    if p.partitions of them don't do (audited rows say so), nodes without a common cluster are held against each other in blocks,
    which costs the square of the nodes. A shard passes on its rows' counts and a spanning forest of its links, not the pairs.
    """
    spark = good.sparkSession
    nodes = save(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("m")), "vec-nodes")
    n = nodes.count()
    dim = nodes.select(F.size("v")).first()[0]
    few = max(1, (64 << 20) // (8 * dim))  # what goes to the driver or to all workers has 64 MB at most
    sample = _unit(_first_by_hash(nodes, min(p.sample, few), 0).select("v").toPandas()["v"])
    k = int(min(p.centres, few, max(1, np.ceil(n * p.overlap / p.size))))
    judged = _first_by_hash(nodes, min(p.judged, few), 1).select("node", "v").toPandas()
    judges = spark.sparkContext.broadcast((judged["node"].to_numpy(), _unit(judged["v"])))

    def met_by(parts):
        ids, y = judges.value
        count = np.zeros(len(ids), dtype=np.int64)
        for pdf in parts:
            for at in range(0, len(pdf), 2048):
                some = pdf.iloc[at : at + 2048]
                near = _unit(some["v"]) @ y.T >= p.cosine
                near &= some["node"].to_numpy()[:, None] != ids
                count += some["m"].to_numpy() @ near
        yield pd.DataFrame({"node": ids, "n": count})

    truth = nodes.select("node", "m", "v").mapInPandas(met_by, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    wanted = int(truth["n"].sum())
    asked = spark.createDataFrame([(int(i),) for i in judged["node"]], "node long")
    placed = save(nodes.select("node", "m", "v", F.expr("cast(array() as array<int>)").alias("own")), "vec-placed")
    graph, found, done = None, None, False
    for r in range(p.partitions):
        placed, graph, more = _partition(placed, graph, k, fit_centres(sample, k, p.seed + r), r, p)
        found = more if found is None else found.unionByName(more)
        got = found.join(F.broadcast(asked), "node").agg(F.sum("n")).first()[0] or 0
        done = k <= p.overlap or got >= p.recall * wanted
        LOG.info("partition %d: %d of %d links of %d audited vectors", r + 1, got, wanted, len(judged))
        if done:
            break
    if not done:
        LOG.warning("%d partitions are not enough: all nodes without a common cluster are compared", p.partitions)
        found = found.unionByName(_apart(placed, n, p))
    found = save(found, "vec-links-all")
    comp = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    per = nodes.join(count, "node").join(comp.withColumnRenamed("id", "node"), "node", "left")
    per = per.select("v", (F.col("n") + F.col("m") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = save(good.join(per, "v").select(F.col("id").alias("other"), "n", "c"), "vec-out")
    drop(nodes, placed, graph, found, comp)
    return out


def _partition(placed: DataFrame, graph: DataFrame | None, k: int, centres: np.ndarray, r: int, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The r-th dealing to clusters: placed (node, m, v, own) with the new clusters in own, the graph (node, e) with the new edges,
    and what the search of the new shards finds (node, n, root). Clusters are numbered on from those of earlier partitions."""
    spark = placed.sparkSession
    sent, base = spark.sparkContext.broadcast(centres), r * p.centres

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        m = min(p.overlap, len(sent.value))
        sims = _unit(v) @ sent.value.T
        return pd.Series(list(base + np.sort(np.argpartition(-sims, m - 1, axis=1)[:, :m], axis=1).astype(np.int32)))

    old = placed
    placed = save(placed.select("node", "m", "v", F.concat("own", nearest("v")).alias("own")), "vec-placed")
    drop(old)
    in_cluster = placed.select("node", "own", F.explode("own").alias("c")).where(F.col("c") >= base)
    large = in_cluster.groupBy("c").agg(F.count("*").alias("size"))
    large = large.select("c", F.when(F.col("size") > p.cap, F.ceil(F.col("size") / F.lit(p.cap / 2))).otherwise(1).cast("int").alias("g"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("x"), F.greatest(j, F.col("part")).alias("y")))
    shards = in_cluster.join(large, "c").withColumn("part", part).select("node", "own", "c", "part", F.explode(blocks).alias("b"))
    shards = save(shards.select("node", "own", "c", "part", F.concat_ws("-", "c", "b.x", "b.y").alias("shard"), (F.col("b.x") != F.col("b.y")).alias("mixed")), "vec-shards")

    def edges_of(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        made = build(_unit(pdf["v"]), p)
        return pd.DataFrame({"node": ids, "e": [ids[row[row >= 0]] for row in made]})

    rows = shards.select("node", "shard").join(placed.select("node", "v"), "node")
    edges = rows.groupBy("shard").applyInPandas(edges_of, "node long, e array<long>")
    edges = edges if graph is None else edges.unionByName(graph)
    old, graph = graph, save(edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("e")), "vec-graph")
    if old is not None:
        drop(old)

    def links_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, part, times = pdf["node"].to_numpy(), pdf["part"].to_numpy(), pdf["m"].to_numpy()
        own, cluster, mixed = np.stack(pdf["own"]), int(pdf["c"][0]), bool(pdf["mixed"][0])
        x = _unit(pdf["v"])
        size = len(ids)
        edges = np.full((size, max(1, max(map(len, pdf["e"])))), -1, dtype=np.int64)
        for i, e in enumerate(pdf["e"]):
            at = np.minimum(np.searchsorted(ids, e), size - 1)
            at = at[ids[at] == e]
            edges[i, : len(at)] = at
        edges = edges[:, : max(1, int((edges >= 0).sum(axis=1).max()))]
        start = int((x @ x.mean(axis=0)).argmax())
        beam = p.beam
        audit = np.random.default_rng(p.seed).choice(size, min(p.audits, size), replace=False)
        truth = (x[audit] @ x.T >= p.cosine).sum() - len(audit)
        for w in range(p.widenings + 1):
            passed = truth == 0 or len(search(x, edges, audit, start, beam, p)[0]) >= p.recall * truth
            if passed or w == p.widenings:
                break
            beam *= 2
        count, label = np.zeros(size, dtype=np.int64), np.arange(size)
        for at in range(0, size, 256):
            queries = np.arange(at, min(at + 256, size))
            if passed:
                q, found = search(x, edges, queries, start, beam, p)
            else:  # no beam was wide enough: all pairs
                q, found = np.nonzero(x[queries] @ x.T >= p.cosine)
                q, found = q[queries[q] != found], found[queries[q] != found]
            q = queries[q]
            label = _joined(label, q, found)
            # a pair counts here if no earlier cluster has both, and in a block of two parts only if it crosses them
            shared = np.full(len(q), np.iinfo(np.int32).max)
            for j in range(own.shape[1]):
                both = (own[found] == own[q, j][:, None]).any(axis=1)
                shared = np.where(both, np.minimum(shared, own[q, j]), shared)
            here = (shared == cluster) & ((part[q] != part[found]) | (not mixed))
            np.add.at(count, q[here], times[found[here]])
        return pd.DataFrame({"node": ids, "n": count, "root": ids[label]})

    tasks = shards.join(placed.select("node", "m", "v"), "node").join(graph, "node")
    found = save(tasks.groupBy("shard").applyInPandas(links_of, "node long, n long, root long"), "vec-links")
    drop(shards)
    return placed, graph, found


def _apart(placed: DataFrame, n: int, p: Params) -> DataFrame:
    """(node, n, root): links between nodes without a common cluster, from all pairs, in blocks."""

    def apart_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, block, times, own = pdf["node"].to_numpy(), pdf["block"].to_numpy(), pdf["m"].to_numpy(), np.stack(pdf["own"])
        x = _unit(pdf["v"])
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        count, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        y = x[right].T
        for at in range(0, len(left), 256):
            q, r = np.nonzero(x[left[at : at + 256]] @ y >= p.cosine)
            q, r = left[at + q], right[r]
            keep = (block[q] != block[r]) | (q < r)
            for j in range(own.shape[1]):
                keep &= (own[r] != own[q, j][:, None]).all(axis=1)
            q, r = q[keep], r[keep]
            np.add.at(count, q, times[r])
            np.add.at(count, r, times[q])
            label = _joined(label, q, r)
        hit = count > 0
        return pd.DataFrame({"node": ids[hit], "n": count[hit], "root": ids[label[hit]]})

    g = int(np.ceil(n / min(4 * p.cap, max(p.cap, n / 32))))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda j: F.concat_ws("-", F.least(j, F.col("block")), F.greatest(j, F.col("block"))))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(g)).cast("int")).withColumn("pair", F.explode(pairs))
    return dealt.groupBy("pair").applyInPandas(apart_of, "node long, n long, root long")


def report(vectors: DataFrame, p: Params = Params(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """link() with kept: whether the row is the smallest id of its component (a null key is kept)."""
    return link(vectors, p, key, vector).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


#: The same in SQL for DuckDB, over all pairs.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.9),
reach AS (SELECT x, x AS r FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.r = l.x),
c AS (SELECT x, min(r) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""
