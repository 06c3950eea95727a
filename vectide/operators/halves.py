"""Rows in halves: a tree of exact median splits over a table of any size, found by passes that send back only counts and few rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.operators.blocks import matrix

#: Bins of a pass that narrows down where a median lies, and rows that one pass sends to the driver at most.
BINS, FETCHED = 4096, 1 << 17
KEYS = ("value", "id", "place")


def outline(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, left) of each node when n rows are halved until a node has `most` at most; right is left + 1, and left is -1 in a leaf."""
    rows, left = [n], []
    for at in range(2 * n + 1):
        if at == len(rows):
            break
        left.append(len(rows) if rows[at] > most else -1)
        if rows[at] > most:
            rows += [rows[at] // 2, rows[at] - rows[at] // 2]
    return np.array(rows), np.array(left)


class Halves:
    """Splits of rows (id, vec, place): a node's first half in the order of (component, id, place) goes left. place tells rows of one id apart."""

    def __init__(self, rows: DataFrame, n: int, most: int, top_dims: int, seed: int):
        self.rows, self.top_dims, self.seed = rows, top_dims, seed
        self.size, self.left = outline(n, most)
        nodes = len(self.size)
        self.dim, self.value = np.full(nodes, -1), np.zeros(nodes)
        self.id, self.place = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.leaf = np.where(self.left < 0, np.cumsum(self.left < 0) - 1, -1)
        level = [0] if self.left[0] >= 0 else []
        while level:
            self._split(level, self._choose(level))
            level = [int(c) for at in level for c in (self.left[at], self.left[at] + 1) if self.left[c] >= 0]

    def _routed(self, run: Callable, schema: str) -> DataFrame:
        """What run gives for (x, ids, places, node of each row) of each batch."""
        known = {k: getattr(self, k) for k in ("left", "dim", "value", "id", "place")}
        sent = self.rows.sparkSession.sparkContext.broadcast(known)

        def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    x = matrix(part["vec"], "f8")
                    ids, places = (part[c].to_numpy(zero_copy_only=False) for c in ("id", "place"))
                    yield from run(part, x, ids, places, _route(sent.value, x, ids, places))

        return self.rows.mapInArrow(each, schema)

    def _choose(self, level: list[int]) -> dict[int, int]:
        """For each node one of the components that vary most over its rows."""

        def sums(part, x, ids, places, node):
            for at in np.intersect1d(np.unique(node), level):
                own = x[node == at]
                yield pa.RecordBatch.from_pydict({"node": np.full(own.shape[1], at), "pos": np.arange(own.shape[1]), "n": np.full(own.shape[1], len(own)), "s": own.sum(axis=0), "s2": (own * own).sum(axis=0)})

        got = self._routed(sums, "node long, pos long, n long, s double, s2 double").groupBy("node", "pos").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2"))).toPandas()
        out = {}
        for at, own in got.sort_values(["node", "pos"]).groupby("node"):
            n, s, s2 = (own[c].to_numpy() for c in ("n", "s", "s2"))
            if n[0] != self.size[at]:
                raise RuntimeError(f"node {at} has {n[0]} rows, not {self.size[at]}: the rows changed between passes")
            spread = np.array([float(f"{v:.9g}") for v in s2 / n - (s / n) ** 2])  # sums come in any order
            out[at] = int(np.random.default_rng([self.seed, at]).choice(np.argsort(-spread, kind="stable")[: self.top_dims]))
        return out

    def _split(self, level: list[int], dims: dict[int, int]) -> None:
        """The first row of each node's right half. Where many rows are in question, the range is narrowed first: by component, by id among
        rows of one component, by place among those of one id."""
        want = {at: {"key": 0, "fixed": (), "lo": None, "hi": None, "rank": int(self.size[at] // 2), "count": int(self.size[at])} for at in level}

        def keys(w, at, x, ids, places, rows):
            """The rows of a node that are in question, and what they are ordered by now."""
            all_keys = (x[rows, dims[at]], ids[rows], places[rows])
            on = np.ones(len(rows), bool)
            for k, v in enumerate(w["fixed"]):
                on &= all_keys[k] == v
            now = all_keys[w["key"]]
            if w["lo"] is not None:
                on &= (now >= w["lo"]) & (now <= w["hi"])
            return rows[on], now[on]

        while True:
            large = {at: w for at, w in want.items() if w["count"] > max(64, FETCHED // len(level))}
            if not large:
                break
            ends = {at: w for at, w in large.items() if w["lo"] is None}

            def ranges(part, x, ids, places, node, ends=ends):
                for at, w in ends.items():
                    rows, now = keys(w, at, x, ids, places, np.flatnonzero(node == at))
                    if len(rows):
                        real = w["key"] == 0
                        yield _row(at, 0, len(rows), now.min() if real else 0.0, now.max() if real else 0.0, 0 if real else now.min(), 0 if real else now.max())

            if ends:
                for r in _counted(self._routed(ranges, BINNED)):
                    w = want[r.node]
                    w["lo"], w["hi"] = (r.lo, r.hi) if w["key"] == 0 else (r.ilo, r.ihi)
            for w in large.values():
                if w["lo"] == w["hi"]:  # all in question are equal
                    if w["key"] == len(KEYS) - 1:
                        raise RuntimeError("rows cannot be told apart")
                    w |= {"fixed": (*w["fixed"], w["lo"]), "key": w["key"] + 1, "lo": None, "hi": None}
            wide = {at: w for at, w in large.items() if w["lo"] is not None}
            if not wide:
                continue

            def bins(part, x, ids, places, node, wide=wide):
                for at, w in wide.items():
                    rows, now = keys(w, at, x, ids, places, np.flatnonzero(node == at))
                    of = _bin(now, w["lo"], w["hi"])
                    order = np.argsort(of, kind="stable")
                    of, now = of[order], now[order]
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
                    if len(first):
                        least, most, n = np.minimum.reduceat(now, first), np.maximum.reduceat(now, first), np.diff([*first, len(of)])
                        none, real = np.zeros(len(first)), w["key"] == 0
                        i_none = np.zeros(len(first), np.int64)
                        yield pa.RecordBatch.from_pydict(
                            {"node": np.full(len(first), at), "bin": of[first], "n": n, "lo": least if real else none, "hi": most if real else none, "ilo": i_none if real else least, "ihi": i_none if real else most}
                        )

            done = set()
            for r in sorted(_counted(self._routed(bins, BINNED)), key=lambda r: (r.node, r.bin)):
                w = want[r.node]
                if r.node in done:
                    continue
                if w["rank"] >= r.n:
                    w["rank"] -= r.n
                    continue
                w["lo"], w["hi"] = (r.lo, r.hi) if w["key"] == 0 else (r.ilo, r.ihi)
                w["count"] = r.n
                done.add(r.node)

        def last(part, x, ids, places, node):
            for at, w in want.items():
                rows, _ = keys(w, at, x, ids, places, np.flatnonzero(node == at))
                if len(rows):
                    yield pa.RecordBatch.from_pydict({"node": np.full(len(rows), at), "value": x[rows, dims[at]], "id": ids[rows], "place": places[rows]})

        few = self._routed(last, "node long, value double, id long, place long").toPandas()
        for at, own in few.sort_values(["node", *KEYS]).groupby("node"):
            w = want[at]
            if len(own) != w["count"]:
                raise RuntimeError("the rows changed between passes")
            for key in KEYS:
                getattr(self, key)[at] = own[key].iloc[w["rank"]]
        for at in level:
            self.dim[at] = dims[at]

    def parts(self) -> DataFrame:
        """(id, vec, shard): the rows with their leaf, numbered from 0."""
        leaf = self.leaf

        def run(part, x, ids, places, node):
            yield pa.RecordBatch.from_arrays([part["id"], part["vec"], pa.array(leaf[node].astype(np.int64))], ["id", "vec", "shard"])

        return self._routed(run, "id long, vec array<double>, shard long")


BINNED = "node long, bin long, n long, lo double, hi double, ilo long, ihi long"


def _row(*values) -> pa.RecordBatch:
    names = [c.split()[0] for c in BINNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([float(v) if c in ("lo", "hi") else int(v)]) for c, v in zip(names, values)], names)


def _counted(df: DataFrame) -> list:
    least, most = [F.min(c).alias(c) for c in ("lo", "ilo")], [F.max(c).alias(c) for c in ("hi", "ihi")]
    return df.groupBy("node", "bin").agg(F.sum("n").alias("n"), *least, *most).collect()


def _bin(now: np.ndarray, lo, hi) -> np.ndarray:
    """A bin of BINS for each key of lo to hi, in their order: lo in the first and hi in the last one."""
    if now.dtype == np.int64:
        lo, now = np.uint64(int(lo) & (1 << 64) - 1), now.view(np.uint64)
        share = (now - lo).astype(np.float64) / float((int(hi) - int(np.int64(lo.view(np.int64)))) or 1)
    else:
        share = (now - lo) / (hi - lo)
    return np.minimum(share * BINS, BINS - 1).astype(np.int64)


def _route(cuts: dict, x: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while True:
        on = np.flatnonzero(cuts["dim"][node] >= 0)
        if not len(on):
            return node
        at = node[on]
        v, i, p = x[on, cuts["dim"][at]], ids[on], places[on]
        level, same = v == cuts["value"][at], i == cuts["id"][at]
        right = (v > cuts["value"][at]) | level & ((i > cuts["id"][at]) | same & (p >= cuts["place"][at]))
        node[on] = cuts["left"][at] + right
