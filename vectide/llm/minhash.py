"""Near-duplicate documents by b-bit MinHash: packed low bits of minima, band candidates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vectide.llm.common import components, drop, maybe_in, save

#: Low bits retained of each minimum; LANES of them are packed into one long.
BITS = 4
LANES = 64 // BITS


@dataclass(frozen=True)
class Params:
    """width: words in a shingle. similarity: least Jaccard similarity in per cent. minima: hash functions; the first bands x rows
    of them make the bands, all make the signature.

    With 56 bands of 6, a pair at 80 per cent shares no band with probability (1 - 0.8 ** 6) ** 56 = 4e-8, one at 20 per cent shares
    one with 0.4 per cent.
    slack: standard deviations, at most, by which an estimate may be low where it decides that a pair is not confirmed on full sets.
    """

    width: int = 5
    similarity: int = 80
    bands: int = 56
    rows: int = 6
    minima: int = 336
    slack: float = 6.0
    seed: int = 1


class _Words(dict):
    """64-bit hashes of words, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K[4]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: ASCII letters lower-cased, words split at ASCII white space.

    A text with fewer words than width has its whole sequence as one; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * _K[0] + h[k : len(h) - n + 1 + k] * _K[1])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) > 1 else out


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each of len(a) hash functions over a non-empty set, in blocks that stay in the cache."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (x[k : k + 512, None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig, bands): k1 and k2 name the set, sig packs the low bits of all minima."""
    n = p.minima

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(p.seed)
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        at = np.arange(p.bands, dtype=np.uint64) * _K[2]
        place = np.uint64(BITS) * np.arange(LANES, dtype=np.uint64)
        for pdf in parts:
            size, k1, k2 = [], [], []
            low = np.zeros((len(pdf), n), dtype=np.uint32)
            for k, t in enumerate(pdf["text"]):
                s = shingles(t, p.width)
                size.append(len(s))
                name = xxhash.xxh3_128_intdigest(s.tobytes())
                k1.append((name & (2**64 - 1)) - 2**63)
                k2.append((name >> 64) - 2**63)
                if len(s):
                    low[k] = minima(s, a, b)
            sig = ((low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(pdf), -1, LANES) << place).sum(axis=2, dtype=np.uint64)
            band = np.broadcast_to(at, (len(pdf), p.bands)).copy()
            for r in range(p.rows):
                band = _mix(band * _K[0] + low[:, r : p.bands * p.rows : p.rows].astype(np.uint64) + _K[3])
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": size, "k1": k1, "k2": k2, "sig": list(sig.view(np.int64)), "bands": list(band.view(np.int64))}
            )

    with np.errstate(over="ignore"):
        return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
            run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"
        )


def equal_lanes(x: Column, y: Column, p: Params) -> Column:
    """How many retained values two signatures share, by bit counts: unequal ones leave a bit after folding."""
    ones = sum(1 << (BITS * k) for k in range(LANES))
    ones = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)
    total = F.lit(p.minima)
    for k in range(p.minima // LANES):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        fold = d
        for s in range(1, BITS):
            fold = fold.bitwiseOR(F.shiftrightunsigned(d, s))
        total = total - F.bit_count(fold.bitwiseAND(ones))
    return total


def estimate(equal: Column, p: Params) -> Column:
    """Similarity that the equal values stand for, corrected for chance collisions of b bits."""
    c = 2.0**-BITS
    return (equal / F.lit(float(p.minima)) - c) / (1 - c)


@F.pandas_udf(LongType())
def _common(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for s, t in zip(x, y):
        both = np.concatenate([np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)])
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pd.Series(out, dtype="int64")


#: Bytes after which a batch of rows with texts, sets or blocks is sent to Python: a block's rows hold the sets of all its members.
BATCH = 4 << 20

#: A bucket with more members than this is compared with a few spread members of it besides its smallest.
LARGE = 8
ANCHORS = 6
#: So many other ones for members that are linked with none of those.
MORE = 18
#: Anchors, the most alike by estimate, that a member is compared with on full sets.
TRIES = 4


def link(docs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: the components of all links at p.similarity per cent or more.

    Equal sets are one class from the start, so copies never meet as pairs. Classes that share a band are candidates.
    Round one compares each class with anchors of its buckets, and gives it the nearest anchor it is linked with as a centre, at an
    exactly known distance; a class without one is its own centre. Round two takes the pairs of centres that meet in a bucket and are
    in different components; those that are linked join. Jaccard distance is a metric: members a and b of centres A and B can be linked only if
    d(A, B) <= d(a, A) + d(b, B) + 0.2, so most pairs of centres that are still apart are settled at once, and only members far enough
    out are compared one by one. So no candidate pair across components is left open, inside one a link changes nothing, and what is
    compared does not grow with the square of a group of near copies. Pairs whose b-bit estimate is out of reach of what would
    matter are not confirmed on full sets.

    Texts without words: n_shingles 0, component_id their own id. A row with a null id keeps a null component unless an equal
    text has an id. Rows with one id are one document. An empty table gives no rows.
    """
    sig = save(signatures(docs, p, key, text), "minhash", batch_bytes=BATCH)
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("m")
    )
    reps = save(classes.select(F.col("m.doc_id").alias("id"), "k1", "k2", F.col("m.n_shingles").alias("n"), "m.sig", "m.bands"), "minhash-reps")
    in_band = reps.select("id", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(F.min("id").alias("anchor"), F.count("*").alias("size")).where("size > 1")
    members = save(in_band.join(buckets, "band"), "minhash-members")
    facts = reps.select("id", "n", "sig")
    least = p.similarity / 100
    equal = 2.0**-BITS + (1 - 2.0**-BITS) * least
    slack = p.slack * float(np.sqrt(equal * (1 - equal) / p.minima)) / (1 - 2.0**-BITS)

    def estimated(pairs: DataFrame) -> DataFrame:
        """pairs with the set sizes na and nb and the estimated similarity."""
        x = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        out = pairs.join(x, "a").join(y, "b").withColumn("est", estimate(equal_lanes(F.col("sa"), F.col("sb"), p), p))
        return out.drop("sa", "sb")

    within_reach = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.similarity) & (F.col("est") >= least - slack)

    def full_sets(ids: DataFrame) -> DataFrame:
        """(id, s): the sorted shingle hashes of the wanted documents, made anew from their texts."""
        width = p.width

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame({"id": pdf["id"], "s": [shingles(t, width).tobytes() for t in pdf["t"]]})

        ids = ids.distinct()
        texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where(maybe_in(ids, "id")).join(ids, "id", "left_semi")
        return save(texts.mapInPandas(run, "id long, s binary").dropDuplicates(["id"]), "minhash-sets", batch_bytes=BATCH)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs (a, b, na, nb) with the exact distance d and whether they are linked."""
        sets = full_sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
        x = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
        y = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = pairs.join(x, "a").join(y, "b").withColumn("c", _common("sa", "sb")).drop("sa", "sb")
        union = F.col("na") + F.col("nb") - F.col("c")
        out = save(both.withColumns({"d": 1 - F.col("c") / union, "linked": F.col("c") * 100 >= union * p.similarity}), "minhash-confirmed", batch_bytes=BATCH)
        drop(sets)
        return out

    # round one: members and anchors; then, with other anchors, members that are linked with none of them
    def anchors(seeds: range) -> DataFrame:
        spread = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id"))["id"].alias(f"a{k}") for k in seeds]
        more = members.where(F.col("size") > LARGE).groupBy("band").agg(*spread)
        return more.select("band", F.explode(F.array_distinct(F.array(*(f"a{k}" for k in seeds)))).alias("a"))

    def nearest_tries(star: DataFrame) -> DataFrame:
        nearest = Window.partitionBy("b").orderBy(F.desc("est"), "a")
        out = estimated(star.where("a != b").select("a", "b").distinct()).where(within_reach)
        return save(out.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= TRIES).select("a", "b", "na", "nb"), "minhash-first")

    ends = members.select("band", F.col("id").alias("b"))
    tried = confirmed(nearest_tries(members.select("band", F.col("anchor").alias("a")).distinct().union(anchors(range(ANCHORS))).join(ends, "band")))
    joined = tried.where("linked").select(F.explode(F.array("a", "b")).alias("b")).distinct()
    alone = ends.join(members.where(F.col("size") > LARGE).select("band").distinct(), "band", "left_semi").join(joined, "b", "left_anti")
    again = confirmed(nearest_tries(anchors(range(ANCHORS, ANCHORS + MORE)).join(alone, "band")))
    tried = tried.union(again)
    edges = tried.where("linked").select("a", "b")
    chosen = tried.where("linked").groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("b").alias("id"), F.col("m.a").alias("centre"), F.col("m.d").alias("d"))
    used = chosen.select(F.col("centre").alias("id")).distinct()
    own = used.select("id", F.col("id").alias("centre"), F.lit(0.0).alias("d"))
    chosen = save(chosen.join(used, "id", "left_anti").union(own), "minhash-centres")
    radius = chosen.groupBy("centre").agg(F.max("d").alias("r"))
    found = components(edges)
    # round two: centres of different components that meet in a bucket; it may be one of their members' only, not of their own bands
    placed = members.select("band", "id").join(chosen.select("id", "centre"), "id", "left").select("band", F.coalesce("centre", "id").alias("centre")).distinct()
    placed = placed.join(found.select(F.col("id").alias("centre"), "component"), "centre", "left").select("band", "centre", F.coalesce("component", "centre").alias("comp"))
    placed = save(placed, "minhash-placed")
    open_bands = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    of = reps.select(F.col("id").alias("centre"), "n", "sig").join(radius, "centre", "left").fillna(0.0, ["r"])
    x = placed.join(open_bands, "band").join(of, "centre")
    x = x.select("band", F.col("centre").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("r").alias("ra"))
    y = x.select(*(F.col(u).alias(v) for u, v in zip(x.columns, ("other", "b", "cb", "nb", "sb", "rb"))))
    out = F.col("ra") + F.col("rb")
    sizes = (out > 0) | (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.similarity)
    near = estimate(equal_lanes(F.col("sa"), F.col("sb"), p), p) >= least - slack - out
    meet = x.join(y, (F.col("band") == F.col("other")) & (F.col("ca") < F.col("cb")) & sizes & near)
    second = save(meet.select("a", "b", "na", "nb", out.alias("out"), "rb").distinct(), "minhash-second")
    if second.limit(1).count():
        met = confirmed(second)
        edges = edges.union(met.where("linked").select("a", "b"))
        found = components(edges)
        at = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        met = met.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        open_pairs = met.where(~F.col("linked") & (F.col("out") > 0) & (F.col("d") <= (1 - least) + F.col("out") + 1e-9)).select("a", "b", F.col("d").alias("dc"))
        open_pairs = save(open_pairs, "minhash-open")
        if open_pairs.limit(1).count():
            late = between_groups(open_pairs, chosen, reps, full_sets, p)
            found = components(found.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(late))
    drop(second, members, placed)
    of_class = reps.select("k1", "k2", "id").join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("c"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


#: Members of a large group that are looked at together.
BLOCK = 64


def between_groups(pairs: DataFrame, chosen: DataFrame, reps: DataFrame, full_sets, p: Params) -> DataFrame:
    """Edges (a, b) that join groups: pairs has centres a, b at distance dc whose members may still be linked.

    The members of the smaller group are each held against the larger group's, in blocks; one link for a member and a block is
    enough, since a block's members are in one component. Nothing is emitted for members that are not linked.
    """
    most = 1 - p.similarity / 100
    size = chosen.groupBy("centre").agg(F.count("*").alias("size"), F.max("d").alias("r"))
    fact = lambda c: size.select(F.col("centre").alias(c), F.col("size").alias(f"n{c}"), F.col("r").alias(f"r{c}"))
    both = pairs.join(fact("a"), "a", "left").join(fact("b"), "b", "left").fillna({"na": 1, "nb": 1, "ra": 0.0, "rb": 0.0})
    swap = F.col("na") > F.col("nb")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    both = both.select(pick("a", "b", "lo"), pick("b", "a", "hi"), pick("rb", "ra", "r"), pick("nb", "na", "size"), "dc")
    grouped = chosen.select("centre", "id", "d")
    solo = both.select(F.explode(F.array("lo", "hi")).alias("centre")).distinct().join(grouped, "centre", "left_anti")
    grouped = grouped.union(solo.select("centre", F.col("centre").alias("id"), F.lit(0.0)))
    left = both.join(grouped.select(F.col("centre").alias("lo"), F.col("id").alias("a"), "d"), "lo").where(F.col("dc") <= most + F.col("d") + F.col("r") + 1e-9)
    left = save(left.select("hi", "a", "size", (F.col("dc") - F.col("d") - most).alias("need")), "minhash-left")
    right = grouped.join(both.select(F.col("hi").alias("centre"), "size").distinct(), "centre")
    right = save(right.withColumn("k", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).cast("int")), "minhash-right")
    sets = full_sets(left.select(F.col("a").alias("id")).union(right.select("id")))
    sets = sets.join(reps.select("id", "sig"), "id")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        one = {"hi": [pdf["centre"][0]], "k": [pdf["k"][0]], "ids": [list(pdf["id"])], "ds": [list(pdf["d"])], "ends": [list(np.cumsum([len(s) // 8 for s in pdf["s"]]))]}
        return pd.DataFrame(one | {"sigs": [np.stack(pdf["sig"]).tobytes()], "all": [b"".join(pdf["s"])]})

    blocks = right.join(sets, "id").groupBy("centre", "k").applyInPandas(pack, "hi long, k int, ids array<long>, ds array<double>, ends array<int>, sigs binary, all binary")
    c = 2.0**-BITS
    equal = c + (1 - c) * p.similarity / 100
    enough = p.minima * equal - p.slack * np.sqrt(p.minima * equal * (1 - equal))
    ones, similarity = np.uint64(sum(1 << (BITS * k) for k in range(LANES))), p.similarity

    @F.pandas_udf(LongType())
    def one_link(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows in parts:
            out = []
            for need, sig, s, ids, ds, ends, sigs, everything in zip(*rows):
                mine, flat = np.frombuffer(s, np.uint64), np.frombuffer(everything, np.uint64)
                x = np.frombuffer(sigs, np.uint64).reshape(len(ids), -1) ^ np.asarray(sig).view(np.uint64)
                for k in (1, 2):
                    x = x | (x >> np.uint64(k))
                alike = p.minima - np.bitwise_count(x & ones).sum(axis=1)
                near = np.flatnonzero((alike >= enough) & (np.asarray(ds) >= need - 1e-9))
                hit = None
                if len(near):
                    ends = np.asarray(ends)
                    starts = np.concatenate([[0], ends[:-1]])
                    at = np.searchsorted(mine, flat)
                    same = np.concatenate([[0], np.cumsum(mine[np.minimum(at, len(mine) - 1)] == flat)])
                    common = (same[ends] - same[starts])[near]
                    linked = near[100 * common >= similarity * (len(mine) + (ends - starts)[near] - common)]
                    hit = int(ids[linked[0]]) if len(linked) else None
                out.append(hit)
            yield pd.Series(out, dtype="Int64")

    # dealt by group and block, so that a large group's blocks lie in many tasks
    dealt = left.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)))
    held = dealt.join(sets.select(F.col("id").alias("a"), "sig", "s"), "a").join(blocks, ["hi", "k"])
    found = held.select("a", one_link("need", "sig", "s", "ids", "ds", "ends", "sigs", "all").alias("b"))
    found = save(found.where("b is not null"), "minhash-late", batch_bytes=BATCH)
    drop(left, right)
    return found


def deduplicate(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs that stay: the smallest id of each component, and every row that is linked with nothing. Columns as in docs.

    Of rows with one id all stay or none. Rows with a null id stay.
    """
    gone = link(docs, p, key, text).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[key] == F.col("__gone"), "left_anti")


def report(docs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """link() with kept: whether the row is the smallest id of its component (true for a null id without equals)."""
    return link(docs, p, key, text).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


#: The same for two-word shingles in SQL for DuckDB, over all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sn AS (SELECT doc_id, hash(g) AS g, n FROM sh JOIN n USING (doc_id)),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sn a JOIN sn b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, x AS r FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.r = e.x),
c AS (SELECT x AS doc_id, min(r) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
