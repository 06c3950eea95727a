"""Repeated passages: every run of several consecutive sentences is hashed and joined over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import drop, join_hot, save, unused


@dataclass(frozen=True)
class Params:
    """words: a run grows from each sentence until it has so many words. longest: a sentence with more words is cut into parts,
    after each word whose bytes sum to a multiple of `every` and after `longest` words without one, so that the cuts are the same
    wherever the words stand. within: whether a run that recurs in one document only is repeated as well.

    Parts have at most `longest` words, so a repeated passage of words + 2 * longest - 1 words (51) holds a run wherever it begins,
    once a cut that depends on its words alone has been met.
    """

    words: int = 32
    longest: int = 10
    every: int = 5
    within: bool = False


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are parsed together; a longer text is parsed alone.
CHUNK = 1 << 18
_M = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3, 0x165667B19E3779FB)
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=8)
def _powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """m ** k and m ** -k mod 2 ** 64 for k below n."""
    out = []
    for base in (m, pow(m, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _ranges(values: np.ndarray, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of values[a:b] for each a and b: differences of running polynomial sums, brought back to place 0."""
    size = max(1 << 12, 1 << int(len(values)).bit_length())
    up, down = _powers(m, size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(_M[1]))


class Pieces:
    """The sentences (long ones cut) of some texts, as arrays: `doc` is the text's number, `lo` and `hi` the bytes of a piece in
    the joined texts, `first` and `last` its words (last exclusive), `nth` its number in the text. Pieces without a word are left out."""

    def __init__(self, texts: list[bytes], p: Params):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        self.data, self.begins, self.ends = data, begins, ends
        blank = _BLANK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[begins] = edge[ends] = True
        solid = ~blank
        before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
        after = np.concatenate([solid[1:], [False]]) if len(data) else solid
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        n = len(start)
        of = np.searchsorted(begins, start, side="right") - 1
        tail = np.ones(n, dtype=bool)
        tail[:-1] = of[1:] != of[:-1]
        gap_end = np.where(tail, ends[of] if n else 0, np.concatenate([start[1:], [len(data)]])[:n])
        lines = np.flatnonzero(data == 10)
        passed = np.searchsorted(lines, end)
        line = np.searchsorted(lines, gap_end) > passed
        close = data[end - 1] if n else np.zeros(0, np.uint8)
        stop = np.isin(close, list(b".!?")) & (end < gap_end)
        closes = stop | line | tail
        sentence = np.cumsum(closes) - closes
        long = np.bincount(sentence, minlength=1)[sentence] > p.longest if n else closes
        total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        closes = closes | (long & ((total[end] - total[start]) % p.every == 0))
        at = np.arange(n)
        opened = np.maximum.accumulate(np.where(np.concatenate([[True], closes[:-1]])[:n], at, 0)) if n else at
        closes = closes | (long & ((at - opened + 1) % p.longest == 0))
        own = np.flatnonzero(closes)
        self.last = own + 1
        self.first = np.concatenate([[0], self.last[:-1]])[: len(own)]
        self.doc = of[own]
        head = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])[: len(own)]
        self.nth = np.arange(len(own)) - np.maximum.accumulate(np.where(head, np.arange(len(own)), 0)) if len(own) else own
        by_line = (line & ~stop)[own]
        newline = lines[np.minimum(passed[own], max(len(lines) - 1, 0))] + 1 if len(lines) else end[own]
        self.hi = np.where(by_line, newline, gap_end[own])
        # the piece begins where the one before has ended, or after the last line end since then
        since = np.where(head, begins[self.doc], np.concatenate([[0], self.hi[:-1]])[: len(own)])
        known = np.searchsorted(lines, start[self.first]) - 1
        last_line = lines[np.maximum(known, 0)] + 1 if len(lines) else since
        self.lo = np.where((known >= 0) & (last_line > since), last_line, since)
        self.start, self.end = start, end

    def runs(self, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, pieces in the run, h1, h2): the run that begins with a piece, if the text has so many words from there."""
        if not len(self.first):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        with np.errstate(over="ignore"):
            word = _ranges(_TABLE[self.data], _M[0], self.start, self.end)
            i = np.arange(len(self.first))
            j = np.maximum(np.searchsorted(self.last, self.first + p.words), i + 1)
            whole = j < len(i)
            i, j = i[whole], j[whole]
            same = self.doc[i] == self.doc[j]
            i, j = i[same], j[same]
            h1 = _ranges(word, _M[1], self.first[i], self.last[j])
            h2 = _ranges(_mix(word ^ np.uint64(_M[2])), _M[2], self.first[i], self.last[j])
        return i, j - i + 1, h1.view(np.int64), h2.view(np.int64)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, up to CHUNK of them together, with the number of the first; null is empty."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > CHUNK:
            yield first, held
            held, size, first = [], 0, k
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def runs_of(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, i, n, h1, h2): each run; i is its first piece's number in the text, from 0, and n the number of its pieces."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids = pdf["doc"].to_numpy()
            for first, texts in _chunks(list(pdf["t"])):
                made = Pieces(texts, p)
                at, n, h1, h2 = made.runs(p)
                yield pd.DataFrame({"doc": ids[first + made.doc[at]], "i": made.nth[at].astype(np.int32), "n": n.astype(np.int32), "h1": h1, "h2": h2})

    some = docs.where(F.col(key).isNotNull() & (F.length(text) >= 2 * p.words - 1))
    return some.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).mapInPandas(run, "doc long, i int, n int, h1 long, h2 long")


def repeated(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, gone): for each document with a repeated run that is not the first in the order of (doc, i), these runs as i * 2^32 + n.

    A run is repeated if another document has it too (p.within: or the same one again). Rows with one key are one document; null
    keys, null and empty texts and texts with fewer words than a run have no runs; an empty table gives no rows. Two hashes of 64
    bits stand for a run. Runs are first counted by one of them, pre-aggregated, as numbers; they are made again from the texts, which
    is cheaper than keeping them all, to find those whose hash recurs, and only those are looked at further.
    """
    many = (F.min("doc") < F.max("doc")) if not p.within else (F.count("*") > 1)
    docs = docs.select(key, text)
    again = runs_of(docs, p, key, text).select("h1", "doc").groupBy("h1").agg(many.alias("many")).where("many").select("h1")
    again = save(again, "spans-again")
    some = save(runs_of(docs, p, key, text).join(again, "h1").select("doc", "i", "n", "h1", "h2"), "spans-some")
    drop(again)
    first = some.groupBy("h1", "h2").agg(F.min(F.struct("doc", "i")).alias("lo"), many.alias("many"), F.count("*").alias("c")).where("many")
    first = save(first.select("h1", "h2", F.col("lo.doc").alias("d"), F.col("lo.i").alias("j"), "c"), "spans-first")
    later = join_hot(some, first, ["h1", "h2"], "c").where("doc != d or i != j")
    packed = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    out = save(later.groupBy("doc").agg(F.collect_set(packed).alias("gone")), "spans-gone")
    drop(some, first)
    return out


def cut(texts: list[str | None], gone: list, p: Params) -> pd.DataFrame:
    """(t, n, r, w) of each text: without the pieces of the given runs, number of pieces, of removed ones, and of their words."""
    out: list[tuple] = []
    for first, chunk in _chunks(texts):
        made = Pieces(chunk, p)
        bound = np.searchsorted(made.doc, np.arange(len(chunk) + 1))
        for k, data in enumerate(chunk):
            text, runs, a, b = texts[first + k], gone[first + k], bound[k], bound[k + 1]
            if runs is None or not len(runs):
                out.append((text, b - a, 0, 0))
                continue
            runs = np.asarray(runs, dtype=np.int64)
            delta = np.zeros(b - a + 1, dtype=np.int64)
            np.add.at(delta, runs >> 32, 1)
            np.add.at(delta, (runs >> 32) + (runs & 0xFFFFFFFF), -1)
            drops = a + np.flatnonzero(np.cumsum(delta[:-1]) > 0)
            keep, at = [], 0
            for lo, hi in zip(made.lo[drops] - made.begins[k], made.hi[drops] - made.begins[k]):
                keep.append(data[at:lo])
                at = hi
            keep.append(data[at:])
            out.append((b"".join(keep).decode("utf-8", "surrogatepass"), b - a, len(drops), int((made.last[drops] - made.first[drops]).sum())))
    return pd.DataFrame(out, columns=["t", "n", "r", "w"])


def remove_repeated(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages taken out of `text`, and a struct column `spans` (n: sentences and parts of long ones that have
    a word, removed: those removed, removed_words).

    The first occurrence of a passage in the order of (key, place) stays. Rows without such a passage, and rows with a null key or
    text, keep their text as it is (n is 0 for a null one). A repeated row is cut like the others of its key. An empty table gives no rows.
    Other columns pass unchanged, but for an input column named `spans`, which is replaced.
    """
    doc, runs, done = unused(docs, "doc", "gone", "done")
    gone = repeated(docs, p, key, text).select(F.col("doc").alias(doc), F.col("gone").alias(runs))
    joined = docs.join(gone, docs[key].cast("long") == F.col(doc), "left")

    @F.pandas_udf("t string, n long, r long, w long")
    def without(t: pd.Series, g: pd.Series) -> pd.DataFrame:
        return cut(list(t), list(g), p)

    out = joined.withColumn(done, without(F.col(text), F.col(runs)))
    counts = F.struct(F.col(f"{done}.n").alias("n"), F.col(f"{done}.r").alias("removed"), F.col(f"{done}.w").alias("removed_words"))
    return out.select(*(F.col(f"{done}.t").alias(text) if c == text else F.col(c) for c in docs.columns if c != "spans"), counts.alias("spans"))


_S, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: The same in SQL for DuckDB, with the parameters' defaults.
ORACLE = rf"""
WITH s AS (
  SELECT doc_id, generate_subscripts(a, 1) AS si, unnest(a) AS x
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]{_S}+|\n)', '\1' || chr(1), 'g'), chr(1)) AS a FROM documents)
), t AS (
  SELECT doc_id, si, generate_subscripts(ws, 1) AS wi, unnest(ws) AS x, len(ws) AS n
  FROM (SELECT doc_id, si, CASE WHEN regexp_matches(x, '{_W}') THEN regexp_extract_all(x, '{_S}*{_W}+{_S}*') ELSE [x] END AS ws FROM s)
), m AS (
  SELECT doc_id, si, wi, x, n > 10 AND list_sum(list_transform(range(1, len(h), 2), lambda j: ('0x' || h[j:j + 1])::INTEGER)) % 5 = 0 AS mark
  FROM (SELECT *, hex(encode(regexp_extract(x, '{_W}+'))) AS h FROM t)
), o AS (
  SELECT *, coalesce(max(CASE WHEN mark THEN wi END) OVER (PARTITION BY doc_id, si ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM m
), p AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY si, k) AS i, x
  FROM (SELECT doc_id, si, opened + (wi - opened - 1) // 10 * 10 AS k, string_agg(x, '' ORDER BY wi) AS x FROM o GROUP BY ALL)
), w AS (SELECT doc_id, i, regexp_extract_all(x, '{_W}+') AS w FROM p),
f AS (
  SELECT doc_id, i, w, row_number() OVER o AS k, sum(len(w)) OVER o AS upto FROM w WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), e AS (SELECT doc_id, k, i, upto, upto - len(w) + 32 AS wanted FROM f),
l AS (SELECT doc_id, list(array_to_string(w, ' ') ORDER BY k) AS ws FROM f GROUP BY doc_id),
r AS (
  SELECT a.doc_id, a.k, b.k AS last, array_to_string(ws[a.k:b.k], ' ') AS g FROM e a ASOF JOIN e b ON a.doc_id = b.doc_id AND a.wanted <= b.upto JOIN l ON l.doc_id = a.doc_id
), again AS (SELECT g, min((doc_id, k)) AS f FROM r GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, last + 1)) AS k FROM r JOIN again USING (g) WHERE (doc_id, k) <> f),
out AS (SELECT f.doc_id, f.i, len(w) AS w FROM gone JOIN f ON f.doc_id = gone.doc_id AND f.k = gone.k),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS t FROM p ANTI JOIN out USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS r, sum(w) AS w FROM out GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(w, 0) AS BIGINT) AS removed_words,
       md5(coalesce(t, '')) AS text_md5
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
