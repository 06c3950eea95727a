"""Near-duplicate lines by an exact set-similarity join, in SQL expressions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import BLANKS, drop, join_hot, let, maybe_in, save, unused

#: Buckets of the token frequency table. Its size is fixed; tokens of one bucket are told apart by their hash.
BUCKETS = 1 << 16
#: A token in the short prefixes of more classes is compared with a few of them before the rest.
HOT = 256
#: How many more lines of such a token, spread by hash, are compared with all others before the rest.
ANCHORS = 6

#: Passes in which lines meet, each with a share of the tokens.
PARTS = 2
#: Tokens of a set from which on it has a second map.
WIDE = 64


def _plain(text: Column, blanks: str = BLANKS) -> Column:
    """The text with every one of these white spaces as a blank; only texts that have one are rewritten."""
    other = functools.reduce(lambda a, c: a | text.contains(c), blanks[1:], text.contains(blanks[0]))
    return F.when(other, F.translate(text, blanks, " " * len(blanks))).otherwise(text)


#: White spaces that do not end a line.
WITHIN = BLANKS.replace("\n", "")


def hashed(line: Column) -> Column:
    """The hashes of the distinct tokens of a line whose words stand between blanks; none if it has no word."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line) for each line of each text, with blanks for its white space; null texts and null keys have none."""
    lines = F.split(_plain(F.col(text), WITHIN), "\n")
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.posexplode(lines).alias("pos", "line"))


def frequency_classes(docs: DataFrame, text: str) -> Column:
    """Array literal: for each hash bucket of tokens, a class that grows with the bucket's count over all rows."""
    flat = F.replace(_plain(F.col(text), WITHIN), F.lit("\n"), F.lit(" "))
    counted = docs.select(F.explode(F.split(flat, " ")).alias("t")).select(F.xxhash64("t").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b"))
    classes = [0] * BUCKETS
    for b, c in counted.groupBy("b").count().select("b", (F.log2("count") * 2).cast("int")).collect():
        classes[b] = c
    return F.expr(f"cast(split('{','.join(map(str, classes))}', ',') as array<int>)")


def ranked(line: Column, classes: Column) -> Column:
    """The line's token set as sorted longs: frequency class first, then hash, so that rare tokens come first everywhere alike."""

    def code(h: Column) -> Column:
        # never null, so that the longs are sorted as primitives
        kind = F.coalesce(F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0)).cast("long")
        return F.shiftleft(kind, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.transform(hashed(line), code))


def _prefix(n: Column, similarity: int) -> Column:
    """How many of its first tokens a set of n must share one of with any set at least as similar, whatever its size."""
    return n - F.ceil(n * F.lit(similarity) / F.lit(100.0) - 1e-9).cast("int") + 1


def _short_prefix(n: Column, similarity: int) -> Column:
    """The same towards sets that are no smaller."""
    return n - F.ceil(n * F.lit(2.0 * similarity / (100 + similarity)) - 1e-9).cast("int") + 1


def _may_match(similarity: int) -> Column:
    """Length, prefix, positional and bitmap filters on two postings (n: set size, i: place of the shared token from 1): x, the
    smaller set or of equal ones the first, with its short prefix, and y with its whole prefix, so that two sets meet once for a token.

    A map's bit is the parity of the tokens whose hash names it, so every bit that differs stands for a token that only one
    set has. `all` is the map of all tokens; sets of more than WIDE have a second one for half of them, and the rest follows from both.
    """
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i")
    length = (n * 100 >= m * similarity) & ((n < m) | ((n == m) & (F.col("x.id") < F.col("y.id"))))
    place = (1 + F.least(n - i, m - j)) * (100 + similarity) >= (n + m) * similarity
    every = F.col("x.all").bitwiseXOR(F.col("y.all"))
    half = F.col("x.half").bitwiseXOR(F.col("y.half"))
    differ = F.when((n > WIDE) & (m > WIDE), F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))).otherwise(F.bit_count(every))
    few = (n + m - differ) * (100 + similarity) >= (n + m) * (2 * similarity)
    return length & few & place


def later_matches(docs: DataFrame, similarity: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos) of every line whose token set has a Jaccard similarity of at least `similarity` per cent with an earlier line's.

    Lines come in the order (doc, pos), pos from 0. Lines without a word match nothing. A line is compared with all earlier ones,
    removed or not. Rows with one key are one document: a repeated row's lines count once. Null texts and keys and an empty table
    give no rows. The result is exact.

    Lines with equal sets form one class, represented by its first line; all others of it are later matches. Classes are numbered
    in the order of their first lines. Only the first tokens of each class (rarest first, over the whole corpus) are exchanged, with
    the class's number, its size and two maps of its tokens. Where a token starts more than HOT classes, these are first compared
    with the first of them and a few others; what has a match by then need not be verified again. Then all classes meet by token,
    in PARTS passes so that the exchanged files stay small: the larger set's prefix against the smaller set's shorter one. Candidates
    are verified on their full sets.
    """
    docs = docs.select(F.col(key), F.col(text))
    classes = frequency_classes(docs, text)
    zero = F.lit(0).cast("long")
    bit = lambda x, one: F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))

    lines = exploded(docs, key, text).where(F.trim("line") != "").select("doc", "pos", ranked(F.col("line"), classes).alias("s"))
    # a step of its own, not a bound lambda: what is within a lambda is not compiled
    s, n = F.col("s"), F.size("s")
    every = F.aggregate(s, zero, lambda a, x: a.bitwiseXOR(bit(x, F.lit(1).cast("long"))))
    half = F.aggregate(s, zero, lambda a, x: a.bitwiseXOR(bit(x, F.shiftright(x, 6).bitwiseAND(F.lit(1)))))
    h1, h2 = F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), F.reverse(s)).alias("h2")
    maps = every.alias("all"), F.when(n > WIDE, half).otherwise(zero).alias("half")
    wide = save(lines.select("doc", "pos", h1, h2, n.alias("n"), *maps, F.slice(s, F.lit(1), _prefix(n, similarity)).alias("p")), "lines")
    first = wide.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos", "n", "all", "half", "p")).alias("m"), F.count("*").alias("c"))
    first = save(first.select("h1", "h2", "c", "m.*").orderBy("doc", "pos").withColumn("id", F.monotonically_increasing_id()), "line-classes")
    flat = save(wide.select("doc", "pos", "h1", "h2"), "lines")
    drop(wide)

    def postings(rows: DataFrame, *more: str) -> DataFrame:
        out = rows.select("id", "n", "all", "half", *more, F.posexplode("p").alias("i", "t"))
        return out.select("t", "id", "n", (F.col("i") + 1).alias("i"), "all", "half", *more)

    # all classes of a hot token against a few of them; either may be the larger set
    short = first.select(F.explode(F.slice("p", F.lit(1), _short_prefix(F.col("n"), similarity))).alias("t"))
    hot_tokens = save(short.groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("t"), "line-hot")
    done = None
    if hot_tokens.limit(1).count():
        hot = save(postings(first).join(hot_tokens, "t"), "line-hot")
        post = F.struct("id", "n", "i", "all", "half")
        spread = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), post.alias("m"))).alias(f"a{k}") for k in range(ANCHORS)]
        anchor = hot.groupBy("t").agg(F.min(post).alias("m"), *spread)
        anchor = save(anchor.select("t", F.explode(F.array_distinct(F.array("m", *(F.col(f"a{k}.m") for k in range(ANCHORS))))).alias("m")).select("t", "m.*"), "line-anchors")
        ends = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
        in_short = F.col("x.i") <= _short_prefix(F.col("x.n"), similarity)
        sides = [x.alias("x").join(y.alias("y"), (F.col("x.t") == F.col("y.t")) & in_short & _may_match(similarity)).select(*ends) for x, y in ((hot, anchor), (anchor, hot))]
        met = save(sides[0].union(sides[1]).distinct(), "line-pairs")
        done = save(_verified(docs, met, first, similarity, key, text), "line-matches")
        drop(hot, anchor, met)
    drop(hot_tokens)
    settled = F.lit(False) if done is None else F.col("settled")
    rest = first if done is None else first.join(done.withColumn("settled", F.lit(True)), "id", "left").fillna(False, ["settled"])
    flagged = save(rest.select("id", "n", "all", "half", "p", settled.alias("r")), "line-flagged")
    pairs = []
    for part in range(PARTS):
        some = postings(flagged, "r").where(F.pmod("t", F.lit(PARTS)) == part)
        index = some.where(F.col("i") <= _short_prefix(F.col("n"), similarity))
        open_ = F.when(F.col("x.id") < F.col("y.id"), ~F.col("y.r")).otherwise(~F.col("x.r"))
        met = some.alias("y").join(index.alias("x"), (F.col("x.t") == F.col("y.t")) & open_ & _may_match(similarity))
        pairs.append(save(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "line-pairs"))
    drop(flagged)
    late = save(_verified(docs, functools.reduce(DataFrame.union, pairs).distinct(), first, similarity, key, text), "line-matches")
    gone = (late if done is None else done.union(late)).distinct().withColumn("gone", F.lit(True))
    kept = first.select("id", "h1", "h2", "c", F.col("doc").alias("d"), F.col("pos").alias("q")).join(gone, "id", "left")
    kept = save(kept.select("h1", "h2", "c", F.when(F.col("gone").isNull(), F.col("d")).alias("d"), F.when(F.col("gone").isNull(), F.col("q")).alias("q")), "line-kept")
    out = join_hot(flat, kept, ["h1", "h2"], "c").where("d is null or d != doc or q != pos").select("doc", "pos")
    out = save(out.distinct(), "line-gone")
    drop(flat, first, kept, late, *pairs, *([] if done is None else [done]))
    return out


def _verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, similarity: int, key: str, text: str) -> DataFrame:
    """(id) of the later class of each pair (a, b) whose full sets are similar enough; the sets are made anew from the texts."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = save(first.select("id", "doc", "pos").join(wanted, "id", "left_semi"), "line-wanted")
    of_doc = wanted.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("pos", "id")).alias("at"))
    whole = docs.select(F.col(key).cast("long").alias("doc"), F.split(F.col(text), "\n").alias("lines")).where(maybe_in(wanted, "doc"))
    lines = whole.join(of_doc, F.col("doc") == F.col("d")).select("lines", F.explode("at").alias("at"))
    sets = save(lines.select("at.id", hashed(_plain(F.get("lines", F.col("at.pos")))).alias("s")).dropDuplicates(["id"]), "line-sets")
    both = F.size(F.array_intersect("sa", "sb"))
    similar = both * (100 + similarity) >= (F.size("sa") + F.size("sb")) * similarity
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = save(met.where(similar).select(F.col("b").alias("id")).distinct(), "line-similar")
    drop(wanted, sets)
    return out


def deduplicate(docs: DataFrame, similarity: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later matches taken out of `text`, and a struct column `lines` (n: lines, removed: lines removed).

    Null and empty texts, and rows with a null key, stay as they are (n is 0 for a null one). Repeated rows of a key are cut alike;
    an empty table gives no rows. Other columns pass unchanged, but for an input column named `lines`, which is replaced.
    """
    doc, places, done = unused(docs, "doc", "gone", "done")
    gone = later_matches(docs, similarity, key, text).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("pos").alias(places))
    joined = docs.join(gone, docs[key].cast("long") == F.col(doc), "left")
    split = F.split(F.col(text), "\n")
    found = F.when(F.col(places).isNull(), F.struct(F.col(text).alias("t"), F.size(split).alias("n"), F.lit(0).alias("r")))
    found = found.otherwise(
        let(split, lambda x: F.struct(F.array_join(F.filter(x, lambda _, i: ~F.array_contains(F.col(places), i)), "\n").alias("t"), F.size(x).alias("n"), F.size(places).alias("r")))
    )
    out = joined.withColumn(done, found)
    counts = F.struct(F.coalesce(f"{done}.n", F.lit(0)).cast("long").alias("n"), F.col(f"{done}.r").cast("long").alias("removed"))
    return out.select(*(F.col(f"{done}.t").alias(text) if c == text else F.col(c) for c in docs.columns if c != "lines"), counts.alias("lines"))


#: The same in SQL for DuckDB, over all pairs of different sets that share a token (for small tables).
ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
), s AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split(translate(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> ''))) AS s FROM l
), c AS (
  SELECT s, min((doc_id, pos)) AS f, len(s) AS n, row_number() OVER () AS k FROM s WHERE len(s) > 0 GROUP BY s
), t AS (SELECT k, f, n, unnest(s) AS t FROM c),
df AS (SELECT t, count(*) AS df FROM t GROUP BY t),
r AS (SELECT k, f, n, t, row_number() OVER (PARTITION BY k ORDER BY df, t) AS i FROM t JOIN df USING (t)),
p AS (SELECT * FROM r WHERE i <= n - ceil(n * 0.8 - 1e-9) + 1),
cand AS (SELECT DISTINCT a.k AS x, b.k AS y FROM p a JOIN p b ON a.t = b.t AND a.f < b.f AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT y FROM cand JOIN c a ON a.k = x JOIN c b ON b.k = y WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n)),
gone AS (
  SELECT doc_id, pos FROM s JOIN c ON s.s = c.s WHERE (doc_id, pos) <> f OR k IN (SELECT y FROM m)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, md5(coalesce(t, '')) AS text_md5
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
