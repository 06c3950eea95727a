"""Mixing sources to target weights by hierarchical budgets, in SQL expressions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import save, words

UNKNOWN = "unknown"
#: Hexadecimal digits of a document's order that name its bucket: a leaf is summed up in 16 ** DIGITS buckets.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """weights: of domains ("web"), languages ("web/en", or "*/en" in any domain) and sources ("web/en/src1", or "*/*/src1"), relative
    to siblings; what is not named has 1, what has 0 gets nothing. share: tokens wanted as a share of all tokens (total: as a
    number, instead). epochs: how often a document is used at most.
    """

    weights: Mapping[str, float] = field(default_factory=dict)
    share: float = 1.0
    total: int | None = None
    epochs: int = 1
    seed: int = 11


def _weight(path: list[Column], weights: Mapping[str, float]) -> Column:
    depth = len(path)
    own = {k: float(v) for k, v in weights.items() if k.count("/") == depth - 1}
    if not own:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for kv in own.items() for x in kv))
    name = F.concat_ws("/", *path)
    anywhere = F.concat_ws("/", *[F.lit("*")] * (depth - 1), path[-1])
    return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, anywhere), F.lit(1.0))


def fill(children: DataFrame, parent: list[str], name: str, budget: str, cap: str, weight: str) -> DataFrame:
    """children with `got`: the parent's budget in proportion to the weights, none above its cap.

    What a capped child leaves goes to its siblings by weight, until all is given or all are full. With children in the order
    of cap / weight, all up to some child are full, and the rest share evenly per weight what is left.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight))
    rows = children.withColumn("__r", ratio).withColumn("__w", F.when(F.col("__r").isNull(), 0.0).otherwise(F.col(weight)))
    ordered = Window.partitionBy(*parent).orderBy(F.col("__r").asc_nulls_last(), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest_w = F.sum("__w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.nullif(rest_w, F.lit(0.0))
    rows = rows.withColumn("__k", F.row_number().over(ordered)).withColumn("__l", level)
    stop = F.min(F.when(F.col("__r") >= F.col("__l"), F.struct("__k", "__l"))).over(Window.partitionBy(*parent))
    got = F.when(F.col("__r").isNull(), 0.0).otherwise(F.least(cap, F.coalesce(stop["__l"] * F.col("__w"), F.col(cap))))
    return rows.withColumn("got", got).drop("__r", "__w", "__k", "__l")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget): whole tokens for each leaf of the tree, given the tokens it has.

    A leaf can take its tokens times the epochs; a node what its leaves can. Budgets go down from the root: shortages are shared
    among siblings, and reach an ancestor's siblings only if the whole node is full.
    """
    three = leaves.withColumn("cap", F.col("tokens") * F.lit(float(mix.epochs)))
    two = three.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    one = two.groupBy("domain").agg(F.sum("cap").alias("cap"))
    whole = F.sum("cap").over(Window.partitionBy(F.lit(0)))
    wanted = F.lit(float(mix.total)) if mix.total is not None else whole / mix.epochs * mix.share
    one = one.withColumns({"root": F.lit(0), "w": _weight([F.col("domain")], mix.weights)})
    # nodes that weigh nothing take nothing, so that the rest is never asked for more than it has
    one = fill(one.withColumn("b", F.least(wanted, whole)), ["root"], "domain", "b", "cap", "w").select("domain", F.col("got").alias("b"))
    two = two.join(one, "domain").withColumn("w", _weight([F.col("domain"), F.col("lang")], mix.weights))
    two = fill(two, ["domain"], "lang", "b", "cap", "w").select("domain", "lang", F.col("got").alias("b"))
    three = three.join(two, ["domain", "lang"]).withColumn("w", _weight([F.col("domain"), F.col("lang"), F.col("source")], mix.weights))
    three = fill(three, ["domain", "lang"], "source", "b", "cap", "w")
    return three.select("domain", "lang", "source", "tokens", F.floor(F.col("got") + 1e-6).cast("long").alias("budget"))


def choose(docs: DataFrame, mix: Mix, domain: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, domain, lang, source, n_tokens, copies) for each row: how many epochs use the document (0: it is left out).

    Tokens are words. A leaf with budget b and t tokens uses every document b div t times, and in one more epoch the documents
    that come first in the seeded order of that epoch while their tokens together stay within what is left. Null domains,
    languages and sources are `unknown`; null and empty texts have no tokens and are used as often as the full epochs. Rows with
    one key have one place in the order and are chosen together.

    The order is a hash; a leaf is first summed up by its leading digits, so that only the bucket in which the budget ends is put
    in order document by document, wherever its rows are.
    """
    named = lambda c: F.coalesce(c, F.lit(UNKNOWN))
    flat = docs.select(
        F.col(key),
        named(domain).alias("domain"),
        named(F.col(lang)).alias("lang"),
        named(F.col(source)).alias("source"),
        F.size(words(F.col(text))).cast("long").alias("n_tokens"),
    )
    flat = save(flat, "mix")
    leaf = ["domain", "lang", "source"]
    plan = save(budgets(flat.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), mix), "mix-plan", 1)
    plan = plan.select(*leaf, F.when(F.col("tokens") > 0, F.col("budget").cast("long") - F.expr("budget % tokens")).otherwise(0).alias("__full"), "tokens", "budget")
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(mix.epochs))
    plan = plan.select(*leaf, epochs.cast("int").alias("__e"), (F.col("budget") - F.col("__full")).alias("__left"))
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("__e").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    placed = flat.join(plan, leaf).withColumn("__u", order).withColumn("__b", F.substring("__u", 1, DIGITS))
    sums = placed.groupBy(*leaf, "__left", "__b").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("__b"))
    sums = sums.withColumn("upto", upto).select(*leaf, "__b", F.col("upto").alias("__upto"), (F.col("upto") - F.col("n")).alias("__base"))
    placed = placed.join(sums, [*leaf, "__b"])
    edge = placed.where("__upto > __left and __base < __left").groupBy(*leaf, "__b", "__base", "__left", "__u").agg(F.sum("n_tokens").alias("n"))
    run = F.col("__base") + F.sum("n").over(Window.partitionBy(*leaf, "__b").orderBy("__u"))
    edge = edge.withColumn("__end", run).where("__end <= __left").select(*leaf, "__u", F.lit(1).alias("__in"))
    placed = placed.join(edge, [*leaf, "__u"], "left")
    more = F.when(F.col("__upto") <= F.col("__left"), 1).otherwise(F.coalesce("__in", F.lit(0)))
    more = F.when((F.col("__left") > 0) & (F.col("__e") < mix.epochs), more).otherwise(0)
    return placed.select(key, *leaf, "n_tokens", (F.col("__e") + more).cast("int").alias("copies"))


def mix(docs: DataFrame, how: Mix, domain: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with each row as often as it is used. Rows with a null key are placed as one document."""
    chosen = choose(docs, how, domain, key, text, lang, source).where("copies > 0").select(F.col(key).alias("__key"), "copies").distinct()
    out = docs.join(chosen, docs[key].eqNullSafe(F.col("__key")))
    if how.epochs > 1:
        out = out.withColumn("__n", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*docs.columns)


#: The production mix of the registered query.
PRODUCTION = Mix(
    weights={"crawl": 0.3, "curated": 0.5, "reference": 0.2, "*/en": 0.5, "*/de": 0.2, "*/fr": 0.2, "*/es": 0.1},
    epochs=2,
)


def domain_of(source: Column) -> Column:
    """The domain of a source: the crawl, and two kinds of smaller sources by number. Null stays null."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1)
    return F.when(source == "src0", "crawl").when(F.try_to_number(number, F.lit("999999999")) % 2 == 1, "curated").when(source.isNotNull(), "reference")


def _fill_sql(out: str, rows: str, parent: str, name: str) -> str:
    return f"""
{out}_o AS (SELECT *, cap / w AS r, row_number() OVER (PARTITION BY {parent} ORDER BY cap / w, {name}) AS k,
  (b - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM {rows}),
{out} AS (SELECT *, least(cap, coalesce(min(CASE WHEN r >= l THEN {{'k': k, 'l': l}} END) OVER (PARTITION BY {parent}).l * w, cap)) AS got FROM {out}_o)"""


#: The same in SQL for DuckDB.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 2 = 1 THEN 'curated'
                 WHEN source IS NOT NULL THEN 'reference' ELSE 'unknown' END AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CAST(len(list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, sum(n_tokens) * 2.0::DOUBLE AS cap FROM d GROUP BY ALL),
two0 AS (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL),
one0 AS (SELECT domain, 0 AS root, sum(cap) AS cap, sum(sum(cap)) OVER () / 2 AS b,
  CASE domain WHEN 'crawl' THEN 0.3::DOUBLE WHEN 'curated' THEN 0.5::DOUBLE WHEN 'reference' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS w FROM two0 GROUP BY domain),
{_fill_sql("one", "one0", "root", "domain")},
two1 AS (SELECT two0.*, got AS b, CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'es' THEN 0.1::DOUBLE WHEN 'unknown' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS w FROM two0 JOIN one USING (domain)),
{_fill_sql("two", "two1", "domain", "lang")},
three1 AS (SELECT leaf.*, got AS b, 1.0::DOUBLE AS w FROM leaf JOIN two USING (domain, lang)),
{_fill_sql("three", "three1", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, tokens, CAST(floor(got + 1e-6) AS BIGINT) AS budget FROM three),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 2 END AS e, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM plan),
u AS (SELECT d.*, e, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11:' || e || ':' || doc_id)) AS upto FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(e + CASE WHEN e < 2 AND rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM u
"""
