"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
ORDERS = (1, 2, 3)
#: Characters worked on at once; longer texts are read in slices of so many, whose n-grams do not cross.
SLICE = 1 << 19
#: Texts are taken together up to about so many characters, so that a worker's arrays stay small.
TOGETHER = 1 << 16
#: Rows the classifier is fitted on at most (those with the smallest hashed ids).
MAX_TRAIN_ROWS = 8192
#: The score weighs a text as if it had so many n-grams at most, so that long texts are not all at 1.
EVIDENCE = 60
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank."""
    if not _TABLE:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Yields (rows, starts, hashed n-grams by order) for texts, a few slices at a time.

    rows: the texts that have n-grams here; starts: where each one's run begins. Letters are lower-cased, runs of other
    characters become one blank. A place without an n-gram of an order has the index 2 ** BITS.
    """
    pieces, owners, held = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t), SLICE):
            pieces.append(t[at : at + SLICE])
            owners.append(k)
            held += len(pieces[-1])
            if held >= TOGETHER:
                yield from _hashed(pieces, owners)
                pieces, owners, held = [], [], 0
    if pieces:
        yield from _hashed(pieces, owners)


def _hashed(pieces: list[str], owners: list[int]):
    raw = np.frombuffer((" ".join(pieces) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    chars = _letters()[raw]
    keep = chars != 32
    keep[1:] |= chars[:-1] != 32
    ends = np.cumsum([len(p) + 1 for p in pieces])
    ends = np.cumsum(keep)[ends - 1]
    chars = chars[keep]
    lengths = np.diff(ends, prepend=0)
    full = lengths > 0
    if not full.any():
        return
    left = np.repeat(ends, lengths) - np.arange(len(chars))  # characters up to the end of the own text
    out, code = [], np.zeros(len(chars), dtype=np.uint32)
    for n in ORDERS:
        shifted = np.zeros(len(chars), dtype=np.uint32)
        shifted[: len(chars) - n + 1] = chars[n - 1 :]
        code = code * np.uint32(0x01000193) + shifted + np.uint32(n)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        at = ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32)
        at[left < n] = 1 << BITS
        out.append(at)
    yield np.asarray(owners)[full], (ends - lengths)[full], out


@dataclass
class Model:
    """Languages, their log priors and the matrix of log probabilities (one row per hashed n-gram, the last one zero)."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text. `und` with score 0 for null, for no letter, or without languages."""
        total = np.zeros((len(texts), max(1, len(self.langs))))
        seen = np.zeros(len(texts))
        for rows, starts, orders in grams([t or "" for t in texts]) if self.langs else ():
            each = self.weights[orders[0]]
            for at in orders[1:]:
                each += self.weights[at]
            np.add.at(total, rows, np.add.reduceat(each, starts, axis=0))
            np.add.at(seen, rows, np.diff(starts, append=len(each)))
        best = (total + self.prior).argmax(axis=1) if self.langs else np.zeros(len(texts), int)
        soft = total * np.minimum(1.0, EVIDENCE / np.maximum(seen * len(ORDERS), 1))[:, None]
        soft = np.exp(soft - soft.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        score = np.where(seen > 0, soft[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, seen)], score


def train_rows(key: str = "doc_id") -> Column:
    """Rows that may be learned from: the others are held out."""
    return ~held_out(key)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: Column | None = None, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Counts n-grams per language on at most max_rows labelled rows and returns the smoothed model.

    Only n-gram sums reach the driver: at most 2 ** BITS numbers per language. No labelled rows: a model without languages.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    known = known.where(rows) if rows is not None else known
    order = F.xxhash64(F.col(key))
    last = known.select(order.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], np.zeros(1), np.zeros(((1 << BITS) + 1, 1)))
    sample = known.where(order <= F.lit(last)).select(F.col(label).alias("lang"), F.col(text).alias("text"))

    def count(parts):
        for pdf in parts:
            for lang, texts in pdf.groupby("lang")["text"]:
                n = np.zeros((1 << BITS) + 1, dtype=np.int64)
                for _, _, orders in grams(list(texts)):
                    for at in orders:
                        n += np.bincount(at, minlength=len(n))
                at = np.flatnonzero(n[:-1])
                yield pd.DataFrame({"lang": lang, "at": np.append(at, -1), "n": np.append(n[at], len(texts))})

    sums = sample.mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    where = {x: k for k, x in enumerate(langs)}
    column = sums["lang"].map(where).to_numpy()
    counts, docs_of = np.full((1 << BITS, len(langs)), 0.5), np.ones(len(langs))
    at, n = sums["at"].to_numpy(), sums["n"].to_numpy()
    counts[at[at >= 0], column[at >= 0]] += n[at >= 0]
    docs_of[column[at < 0]] = n[at < 0]
    weights = np.vstack([np.log(counts / counts.sum(axis=0)), np.zeros((1, len(langs)))])
    return Model(langs, np.log(docs_of / docs_of.sum()), weights)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). Nothing but the text is looked at; no shuffle; the model is broadcast (2 ** BITS numbers per language).

    A condition on them stays behind the classifier: pushed below, it would classify every text a second time, in a second worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, score = sent.value.score(list(texts))
            yield pd.DataFrame({"lang_pred": langs, "score": score})

    return docs.withColumn("__p", run.asNondeterministic()(F.col(text))).withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")


def identify(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row, fitted on the rows that are not held out.

    Null texts and texts without a letter: `und`, score 0; a null key counts as an empty one for holding out.
    """
    model = fit(docs, text, label, key, train_rows(key))
    return predict(docs.select(key, text), model, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
