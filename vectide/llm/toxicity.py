"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Words of a window, and from one window's start to the next: windows overlap by the difference.
WINDOW, STEP = 64, 48
WORD_BITS, GRAM_BITS = 13, 13
GRAMS = (3, 4, 5)
#: Sizes: word and character inputs, state of each direction, attention.
D_WORD, D_CHAR, STATE, ATTEND = 8, 12, 8, 8
#: Labelled rows trained on at most, of each class (those with the smallest hashed ids).
MAX_TOXIC, MAX_CLEAN = 1500, 2000
#: Passes in which all windows of a text come up once: each takes every TURNS-th of them, or one of a text that has fewer.
TURNS = 4
BATCH, RATE = 128, 0.01
#: Least number of steps (few labels are gone over more often), and the share of words whose own embedding is left out of a step.
STEPS, DROP = 300, 0.5
#: How fast the tables of words and grams shrink, for each unit of the rate.
DECAY = 3.0
#: Words scored together.
CHUNK = 400_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def starts_of(n: int) -> range:
    """Where the windows of n words begin; the last one reaches the end. No words: one empty window."""
    return range(0, max(n - WINDOW + STEP, 1), STEP)


def windows_of(words: list[str]) -> list[list[str]]:
    return [words[s : s + WINDOW] for s in starts_of(len(words))]


def inputs_of(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, gram buckets of all words in a row, how many each word has) of distinct words."""
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1) for w in words), np.int64, len(words))
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    lengths = np.diff(ends, prepend=0)
    left = np.repeat(ends, lengths) - np.arange(len(chars))
    owner = np.repeat(np.arange(len(words)), lengths)
    places, owners, code = [], [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(chars), np.uint32)
        shifted[: max(len(chars) - n + 1, 0)] = chars[n - 1 :]
        code = (code ^ shifted) * np.uint32(0x01000193) + np.uint32(n)
        if n in GRAMS:
            ok = left >= n
            mixed = code ^ (code >> np.uint32(15))
            places.append(((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS))[ok].astype(np.int64))
            owners.append(owner[ok])
    places, owners = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return own, places[order], np.bincount(owners, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * np.clip(x, -15, 15))) - 1


@dataclass
class Net:
    """Parameters by name: word and gram tables; for each direction input weights, recurrent weights and bias of the update and
    reset gates and the candidate; attention; output. `top` turns a text's window logits into its score."""

    p: dict[str, np.ndarray]
    top: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    @classmethod
    def fresh(cls, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        d = D_WORD + D_CHAR
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"word": np.zeros((1 << WORD_BITS, D_WORD), np.float32), "gram": (rng.standard_normal((1 << GRAM_BITS, D_CHAR)) * 0.1).astype(np.float32)}
        for k in "fb":
            p |= {f"w{k}": r(d, 3 * STATE), f"u{k}": r(STATE, 3 * STATE), f"c{k}": np.zeros(3 * STATE, np.float32)}
        return cls(p | {"wa": r(2 * STATE, ATTEND), "va": r(ATTEND), "o": r(2 * STATE), "b": np.array([-2.0], np.float32)})

    def vectors(self, own: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words: own embedding beside the mean of the character grams'."""
        out = np.zeros((len(own), D_WORD + D_CHAR), np.float32)
        out[:, :D_WORD] = self.p["word"][own]
        full = np.flatnonzero(counts)
        if len(full):
            at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
            out[full, D_WORD:] = np.add.reduceat(self.p["gram"][places], at, axis=0) / counts[full, None]
        return out

    def run(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: x are vectors of distinct words, index (windows, WINDOW) names them, mask is 1 for real words.

        keep: also what the gradient needs."""
        p, n, h_n = self.p, len(index), STATE
        states, memo = np.zeros((n, WINDOW, 2 * h_n), np.float32), {}
        for k, side in (("f", slice(0, h_n)), ("b", slice(h_n, 2 * h_n))):
            gates = x @ p[f"w{k}"] + p[f"c{k}"]
            u, h, kept = p[f"u{k}"], np.zeros((n, h_n), np.float32), []
            for t in range(WINDOW) if k == "f" else reversed(range(WINDOW)):
                g, m = gates[index[:, t]], mask[:, t, None]
                zr = _sigmoid(g[:, : 2 * h_n] + h @ u[:, : 2 * h_n])
                z, r = zr[:, :h_n], zr[:, h_n:]
                c = _tanh(g[:, 2 * h_n :] + (r * h) @ u[:, 2 * h_n :])
                new = h + m * z * (c - h)
                if keep:
                    kept.append((t, h, z, r, c))
                states[:, t, side] = h = new
            memo[k] = kept
        a = _tanh(states @ p["wa"])
        e = a @ p["va"] - 1e4 * (1 - mask)
        w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", w, states)
        logit = pooled @ p["o"] + p["b"][0]
        return (logit, states, a, w, pooled, memo) if keep else logit

    def gradient(self, own, places, counts, index, mask, label, weight, heard=None) -> dict[str, np.ndarray]:
        """Gradient of the weighted log loss, back through attention, time and the input tables.

        heard: factors of the distinct words' own embeddings, which teach the net to spell if some are 0."""
        p, h_n = self.p, STATE
        x = self.vectors(own, places, counts)
        heard = np.ones((len(own), 1), np.float32) if heard is None else heard
        x[:, :D_WORD] *= heard
        logit, states, a, w, pooled, memo = self.run(x, index, mask, True)
        d_logit = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        g = {"o": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["o"]
        d_states = w[:, :, None] * d_pool[:, None, :]
        d_w = np.einsum("nth,nh->nt", states, d_pool)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", d_e, a)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.einsum("nth,nta->ha", states, d_a)
        d_states += d_a @ p["wa"].T
        d_x = np.zeros_like(x)
        for k, side in (("f", slice(0, h_n)), ("b", slice(h_n, 2 * h_n))):
            u, wk = p[f"u{k}"], p[f"w{k}"]
            g[f"u{k}"] = np.zeros_like(u)
            d_gate = np.zeros((len(x), 3 * h_n), np.float32)
            d_h = np.zeros((len(index), h_n), np.float32)
            for t, h, z, r, c in reversed(memo[k]):
                m = mask[:, t, None]
                d_h = d_h + d_states[:, t, side]
                d_new = d_h * m
                d_c = d_new * z * (1 - c * c)
                d_z = d_new * (c - h) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * h_n :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.hstack([d_z, d_r])
                g[f"u{k}"][:, : 2 * h_n] += h.T @ d_zr
                g[f"u{k}"][:, 2 * h_n :] += (r * h).T @ d_c
                np.add.at(d_gate, index[:, t], np.hstack([d_zr, d_c]))
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ u[:, : 2 * h_n].T
            g[f"w{k}"], g[f"c{k}"] = x.T @ d_gate, d_gate.sum(axis=0)
            d_x += d_gate @ wk.T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], own, d_x[:, :D_WORD] * heard)
        np.add.at(g["gram"], places, np.repeat(d_x[:, D_WORD:] / np.maximum(counts, 1)[:, None], counts, axis=0))
        return g

    def train(self, texts: list[list[list[str]]], label: np.ndarray, seed: int = 6) -> Net:
        """Adam over shuffled batches of the texts' windows; TURNS passes see every window, and passes come in whole rounds of them.

        Classes weigh by the root of their odds among texts; a text's windows in a pass weigh less, the more there are."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = max(label.mean(), 1e-3)
        odds = np.where(label > 0, np.sqrt((1 - share) / share), 1.0)
        turns = []
        for turn in range(TURNS):
            taken = [t[turn::TURNS] or [t[turn % len(t)]] for t in texts]
            sizes = np.fromiter(map(len, taken), np.int64, len(taken))
            turns.append(([w for part in taken for w in part], np.repeat(label, sizes), np.repeat(odds / np.sqrt(sizes), sizes).astype(np.float32)))
        per_round = sum(-(-len(t[0]) // BATCH) for t in turns)
        step, epochs = 0, TURNS * -(-STEPS // per_round)
        for epoch in range(epochs):
            windows, known, weight = turns[epoch % TURNS]
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                uniq, index, mask = _indexed([windows[i] for i in part])
                heard = ((rng.random((len(uniq), 1)) >= DROP) / (1 - DROP)).astype(np.float32)
                g = self.gradient(*inputs_of(uniq), index, mask, known[part], weight[part], heard)
                step += 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in self.p.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    v -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                    if k in ("word", "gram"):
                        v *= np.float32(1 - rate * DECAY)
        return self

    def facts(self, texts: list[str | None]) -> np.ndarray:
        """(mean logit, highest logit) of each text over all its windows."""
        out = np.zeros((len(texts), 2))
        held, owner, total = [], [], 0
        best, sums, n = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))

        def flush():
            if held:
                uniq, index, mask = _indexed(held)
                logit = self.run(self.vectors(*inputs_of(uniq)), index, mask)
                at = np.asarray(owner)
                np.maximum.at(best, at, logit)
                np.add.at(sums, at, logit)
                np.add.at(n, at, 1)
                held.clear()
                owner.clear()

        for k, t in enumerate(texts):
            for w in windows_of(words_of(t)):
                held.append(w)
                owner.append(k)
                total += WINDOW
                if total >= CHUNK:
                    flush()
                    total = 0
        flush()
        if len(texts):
            out[:, 0], out[:, 1] = sums / n, best
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        f = self.facts(texts)
        return _sigmoid(np.hstack([f, np.ones((len(f), 1))]) @ self.top)


def _indexed(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, windows), np.int64, len(windows))
    codes, uniq = pd.factorize(np.array([w for part in windows for w in part] or [""], dtype=object))
    mask = (np.arange(WINDOW) < lengths[:, None]).astype(np.float32)
    index = np.zeros((len(windows), WINDOW), np.int64)
    index[mask > 0] = codes[: lengths.sum()]
    return list(uniq), index, mask


def _logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last factor is the constant."""
    x = np.hstack([f, np.ones((len(f), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = _sigmoid(x @ w)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (weight * (y - q)) - 1e-2 * w)
    return w


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Net:
    """A net trained on all windows of at most MAX_TOXIC and MAX_CLEAN labelled rows that are not held out.

    Without labels the net is untrained and scores every text alike below 0.5. Only the sample's words reach the driver.
    """
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("y"))
    named = named.where(~held_out(key))
    order = F.xxhash64(key)
    few = named.where("y = 1").orderBy(order, key).limit(MAX_TOXIC).union(named.where("y = 0").orderBy(order, key).limit(MAX_CLEAN)).withColumnRenamed(key, "__key")
    sample = docs.select(F.col(key), F.col(text).alias("t")).dropna(subset=["t"]).join(few, F.col(key) == F.col("__key")).select("y", "t")

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"y": pdf["y"], "w": [" ".join(words_of(t)) for t in pdf["t"]]})

    rows = sorted(map(tuple, sample.mapInPandas(words, "y int, w string").collect()))
    net = Net.fresh()
    if not rows:
        net.top = np.array([0.0, 0.0, -3.0])
        return net
    net.train([windows_of(w.split()) for _, w in rows], np.array([y for y, _ in rows], np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            f = sent.value.facts(list(pdf["t"]))
            yield pd.DataFrame({"y": pdf["y"], "a": f[:, 0], "b": f[:, 1]})

    f = np.array(sorted(map(tuple, sample.mapInPandas(measure, "y int, a double, b double").collect())))
    whole = dict(named.groupBy("y").count().collect())  # the sample's classes count as often as all labelled rows have them
    weight = np.array([whole[y] for y in f[:, 0]]) / np.where(f[:, 0] > 0, (f[:, 0] > 0).sum(), (f[:, 0] == 0).sum())
    net.top = _logistic(f[:, 1:], f[:, 0], weight)
    return net


def predict(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) over all overlapping windows of each whole text. Null and empty texts count as one empty window."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(sent.value.score(list(texts)))

    return docs.withColumn("score", run(F.col(text)))


def assess(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs; learned from labelled rows that are not held out.

    A null key counts as an empty one for holding out and has no label. Repeated rows score alike.
    """
    net = fit(docs, labels, key, text)
    scored = predict(docs.select(key, text), net, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
