"""Small cases of each operator: plain versions, nulls, empty and odd rows, clashing columns, empty tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectide.llm import langid, linededup, mixing, quality, sharding, substring, toxicity, vecdedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(900, None, None, None), (901, "", "en", "s"), (902, " \n\t ", None, "s"), (903, "éß", "de", None), (903, "éß", "de", None)]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def letters(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


# quality


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "bb", "#c", "d|", "\n", "\n", "é\t"], k=rng.randint(0, 200))) for _ in range(60)]
    texts += ["a a a a", "x y z x y z", "x\x0by\x0cz\r\n", "\u00a0a \u2003 b", "q " * 300]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)] + ODD).withColumn("quality", F.lit(7)).withColumnRenamed("quality", "n_words")
    rows = quality.judge(df, rules=list(quality.RULES)).collect()
    for r in rows:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == base(r.text)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert q.kept == (q.failed_rule is None) and not (q.base_failed and q.kept)
    assert quality.judge(df.limit(0)).collect() == []


def test_quality_order_is_by_rejection_per_cost_and_changes_no_verdict(spark):
    rng = random.Random(2)
    clean = letters(rng, ["ka", "lo", "mi", "ten"], 120)
    texts = [clean + " " + letters(rng, ["xo", "pa"], 5) for _ in range(30)] + [" ".join(w + "#" for w in letters(rng, ["ka", "lo", "mi", "ten", "sur"], 90).split()) for _ in range(10)]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    order = quality.order_rules(df)
    assert order[0][0].name == "symbols" and order[0][1] == pytest.approx(0.25, abs=0.01)
    verdicts = [{r.doc_id: r.quality.kept for r in quality.judge(df, rules=rules).collect()} for rules in (list(quality.RULES), list(reversed(quality.RULES)))]
    assert verdicts[0] == verdicts[1] and sum(verdicts[0].values()) == 30


# language


def test_language(spark):
    rng = random.Random(3)
    tongues = {"aa": ["ba", "ko", "lim"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "que", "oi"]}
    rows = [(i, letters(rng, tongues[k], 30), k, "s") for i, k in enumerate(rng.choices(list(tongues), k=240))]
    df = docs(spark, rows + ODD + [(904, "12 !? 34", "aa", "s"), (None, "ba ko lim", "aa", "s")]).withColumn("score", F.lit("x"))
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(ODD) + 2
    assert np.mean([by[i].lang_pred == k for i, _, k, _ in rows if by[i].held_out]) > 0.97
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902, 904)] == [("und", 0.0)] * 4
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0)).collect() == []
    blind = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blind} == {"und"}


def test_language_of_long_texts_is_summed_over_slices(monkeypatch):
    model = langid.Model(["x"], np.zeros(1), np.random.default_rng(1).random(((1 << langid.BITS) + 1, 1)))
    model.weights[-1] = 0
    monkeypatch.setattr(langid, "SLICE", 50)
    seen = sum(len(at) for _, _, orders in langid.grams(["ab " * 100, "", "cd"]) for at in orders[:1])
    assert 303 <= seen <= 303 + 6  # each slice ends with a blank
    assert model.score(["ab " * 100, "1"])[0] == ["x", "und"]


# lines


def brute_lines(rows, least=80):
    seen, out = [], {}
    for i, t, *_ in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        kept = []
        for line in [] if t is None else t.split("\n"):
            s = frozenset(WORD.findall(line))
            hit = bool(s) and any(100 * len(s & o) >= least * len(s | o) for o in seen)
            if s:
                seen.append(s)
            if not hit:
                kept.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_lines_against_all_pairs(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    pool, rows = [], []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            if pool and rng.random() < 0.6:
                w = rng.choice(pool[: 12 if rng.random() < 0.7 else None]).split(" ")
                for _ in range(rng.randint(0, 3)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            else:
                w = rng.choices(vocab, k=rng.choice([1, 2, 5, 12, 40, 90]))
            lines.append(" ".join(w))
            pool.append(lines[-1])
        rows.append((i, "\n".join(lines), "en", "s"))
    rows += ODD + [(904, "a\tb  c\x0b", None, None), (905, "c b a", None, None), (None, rows[0][1], None, None)]
    df = docs(spark, rows).withColumn("pos", F.lit(1)).withColumn("n", F.lit(2))
    got = linededup.deduplicate(df)
    assert got.columns == [*df.columns, "lines"]
    want = brute_lines(rows)
    for r in got.collect():
        assert r.text == (rows[0][1] if r.doc_id is None else want[r.doc_id])
    assert linededup.deduplicate(df.limit(0)).collect() == []


def test_hot_lines_are_settled_exactly(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 3)
    monkeypatch.setattr(linededup, "ANCHORS", 2)
    rng = random.Random(5)
    base_line = [f"b{k}" for k in range(30)]
    rows = []
    for i in range(80):
        w = list(base_line)
        for k in rng.sample(range(30), rng.randint(0, 6)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w), None, None))
    want = brute_lines(rows)
    assert {r.doc_id: r.text for r in linededup.deduplicate(docs(spark, rows)).collect()} == want


# passages


def plain_pieces(t, longest=10, every=5):
    """Sentences by regular expression; long ones word by word."""
    out = []
    for x in re.sub(r"([.!?][\x20\x09-\x0D]+|\n)", "\\1\x01", t).split("\x01"):
        words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", x)
        if len(words) <= longest:
            out.append(x)
            continue
        held = []
        for w in words:
            held.append(w)
            if sum(WORD.search(w)[0].encode()) % every == 0 or len(held) == longest:
                out.append("".join(held))
                held = []
        out.append("".join(held))
    return out


def brute_spans(rows, words=32, within=False):
    runs, texts = [], {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        texts[i] = (t, pieces := plain_pieces(t or ""))
        full = [k for k, x in enumerate(pieces) if WORD.search(x)]
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                w = WORD.findall("".join(pieces[k] + " " for k in full[a:b]))
                if len(w) >= words:
                    runs.append((tuple(w), i, a, full[a:b]))
                    break
    first, holders, gone = {}, {}, {}
    for w, i, a, ks in runs:
        first.setdefault(w, (i, a))
        holders.setdefault(w, set()).add(i)
    for w, i, a, ks in runs:
        if first[w] != (i, a) and (within or len(holders[w]) > 1):
            gone.setdefault(i, set()).update(ks)
    return {i: t if i not in gone else "".join(x for k, x in enumerate(pieces) if k not in gone[i]) for i, (t, pieces) in texts.items()}


@pytest.mark.parametrize("within", [False, True])
def test_passages_against_a_plain_pass(spark, within):
    rng = random.Random(6)
    vocab = ["alfa", "bets", "cod", "dé", "e%", "fo", "g,", "ha"]
    pool = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 14, 30]))).capitalize() + rng.choice(".!?") for _ in range(40)]
    rows = []
    for i in range(60):
        k = rng.randrange(30)
        own = [f"Own{i} {j} text here." for j in range(rng.randint(0, 4))]
        gap = rng.choice([" ", "  ", "\n", "\n\n", " \n \n\t"])
        rows.append((i, rng.choice(["", "\n ", " "]) + gap.join(own + pool[k : k + rng.randint(0, 6)] + own[:1]) + rng.choice(["", " ", "\n"]), None, None))
    shared = " ".join(f"wort{k}" for k in range(51))  # one long sentence, cut differently on either side
    rows += [(100, f"left {shared} right one", None, None), (101, f"Other start {shared} and another end of it.", None, None), (102, ("same again " * 40).strip(), None, None)]
    rows += [(103, "WORD!! " * 60, None, None), (104, "ou " * 300, None, None), (105, "x ou " + "ou " * 99, None, None)]
    rows += ODD + [(None, rows[0][1], None, None)]
    df = docs(spark, rows).withColumns({"i": F.lit(1), "spans": F.lit(2), "_doc": F.lit(3), "gone": F.lit(4)})
    got = substring.remove_repeated(df, substring.Params(within=within))
    assert got.columns == [*(c for c in df.columns if c != "spans"), "spans"]
    want = brute_spans(rows, within=within)
    rows_got = got.collect()
    assert len(rows_got) == len(rows)
    for r in rows_got:
        assert r.text == (rows[0][1] if r.doc_id is None else want[r.doc_id])
        assert r.spans.removed_words >= r.spans.removed
    removed = {r.doc_id: r.spans.removed for r in rows_got}
    assert removed[101] > 2 and removed[105] > 2 and (removed[102] > 0) == (removed[103] > 0) == within
    assert substring.remove_repeated(df.limit(0)).collect() == []


def test_passages_of_long_texts_and_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 300)
    rng = random.Random(7)
    passage = " ".join(letters(rng, ["ka", "lo", "mis", "ted"], 1) for _ in range(60))
    texts = [letters(rng, ["xo", "pu", "ris", "ged"], n) for n in (5, 40000, 30, 200)]
    rows = [(i, f"{t} {passage} {t[:50]}" if i != 2 else t, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in substring.remove_repeated(docs(spark, rows)).collect()}
    want = brute_spans([r for r in rows if r[0] != 1])
    assert {i: got[i].text for i in (0, 2, 3)} == want
    assert 40 <= got[1].spans.removed_words <= 60 and len(WORD.findall(got[1].text)) == 40000 + 60 + len(texts[1][:50].split()) - got[1].spans.removed_words


# mixing


def test_budgets(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "1", 50), ("b", "x", "1", 1000), ("b", "y", "1", 0)], "domain string, lang string, source string, tokens long"
    )
    got = lambda how: {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, how).collect()}
    # a can give 160 of the wanted 400: the rest goes to b; within a/x the small source is full and its sibling takes over
    assert got(mixing.Mix(total=800)) == {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "1"): 50, ("b", "x", "1"): 640, ("b", "y", "1"): 0}
    assert got(mixing.Mix(total=120)) == {("a", "x", "1"): 20, ("a", "x", "2"): 10, ("a", "y", "1"): 30, ("b", "x", "1"): 60, ("b", "y", "1"): 0}
    assert sum(got(mixing.Mix(total=10**6)).values()) == 1160 and sum(got(mixing.Mix(total=10**6, epochs=2)).values()) == 2320
    assert got(mixing.Mix({"b": 0.0}, total=100))[("b", "x", "1")] == 0


def test_mix_keeps_to_budgets(spark):
    rng = random.Random(7)
    rows = [(i, letters(rng, ["a", "b"], rng.randint(0, 20)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src2", None, "odd"])) for i in range(300)] + ODD
    df = docs(spark, rows).withColumn("tokens", F.lit(3))
    how = mixing.Mix({"crawl": 0.2, "curated": 0.6, "*/en": 3.0}, share=0.7, epochs=2)
    domain = mixing.domain_of(F.col("source"))
    chosen = mixing.choose(df, how, domain)
    got = chosen.collect()
    assert len(got) == len(rows)
    leaves = chosen.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used"))
    for r in leaves.join(mixing.budgets(leaves.drop("used"), how), ["domain", "lang", "source"]).collect():
        assert r.budget - 21 <= r.used <= r.budget or r.used == 0 and r.budget < 21
    assert {c for r in got if r.doc_id == 903 for c in [r.copies]}.__len__() == 1
    out = mixing.mix(df, how, domain)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got if r.doc_id != 903) + sum(r.copies for r in got if r.doc_id == 903)
    assert mixing.choose(df.limit(0), how, domain).collect() == []


# toxicity


def test_gradient():
    rng = np.random.default_rng(8)
    net = toxicity.Net.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows = [["ab", "cd", "ef", "ab"], ["gh"], []]
    uniq, index, mask = toxicity._indexed(windows)
    inputs = toxicity.inputs_of(uniq)
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 1.0])

    def loss():
        z = net.run(net.vectors(*inputs).astype(np.float64), index, mask)
        return (weight * (np.logaddexp(0, z) - label * z)).mean()

    g = net.gradient(*inputs, index, mask, label, weight)
    for name in ("wf", "uf", "cf", "wb", "ub", "wa", "va", "o", "b", "word", "gram"):
        flat = np.flatnonzero(g[name])
        for at in rng.choice(flat, min(3, len(flat)), replace=False):
            v = net.p[name].reshape(-1)
            old, h = v[at], 1e-3
            v[at] = old + h
            up = loss()
            v[at] = old - h
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * h) - g[name].reshape(-1)[at]) < 2e-3 * max(1, abs(g[name].reshape(-1)[at]))


def test_toxicity(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [("vileword" if bad and rng.random() < 0.05 else letters(rng, ["ka", "lo", "mi", "ten", "ru"], 1)) for _ in range(rng.randint(60, 250))]
        rows.append((i, " ".join(w), None, None))
        marks.append((i, int(bad)))
    df = docs(spark, rows + ODD).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame(marks + [(900, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.assess(df, labels).collect()}
    held = [i for i, _ in marks if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    none = toxicity.assess(df, labels.limit(0)).collect()
    assert len(none) == len(rows) + len(ODD) and {r.predicted for r in none} == {0}
    assert toxicity.assess(df.limit(0), labels).collect() == []


def test_windows_cover_whole_texts():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        starts = list(toxicity.starts_of(n))
        assert starts[0] == 0 and (n == 0 or starts[-1] + toxicity.WINDOW >= n > starts[-1])
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_net_against_one_window_at_a_time():
    """The forward pass in plain Python: one window, one word and one number at a time."""
    net = toxicity.Net.fresh(3)
    p, size = net.p, toxicity.STATE
    rng = np.random.default_rng(4)
    p["word"][:] = rng.standard_normal(p["word"].shape) * 0.5
    windows = [["ab", "cde", "ab", "żółw"], ["x"], ["one"] * toxicity.WINDOW, []]
    uniq, index, mask = toxicity._indexed(windows)
    got = net.run(net.vectors(*toxicity.inputs_of(uniq)), index, mask)

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    for w, logit in zip(windows, got):
        vectors = [net.vectors(*toxicity.inputs_of([word]))[0].tolist() for word in w]
        sides = []
        for k, order in (("f", range(len(w))), ("b", reversed(range(len(w))))):
            h, states = [0.0] * size, {}
            for t in order:
                g = [sum(v * p[f"w{k}"][i, j] for i, v in enumerate(vectors[t])) + p[f"c{k}"][j] for j in range(3 * size)]
                u = p[f"u{k}"]
                z = [sigmoid(g[j] + sum(h[i] * u[i, j] for i in range(size))) for j in range(size)]
                r = [sigmoid(g[size + j] + sum(h[i] * u[i, size + j] for i in range(size))) for j in range(size)]
                c = [math.tanh(g[2 * size + j] + sum(r[i] * h[i] * u[i, 2 * size + j] for i in range(size))) for j in range(size)]
                h = states[t] = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(size)]
            sides.append(states)
        states = [sides[0][t] + sides[1][t] for t in range(len(w))]
        e = [math.exp(sum(p["va"][a] * math.tanh(sum(s[i] * p["wa"][i, a] for i in range(2 * size))) for a in range(toxicity.ATTEND))) for s in states]
        pooled = [sum(x * s[j] for x, s in zip(e, states)) / sum(e) if w else 0.0 for j in range(2 * size)]
        want = sum(x * o for x, o in zip(pooled, p["o"])) + p["b"][0]
        assert abs(want - logit) < 1e-4


def test_training_sees_all_windows():
    words = [[f"w{k}x{i}" for i in range(n)] for k, n in enumerate((0, 5, 64, 65, 700))]
    texts = [toxicity.windows_of(w) for w in words]
    for w, parts in zip(words, texts):
        assert all(len(x) <= toxicity.WINDOW for x in parts) and set(w) == {x for part in parts for x in part}
    met, real = [], toxicity._indexed
    toxicity._indexed = lambda windows: met.extend(map(tuple, windows)) or real(windows)
    try:
        toxicity.Net.fresh().train(texts, np.array([0, 1, 0, 1, 0], np.float32))
    finally:
        toxicity._indexed = real
    times = collections.Counter(met)
    assert set(times) == {tuple(w) for t in texts for w in t}
    rounds = -(-toxicity.STEPS // toxicity.TURNS)
    # a text with as many windows as there are turns, or more, shows each once a round
    assert {times[tuple(w)] for w in texts[-1]} == {rounds}


# vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((400, 16))
    for i in range(150, 400):
        x[i] = x[i % 20] * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.08 * (i % 4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, [float(v) for v in x[0]]), (1001, [float(v) for v in x[0]])]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == root:
            break
        root = new
    want = {ids[i]: (int(near[i].sum()), ids[root[i]]) for i in range(len(ids))}
    for p in (vecdedup.Params(), vecdedup.Params(size=100, cap=120, overlap=3)):
        got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vecdedup.report(df, p).collect()]
        assert len(got) == len(rows) + len(odd)
        by = {g[0]: g for g in got}
        found, total = sum(by[i][1] for i in want), sum(n for n, _ in want.values())
        assert 0.97 * total <= found <= total and all(by[i][1] <= want[i][0] for i in want)
        assert np.mean([by[i][2] == want[i][1] for i in want]) > 0.97
        assert all(by[i][1:] == (0, i, True) for i in range(2000, 2007)) and by[None][1:] == (0, None, True)
    assert vecdedup.report(df.limit(0)).collect() == []


def planted(n, low, high, seed=11):
    """n unit vectors, the second half each at a cosine within low .. high of one of the first half."""
    rng = np.random.default_rng(seed)
    u = rng.standard_normal((n, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    h = n // 2
    side = u[h:] - (u[h:] * u[:h]).sum(axis=1, keepdims=True) * u[:h]
    cos = rng.uniform(low, high, (h, 1))
    u[h:] = cos * u[:h] + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return u


def test_links_across_shards_of_20000_vectors(spark, caplog):
    u = planted(20000, 0.901, 0.93)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(u)), "embedding": u.tolist()}), "vec_id long, embedding array<double>")
    want = sum(int((u[at : at + 2000] @ u.T >= 0.9).sum()) for at in range(0, len(u), 2000)) - len(u)
    with caplog.at_level("INFO", "vectide.llm.vecdedup"):
        got = vecdedup.report(df).collect()
    assert "are compared" not in caplog.text and "partition 1:" in caplog.text  # the graphs did it, not all pairs
    assert want >= 20000 and 0.99 * want <= sum(r.n_links for r in got) <= want
    assert np.mean([r.component_id == r.vec_id % 10000 for r in got]) > 0.99


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [5.0, 0.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"other": F.lit(1), "own": F.lit(2)})
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vecdedup.report(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (5, 0, 5), (6, 0, 6)]


def test_vectors_without_a_common_cluster(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(1500, 3000):
        side = u[i] - (u[i] @ u[i - 1500]) * u[i - 1500]
        cos = rng.uniform(0.9, 0.95)
        u[i] = cos * u[i - 1500] + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(u)], "vec_id long, embedding array<double>")
    want = int((u @ u.T >= 0.9).sum()) - len(u)
    got = vecdedup.report(df, vecdedup.Params(size=64, cap=500, overlap=1, partitions=1)).collect()
    assert 0.999 * want <= sum(r.n_links for r in got) <= want


# shards


def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(-5000, 20000)
    before = sharding.jump(keys, 1)
    assert (before == 0).all()
    for n in range(2, 12):
        after = sharding.jump(keys, n)
        assert ((after == before) | (after == n - 1)).all() and abs((after == n - 1).mean() - 1 / n) < 0.02
        before = after


def plain_jump(key, n):
    """Jump consistent hashing as published, for one key."""
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_against_the_plain_form():
    keys = np.array([0, 1, -1, 7, 2**62, -(2**63), *np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500)])
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards(spark):
    rows = [(i, "x" * (i % 7), None, None) for i in range(500)] + ODD + [(None, "null key", None, None)] * 3 + [(7, "again", None, None)] * 40
    df = docs(spark, rows).repartition(5).withColumn("shard", F.lit("clash"))
    got = sharding.assign(df, 8).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    of = {}
    for r in got:
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.grown_shard in (r.shard, 8) and r.law == "key"
    texts = {r[0]: (r[1] or "").encode() for r in rows if r[0] != 7 and r[0] is not None}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in got if r.doc_id in texts)
    assert sharding.assign(df.limit(0), 8).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(df, 0)
