import random
import re

from vectide.llm import minhash
from vectide.llm.common import components, save

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, width, least=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rows[rng.randrange(max(1, len(rows) // 4))][1] or "").split(" ")
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(1, 120)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "oNE\x0b"), (n + 5, "É one"), (n + 6, "é one")]


def test_against_brute_force(spark):
    for width in (2, 5):
        rows = corpus(width)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.report(df, minhash.Params(width=width)).collect()}
        assert got == brute(rows, width)


def bridged(family, first):
    """Two groups of near copies with one linked pair between them; few low ids share the pair's buckets, so that neither is an anchor there."""
    rng = random.Random(family)
    word = lambda kind, k: f"{kind}{family}x{k}"
    common, xs, ys = [word("c", k) for k in range(69)], [word("x", k) for k in range(31)], [word("y", k) for k in range(31)]
    m, n = common + xs[9:] + ys[:9], common + ys[:20] + xs[20:]
    both = sorted(set(m) & set(n))
    sets = [rng.sample(both, 78) for _ in range(8)]
    for base in (xs, ys):
        for k in range(40):
            own = common + base
            own[rng.randrange(100)] = word(base[0][0] + "own", k)
            sets.append(own)
    return [(first + i, " ".join(w)) for i, w in enumerate([*sets, m, n])]


def test_groups_joined_by_one_pair_of_members(spark):
    families = [bridged(f, 1000 * f) for f in range(24)]
    want = {}
    for rows in families:
        want |= brute(rows, 1)
    df = spark.createDataFrame([r for rows in families for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.report(df, minhash.Params(width=1)).collect()}
    assert got == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 7), (None, "a b c", 8), (None, "z", 9), (2, "A b  c", 1)], "doc_id long, text string, band long")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.report(df, minhash.Params(width=2)).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    left = minhash.deduplicate(df, minhash.Params(width=2))
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 1]
    assert minhash.report(df.limit(0), minhash.Params()).collect() == []


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5), (None, 3), (102, 101), (101, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}


def test_wide_rows_go_to_python_in_batches_bounded_by_bytes(spark, monkeypatch):
    import pandas as pd

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"n": [sum(map(len, pdf["s"]))]})

    wide = spark.range(0, 300, 1, 1).selectExpr("cast(repeat('x', 100000) as binary) as s")
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(limit), {}

    def noted(df, name, *args, **more):
        seen[name] = more.get("batch_bytes")
        return save(df, name, *args, **more)

    got = [r.n for r in save(wide.mapInPandas(run, "n long"), "wide", batch_bytes=minhash.BATCH).collect()]
    assert sum(got) == 30_000_000 and max(got) <= minhash.BATCH + 200_000
    assert spark.conf.get(limit) == before
    monkeypatch.setattr(minhash, "save", noted)
    rows = bridged(3, 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.report(df, minhash.Params(width=1)).collect()}
    assert got == brute(rows, 1)
    assert all(seen[k] == minhash.BATCH for k in ("minhash", "minhash-sets", "minhash-confirmed", "minhash-late"))
