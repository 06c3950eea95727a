import random

import corpus_pipeline
from tests.llm.test_bpe import LIB
from tests.llm.test_operators import SCHEMA, brute_lines, letters
from vectide.llm import mixing
from pyspark.sql import functions as F

TONGUES = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ung", "ein", "keit"]}


def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        k = rng.choice(list(TONGUES))
        text = "\n".join(letters(rng, TONGUES[k], rng.randint(8, 40)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, k, f"src{i % 4}"))
    rows += [(200, rows[5][1], "en", "src0"), (201, rows[6][1] + "\n" + letters(rng, TONGUES["en"], 9), "en", "src1"), (202, None, "en", "src0"), (203, "", "en", "src0"), (204, "123 ...", "en", "src0")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))


def plain_copies(texts, width=5):
    """Ids that stay: the smallest of each component of texts with a similarity of 0.8 or more on five-word shingles."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    pairs = [(i, j) for i in texts for j in texts if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return {i for i in texts if root[i] == i}


def test_stages_take_effect(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        steps[name] = {r.doc_id: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(steps["language"]) == set(before) - {202, 203, 204}
    want = brute_lines([(i, r.text) for i, r in steps["language"].items()])
    assert {i: r.text for i, r in steps["lines"].items()} == {i: t for i, t in want.items() if t.strip()}
    assert 200 not in steps["lines"] and all(r.n_chars == len(r.text) for r in steps["lines"].values())
    assert set(steps["near_copies"]) == plain_copies({i: r.text for i, r in steps["lines"].items()})
    words = lambda rs: sum(len(r.text.split()) for r in rs.values())
    assert words(steps["mix"]) <= 0.9 * words(steps["near_copies"]) and words(steps["mix"]) > 0.75 * words(steps["near_copies"])
    for i, r in steps["encode"].items():
        assert r.n_tokens == len(LIB.encode(steps["mix"][i].text, add_special_tokens=False).ids)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_sha256 for r in whole} == {i: r.ids_sha256 for i, r in steps["encode"].items()}
    assert mixing.Mix().epochs == 1


def test_language_classifies_each_text_once(spark):
    plan = corpus_pipeline.language(spark, corpus(spark), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
