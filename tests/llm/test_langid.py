import random
import zlib

import numpy as np

from quernstone.llm import langid

SCHEMA = "doc_id long, text string, lang string"
BITS = {"en": ["the", "and", "tion", "ing", "er", "ou"], "de": ["der", "ung", "sch", "ei", "ü", "und"], "fr": ["les", "eau", "que", "é", "ou", "ment"]}


def docs(n=600, seed=1):
    r = random.Random(seed)
    for i in range(n):
        lang = r.choice(sorted(BITS))
        yield i, " ".join("".join(r.choices(BITS[lang], k=r.randrange(1, 4))) for _ in range(r.randrange(20, 60))), lang


def test_held_out_accuracy_and_odd_rows(spark):
    rows = list(docs()) + [(9000, None, "en"), (9001, "", "en"), (9002, "12 %%% 34", "de"), (9003, "the ing " * 20_000, None), (None, "der und schung", "en"), (9004, "Q", "fr")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], SCHEMA + ", score double").select("doc_id", "text", "lang", "score")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i].lang_pred == lang) for i, _, lang in rows[:600] if got[i].held_out]
    assert len(held) > 60 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and got[9003].lang_pred == "en" and got[None].lang_pred == "de"


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = list(docs())
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, turned))
    assert a == b


def test_nothing_to_learn(spark):
    got = langid.identify(spark.createDataFrame([(0, "abc", None), (1, "abc", None)], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_filter_holds_all_and_little_else():
    r = np.random.default_rng(0)
    g = r.integers(0, 2**62, 6000).astype(np.uint64)
    of = r.integers(0, 70, 6000)
    m = langid.filled(tuple(f"l{i:02d}" for i in range(70)), g, of)
    held = m.containing(g)
    assert all(held[i, of[i] // 64] >> np.uint64(of[i] % 64) & np.uint64(1) for i in range(6000))
    other = m.containing(r.integers(0, 2**62, 20000).astype(np.uint64))
    hits = sum(int(np.bitwise_count(other[:, w]).sum()) for w in range(2)) / (20000 * 70)
    assert abs(hits - m.chance.mean()) < 0.01


def test_chunks_agree(monkeypatch, spark):
    df = spark.createDataFrame(list(docs(80)), SCHEMA)
    m = langid.filled(("a", "b"), *(lambda g: (g[0], np.arange(len(g[0])) % 2))(langid.grams([b"the and tion der ung"])))
    whole = langid.predict(df, m).collect()
    texts = [r.text.encode() for r in df.collect()]
    one = [m.predict([t]) for t in texts]
    assert [(r.lang_pred, r.score) for r in whole] == [(x[0][0], x[1][0]) for x in one]


def test_against_plain_sets(spark):
    """The prediction of the filter beside that of Python's sets, repeated rows among the texts."""
    rows = list(docs(500))
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    langs, gram, of = langid.learned(df.filter("doc_id % 2 = 0"))
    held = {name: set() for name in langs}
    for g, k in zip(gram.tolist(), of.tolist(), strict=True):
        held[langs[k]].add(g)
    got = langid.predict(df, langid.filled(langs, gram, of)).collect()
    assert len(got) == len(rows)
    for r, (i, text, _) in zip(got, rows, strict=True):
        grams = langid.grams([text.encode()])[0].tolist()
        share = {name: sum(g in own for g in grams) / len(grams) for name, own in held.items()}
        best = max(sorted(share), key=share.get)
        assert r.doc_id == i and r.lang_pred == best
        assert abs(r.score - share[best] / sum(share.values())) < 0.02


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST_ROWS", 20)
    rows = [(i, t, x) for i, t, x in docs(2000) if x != "fr"] + [(5000 + i, t, x) for i, t, x in docs(60) if x == "fr"]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), sample_rows=100)
    assert "fr" in model.langs and model.predict([rows[-1][1].encode()])[0] == ["fr"]
