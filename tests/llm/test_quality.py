import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import features, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars double, quality double, both string, row int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500, seed=3):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randrange(20, 150))
        kind = r.choice(["good"] * 6 + ["toxic", "loud"])
        if kind == "toxic":
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "rotten", "foul"]))
        text = " ".join(x.upper() + "!!" for x in w) if kind == "loud" else " ".join(w)
        docs.append((i, text, "en", "bad.example" if kind != "good" and r.random() < 0.5 else "src", float(len(text)), 9.0, "b", 1))
        if i % 2:
            labels.append((i, int(kind != "loud"), int(kind == "toxic")))
        yield docs[-1], kind, labels[-1] if i % 2 else None


def test_held_out_accuracy(spark):
    rows = list(corpus())
    extra = [(None, "word1 word2", None, None, None, None), (5000, None, None, None, float("inf"), None), (5001, "", "en", "", float("nan"), None), (5002, "word1 " * 50_000, "en", "src", -1.0, None)]
    extra = [(*x, "b", 1) for x in extra]
    df = spark.createDataFrame([d for d, _, _ in rows] + extra + [rows[0][0]], DOCS)
    labels = spark.createDataFrame([x for _, _, x in rows if x] + [(1, None, None), (None, 1, 0), (7777, 0, 0)], LABELS)
    got = quality.judged(df, labels).collect()
    assert len(got) == len(rows) + 5
    by_id = {r.doc_id: r for r in got}
    unseen = [(by_id[d[0]].keep, kind == "good") for d, kind, x in rows if x is None]
    assert np.mean([a == b for a, b in unseen]) > 0.97
    assert all(0 <= r[c] <= 1 for r in got for c in ("quality", "text_quality", "meta_quality"))
    kept = quality.reject(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in got)
    assert {(r.both, r.row) for r in kept.collect()} == {("b", 1)} and {r.quality for r in kept.collect()} <= {9.0, None}


def test_nothing_labelled_and_empty(spark):
    df = spark.createDataFrame([d for d, _, _ in corpus(40)], DOCS)
    assert all(r.keep for r in quality.judged(df, spark.createDataFrame([], LABELS)).collect())
    assert quality.judged(df.limit(0), spark.createDataFrame([], LABELS)).collect() == []


def sets(rows):
    return quality.Sets(np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows], np.int64))


def plain(rows, labels, rounds):
    """Co-training over Python's sets: counts by dictionaries, a regression for each view, and the combination.

    ``rows``: {id: (text features, metadata features)}; gives {id: probability of being bad}.
    """
    held = {i for i in labels if i % 4 == 0}
    given = [{0: [], 1: []} for _ in range(2)]
    for n in range(rounds + 1):
        views = []
        for v in range(2):
            counts = {c: {} for c in (0, 1)}
            totals = {c: 1.0 for c in (0, 1)}
            for own, weight in (([(rows[i][v], labels[i]) for i in labels if i not in held], 1.0), ([(s, c) for c in (0, 1) for s in given[v][c]], quality.PSEUDO_WEIGHT)):
                for found, c in own:
                    totals[c] += weight
                    for f in found:
                        counts[c][f] = counts[c].get(f, 0.5) + weight
            odds, z = {}, {}
            for f in counts[0].keys() | counts[1].keys():
                good, bad = counts[0].get(f, 0.5), counts[1].get(f, 0.5)
                odds[f] = np.log(bad / totals[1]) - np.log(good / totals[0])
                z[f] = abs(odds[f]) / np.sqrt(1 / bad + 1 / good)
            features = sorted(f for f in odds if z[f] > 3)
            assert len(features) <= quality.FEATURES // 2  # so all of them have a weight

            def seen(found, features=features, odds=odds, z=z):
                return [float(f in found) for f in features] + [quality.LEAN * sum(odds[f] for f in found if f in odds and z[f] > quality.TELLS) / max(1, len(found))]

            train, fit = [i for i in labels if i not in held], sorted(held)
            b = quality.regress(np.array([seen(rows[i][v]) for i in train]), np.array([labels[i] for i in train], float), np.ones(len(train)))
            margin = lambda found, b=b, seen=seen: float(np.dot(seen(found), b[:-1]) + b[-1])
            a = quality.regress(np.array([[margin(rows[i][v])] for i in fit]), np.array([labels[i] for i in fit], float), np.ones(len(fit)), ridge=0.1)
            views.append(lambda found, a=a, margin=margin: max(0.0, a[0]) * margin(found) + a[1])
        if n < rounds:
            given = [{0: [], 1: []} for _ in range(2)]
            for i, x in rows.items():
                if i not in labels:
                    for v in range(2):
                        p = quality.sigmoid(views[1 - v](x[1 - v]))
                        if p >= quality.SURE or p <= 1 - quality.SURE:
                            given[v][int(p >= 0.5)].append(x[v])
    both = np.array([[view(rows[i][v]) for v, view in enumerate(views)] for i in fit])
    m = quality.regress(both, np.array([labels[i] for i in fit], float), np.ones(len(fit)), ridge=0.1)
    return {i: float(quality.sigmoid(max(0.0, m[0]) * views[0](x[0]) + max(0.0, m[1]) * views[1](x[1]) + m[2])) for i, x in rows.items()}


def test_against_a_plain_version(spark, monkeypatch):
    r = random.Random(9)
    docs, labels = [], {}
    for i in range(900):
        bad = int(r.random() < 0.4)
        late = i >= 300  # what marks the texts of unlabelled documents, labelled ones lack
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)] + ([["fine", "vile"][bad]] if late else [["good", "evil"][bad]] * (r.random() < 0.9))
        docs.append((i, " ".join(words), "en", ["src", "odd"][bad] if r.random() < 0.99 else "mixed", 1 << (i % 3)))
        if not late:
            labels[i] = bad
    monkeypatch.setattr(quality, "drawn_for_calibration", lambda id: F.pmod(F.col(id), F.lit(4)) == 0)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(i, 1, bad) for i, bad in labels.items()], LABELS)
    rows = {d[0]: (set(quality.text_ids(d[1].encode()).tolist()), set(quality.meta_ids(dict(zip(quality.META, d[2:]))).tolist())) for d in docs}
    got = {x.doc_id: x for x in quality.judged(df, known).collect()}
    want = plain(rows, labels, quality.ROUNDS)
    assert max(abs(1 - got[i].quality - want[i]) for i in rows) < 1e-4
    model = quality.fit(df, known)
    vile, fine = (features.numbers({w}, quality.WORDS)[0] for w in (b"vile", b"fine"))
    assert model.text.odds[vile] > 1 and model.text.odds[fine] < -1  # learned from what the metadata told
    assert not quality.fit(df, known, rounds=0).text.odds[[vile, fine]].any()


def test_regression_and_margins():
    x = np.array([[0.0], [0], [1], [1], [1], [0]] * 50)
    b = quality.regress(x, np.array([0, 0, 1, 1, 0, 1] * 50, float), np.ones(300), ridge=1e-6)
    assert quality.sigmoid(b[1]) == pytest.approx(1 / 3, abs=1e-3) and quality.sigmoid(b.sum()) == pytest.approx(2 / 3, abs=1e-3)
    v = quality.View(np.array([3, 7]), np.array([1.0, 2.0, 0.0, 0.5]))
    assert v.margins(sets([[3], [7, 3], [], [5]])).tolist() == [1.5, 3.5, 0.5, 0.5]


def test_rare_telling_features_are_chosen_beside_sure_ones(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 4)
    r = np.random.default_rng(4)
    rows, y = [], []
    for i in range(6000):
        bad = i % 4 == 0
        row = [k for k in range(10) if r.random() < (0.7 if bad else 0.3)]  # frequent, surely different
        rows.append(row + [50] * (bad and i % 40 == 0))  # rare, in bad rows only
        y.append(float(bad))
    view = quality.learn(sets(rows), np.array(y), quality.Counts.none(100))
    assert 50 in view.features and len(view.features) == 4
