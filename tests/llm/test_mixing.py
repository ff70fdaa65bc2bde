import random

import numpy as np

from quernstone.llm import mixing

DOCS, LABELS = "doc_id long, text string, lang string, rate string, row string, __t long", "doc_id long, quality int, toxic int"


def data(n=800):
    r = random.Random(12)
    docs = []
    for i in range(n):
        lang = r.choice(["a", "a", "a", "b", "c"])
        words = [f"{lang}{r.randrange(60)}" if r.random() < 0.8 else f"x{r.randrange(40)}" for _ in range(r.randrange(5, 80))]
        docs.append((i, " ".join(words), lang, "r", "z", 5))
    return docs


def test_targets_are_met(spark):
    rows = data() + [(None, "a1 a2", None, None), (9000, None, "a", None), (9001, "", "b", None), (9002, "a1 " * 40_000, None, None), (0, "b1 b2", "b", None)]
    rows = [(*x[:4], "z", 5) for x in rows]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 800, 2)] + [(1, 0, 0), (None, 1, 0)], LABELS)
    weights = {"a": 0.3, "b": 0.5, "c": 0.2, "nowhere": 5}
    got = mixing.mixed(df, mixing.vetted(df, labels), weights).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all() and list(got.columns) == ["doc_id", "text", "lang", "row", "__t", "tokens", "domain", "membership", "rate"]
    assert got.tokens.tolist() == [len((t or "").split()) for t in got.text.fillna("")]
    model = mixing.learn(mixing.vetted(df, labels))
    p = model.posteriors(model.likelihoods([(t or "").encode() for t in got.text.fillna("")]))
    totals = (got.rate * got.tokens).to_numpy() @ p
    assert np.allclose(totals / got.tokens.sum(), [0.3, 0.5, 0.2], atol=0.01)
    known = got[(got.doc_id < 800) & got.lang.notna() & (got.tokens > 10)]
    assert (known.domain == known.lang).mean() > 0.97


def test_replay_reaches_the_least_squares():
    """Against a solution in closed form, where no rate meets zero."""
    r = np.random.default_rng(2)
    p = r.dirichlet([1, 1, 1], 300)
    t = r.integers(1, 50, 300).astype(float)
    target, errors = np.array([0.4, 0.35, 0.25]), np.zeros((0, 3))
    for _ in range(400):
        at = mixing.replayed(p, errors)[1]
        errors = np.vstack([errors, (t * at) @ p / t.sum() - target])
    rate = mixing.replayed(p, errors)[0]
    m = (p * (t / t.sum())[:, None]).T @ p
    e = mixing.PULL * np.linalg.solve(mixing.PULL * np.eye(3) + m, p.T @ t / t.sum() - target)
    assert np.allclose(rate, 1 - p @ e / mixing.PULL, atol=1e-3) and (rate > 0).all()


def test_nothing_labelled_or_wanted(spark):
    df = spark.createDataFrame(data(30), DOCS)
    none = spark.createDataFrame([], LABELS)
    got = mixing.mixed(df, mixing.vetted(df, none), {"a": 1.0}).collect()
    assert {(r.rate, r.domain) for r in got} == {(1.0, None)}
    some = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    assert {r.rate for r in mixing.mixed(df, mixing.vetted(df, some), {"zz": 1.0}).collect()} == {1.0}
    assert mixing.mixed(df.limit(0), mixing.vetted(df, some), {"a": 1.0}).collect() == []


def test_whole_rows_pass_one_python_worker(spark):
    """Texts go to Python once, and the two ways to return rows agree."""
    df = spark.createDataFrame(data(300) + [(9000, None, "a", "r", "z", 5), (9001, "", "b", "r", "z", 5)], DOCS)
    labelled = mixing.vetted(df, spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], LABELS))
    weights = {"a": 0.2, "b": 0.45, "c": 0.35}
    whole = mixing.mixed(df, labelled, weights)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "cast(text" not in plan
    few = mixing.mixed(df, labelled, weights, keep=["doc_id"])
    named = ["doc_id", *mixing.ADDED]
    assert sorted(map(tuple, whole.select(named).collect())) == sorted(map(tuple, few.select(named).collect()))


def test_rare_domain_reaches_its_target(spark):
    """A domain of 0.1 % of the tokens, a target of 12 %."""
    rows = [(100, [0.0, 1.0, 0.0])] * 399 + [(100, [0.0, 0.02, 0.98])] * 600 + [(100, [1.0, 0.0, 0.0])]
    own = spark.createDataFrame(rows, "__t long, __p array<double>")
    target = np.array([0.12, 0.48, 0.4])
    t, p = np.array([x[0] for x in rows], float), np.array([x[1] for x in rows])
    errors = mixing.fit(own, target)
    rate = mixing.replayed(p, errors)[0]
    assert len(errors) < mixing.ITERATIONS
    assert np.abs((t * rate) @ p / t.sum() - target).max() < 1e-3


def dense(p, t, target):
    """The rates of least squares over all documents at once: Newton's method on the errors of the domains."""
    w = t / t.sum()
    share = w @ p
    e = np.zeros(len(target))
    for _ in range(200):
        rate = np.maximum(0.0, 1 - p @ e / mixing.PULL)
        slope = np.diag(share) + (p * (w * (rate > 0) / mixing.PULL)[:, None]).T @ p
        e -= np.linalg.solve(slope, share * e - (w * rate) @ p + target)
    return np.maximum(0.0, 1 - p @ e / mixing.PULL)


def test_against_a_dense_solver(spark):
    """The query's rates, over its own posteriors."""
    df = spark.createDataFrame(data(), DOCS)
    labelled = mixing.vetted(df, spark.createDataFrame([(i, 1, 0) for i in range(0, 800, 2)], LABELS))
    weights = {"a": 0.2, "b": 0.45, "c": 0.35}
    got = mixing.mixed(df, labelled, weights, keep=["doc_id"]).toPandas().sort_values("doc_id")
    model = mixing.learn(labelled)
    p = model.posteriors(model.likelihoods([x[1].encode() for x in data()]))
    t = got.tokens.to_numpy(float)
    want = dense(p, t, np.array([weights[d] for d in model.domains]))
    assert np.sqrt(np.average((got.rate.to_numpy() - want) ** 2, weights=t)) < 0.02
    assert np.abs((t * got.rate.to_numpy()) @ p / t.sum() - (t * want) @ p / t.sum()).max() < 1e-3


def test_a_rare_domain_is_learned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_ROWS", 10)
    rows = [(i, x[1], x[2]) for i, x in enumerate(data(3000)) if x[2] != "c" or i % 20 == 0]
    model = mixing.learn(spark.createDataFrame(rows, "id long, text string, domain string"), sample_rows=100)
    n = [sum(x[2] == d for x in rows) for d in "abc"]
    assert model.domains == ("a", "b", "c") and np.allclose(np.exp(model.prior), np.array(n) / sum(n))
