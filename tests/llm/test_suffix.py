import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import suffix

SCHEMA = "doc_id long, text string, lo long"


def brute(docs):
    """(id, text) in order to (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), []
    for _, t in docs:
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), []
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["thé", "and", "ing", "over", "ße", "😀", "a", "quick", "tion"]
    make = lambda k: " ".join(r.choices(words, k=k))
    passages = [make(60) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [make(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            lo = r.randrange(len(p) // 2)
            parts += [p[lo : lo + r.randrange(60, 300)], make(r.randrange(0, 20))]
        docs.append((i * 3, "".join(parts)))
        if r.random() < 0.2:
            docs.append((i * 3 + 1, r.choice(docs)[1]))
        if r.random() < 0.2:
            t = r.choice(docs)[1]
            k = r.randrange(len(t) + 1)
            docs.append((i * 3 + 2, t[:k] + "X" + t[k:]))
    docs += [(5000, ""), (5001, None), (5002, "x" * 99), (5003, "x" * 3000), (5004, "ab" * 400), (5005, "y" + "x" * 100), (5006, "\0" * 250 + "é"), (5007, "\0" * 120)]
    zeros = make(20) + "\0" * 16 + make(20)
    docs += [(5008, "left " + zeros), (5009, zeros + " right")]
    return docs


def result(spark, docs):
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], SCHEMA).repartition(5)
    return suffix.report(suffix.deduplicated(df)).collect()


@pytest.mark.parametrize("case", ["plain", "small", "frequent"])
def test_against_brute_force(spark, monkeypatch, case):
    if case != "plain":
        monkeypatch.setattr(suffix, "SHARD", 20_000)
    if case == "frequent":
        monkeypatch.setattr(suffix, "HOT", 2)
        monkeypatch.setattr(suffix, "SAMPLED", 1)
    docs = corpus(3)
    got = sorted(tuple(r) for r in result(spark, docs))
    assert got == [(i, *x) for (i, _), x in zip(docs, brute(docs))]


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_bounded_parts_against_brute_force(monkeypatch, share):
    """Long texts in parts, many packages, shards in many parts that are merged, hot anchors cut; as a task runs them, in turn and in reverse."""
    for name, value in (("CHUNK", 400), ("PART", 1500), ("HELD", 5)):
        monkeypatch.setattr(suffix, name, value)
    merges = []
    merge = suffix.merge
    monkeypatch.setattr(suffix, "merge", lambda *a: merges.append(1) or merge(*a))
    docs = corpus(4)
    texts = [(t or "").encode() for _, t in docs]
    found = np.unique(np.concatenate([suffix.runs(p)[5] for p in suffix.segments(texts)]))
    frequent = np.random.default_rng(1).permutation(found)[: int(share * len(found))]
    packer, shards = suffix.Packer(3, frequent), {}
    order = np.random.default_rng(2).permutation(len(docs))
    for k in order:
        for parts in suffix.segments([texts[k]]):
            packer.add([(docs[k][0], 0)], parts)
            if packer.size >= 3000:
                for shard, package in zip(*packer.packages()):
                    shards.setdefault(shard, []).append(package)
    for shard, package in zip(*packer.packages()):
        shards.setdefault(shard, []).append(package)
    gone = {i: np.zeros(len(t), bool) for (i, _), t in zip(docs, texts)}
    for packages in shards.values():
        for rows in suffix.judged(iter(packages[::-1])):
            for i, _, lo, hi in rows.tolist():
                gone[i][lo:hi] = True
    got = [(len(t), int(gone[i].sum()), hashlib.sha256(bytes(x for x, g in zip(t, gone[i]) if not g)).hexdigest()) for (i, _), t in zip(docs, texts)]
    assert got == [(n, removed, sha) for n, removed, _, sha in brute(docs)]
    assert merges or share == 1  # pieces of few windows fit into one part


def test_hot_anchors_are_found(spark, monkeypatch):
    """By their different runs; copies do not make an anchor hot."""
    monkeypatch.setattr(suffix, "SAMPLED", 1)
    monkeypatch.setattr(suffix, "HOT", 30)
    r = random.Random(7)
    noise = lambda k: "".join(r.choices("abcdefghij", k=k))
    shared, copied = noise(150), noise(400)
    docs = [(i, noise(120) + shared + noise(120)) for i in range(60)] + [(100 + i, copied) for i in range(60)]
    df = spark.createDataFrame([(i, i, t.encode()) for i, t in docs], "id long, key long, text binary")
    found = set(suffix.frequent_anchors(df).tolist())
    of = lambda t: {int(h) for p in suffix.segments([t.encode()]) for h in suffix.runs(p)[5]}
    assert found and found <= of(shared) | of(docs[0][1]) and not found & of(copied)


def test_null_and_repeated_ids(spark):
    t = "a passage that is quite long and says a lot about nothing at all, over and over and on " * 2
    u = "an entirely other text of more than one hundred bytes in length, with nothing in it of what the first says. ok?"
    docs = [(1, u), (4, t), (4, t), (None, "z " + u), (2, "unlike")]
    got = sorted((tuple(r) for r in result(spark, docs)), key=repr)
    single = brute([(1, u), (2, "unlike"), (4, t), (None, "z " + u)])
    want = [(1, *single[0]), (2, *single[1]), (4, *single[2]), (4, *single[2]), (None, *single[3])]
    assert got == sorted(want, key=repr) and single[3][1] > 100


def test_empty(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("seed", range(6))
def test_order_and_common_prefixes(seed):
    r = np.random.default_rng(seed)
    t = r.integers(0, 2 + seed, 700).astype(np.uint8)
    t[300:500] = t[50:250]
    t[600:] = 1
    b = t.tobytes()
    order = suffix.suffix_order(t)
    padded = b + bytes(100)
    assert [padded[i : i + 100] for i in order] == sorted(padded[i : i + 100] for i in range(700))
    common = suffix.common_prefixes(t, order, lanes=16)
    for k in range(1, 700):
        x, y = b[order[k] :][:100], b[order[k - 1] :][:100]
        assert common[k] == next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
