import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import simhash

SCHEMA = "doc_id long, text string"


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(f, radius=3):
    """Smallest id reachable over all pairs."""
    ids = sorted(f)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (f[i] ^ f[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts():
    r = random.Random(4)
    words = [f"Wé{i}" for i in range(300)]
    out = [" ".join(r.choices(words, k=r.randrange(1, 120))) for _ in range(120)]
    for i in range(80):  # chains of edits
        w = out[-1 if i % 4 else r.randrange(120)].split(" ")
        w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out + ["", None, "a", "a b", "a b", " A\tB ", " x y", "x " * 30_000]


def test_documents(spark):
    rows = list(enumerate(texts())) + [(5, "again another text"), (5, None)]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "a", 1)], SCHEMA + ", f int"))
    got = got.select("doc_id", simhash.hexadecimal("f").alias("f"), "component_id").collect()
    assert sorted((r.doc_id, r.f) for r in got if r.doc_id is not None) == sorted((i, f"{plain(t):016x}") for i, t in rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    by_f = {}
    for i, t in rows:
        by_f[plain(t)] = min(i, by_f.get(plain(t), i))
    label = brute({i: f for f, i in by_f.items()})
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((i, label[by_f[plain(t)]]) for i, t in rows)


@pytest.mark.parametrize("dense", [False, True])
def test_links_over_many_shards(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "BLOCK_CELLS", 400)
    r = random.Random(9)
    f = {r.getrandbits(64) for _ in range(400)} | {0, 2**64 - 1}
    for x in list(f)[:100]:  # chains, and balls of many within few bits
        for _ in range(6 if dense else 2):
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            f.add(x)
    f = {i: x for i, x in enumerate(sorted(f, key=lambda x: xxhash.xxh64_intdigest(str(x))))}
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in f.items()], "f long, node long")
    edges = simhash.links(nodes)
    assert edges.count() < 20 * len(f)
    got = {x.node: x.component for x in simhash.components(edges).collect()}
    want = brute(f)
    assert {i: got.get(i, i) for i in f} == want


def test_long_chain_of_components(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(900, 901), (901, 900), (950, 950)], "a long, b long")
    got = {x.node: x.component for x in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in order}, 900: 900, 901: 900}


def test_routing_is_complete():
    r = np.random.default_rng(3)
    f = r.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    f[1500:] = f[:1500] ^ (np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64))
    tree = simhash.build(f[::7], 30)
    at, shard, home = simhash.routed(f, tree, 3)
    assert sorted(at[home]) == list(range(3000))
    shards = [set(shard[at == i]) for i in range(3000)]
    own = dict(zip(at[home], shard[home]))
    for i in range(1500):
        assert own[i] in shards[i + 1500] or own[i + 1500] in shards[i]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_first_in_spark_agrees(spark):
    t = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first().h % 2**64 == simhash.fingerprint(t.encode())


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_one_of_each_group(spark):
    r = random.Random(21)
    words = [f"word{i}" for i in range(2000)]
    rows, near = [], {}
    for g in range(40):
        base = r.choices(words, k=r.randrange(80, 300))
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randrange(0, 4)):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            near[len(rows)] = near.get(len(rows), rows[-1][0])
            rows.append((len(rows), r.choice([str, str.upper])(("  " if g % 2 else " ").join(w))))
        changed = [x if r.random() < 0.7 else r.choice(words) for x in base]  # too far off
        rows.append((len(rows), " ".join(changed)))
    rows += [(5000, ""), (5001, None), (5002, " \n"), (5003, "short text"), (5004, "Short  text"), (5005, "short texts")]
    extra = [(None, rows[0][1]), (None, None), rows[3], rows[3], (5006, "x " * 30_000), (2, "another text of the same id")]
    df = spark.createDataFrame([(*x, 1) for x in rows + extra], SCHEMA + ", node int")
    got = simhash.one_of_each(df)
    assert got.columns == ["doc_id", "text", "node"]
    kept = [(x.doc_id, x.text) for x in got.collect()]
    # brute force: components over all pairs, the smallest id of each
    every = {(i, t) for i, t in rows + extra if i is not None}
    order = sorted(every, key=lambda x: (x[0], x[1] or ""))
    label = {x: x for x in order}
    for x in order:
        for y in order:
            if label[x] != label[y] and jaccard(x[1], y[1]) >= 0.8:
                old, new = max(label[x], label[y], key=order.index), min(label[x], label[y], key=order.index)
                label = {k: new if v == old else v for k, v in label.items()}
    want = sorted(set(label.values()), key=repr)
    ours = [(i, t) for i, t in kept if i is not None]
    # nothing else goes, and hardly a copy stays
    assert set(want) <= set(ours) and len(ours) == len(set(ours)) <= len(want) + 2
    assert sum(i is None for i, _ in kept) == 2


def test_one_of_each_by_shuffles_and_empty(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 31 + k}" for k in range(50)) + (" end" if i % 3 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert a == sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [i for i in range(60) if i % 3 == 0]
    assert simhash.one_of_each(df.limit(0)).collect() == []


def copies_of_all_kinds():
    """{kind: texts}, words of each kind apart from those of the others."""
    r = random.Random(5)
    kinds = {k: [] for k in ("replaced", "short", "ends", "clusters", "group")}
    words = {k: [f"{k}{i}" for i in range(3000)] for k in kinds}

    def replaced(kind, base, n):
        w = list(base)
        for at in r.sample(range(len(w)), n):
            w[at] = r.choice(words[kind])
        return " ".join(w)

    for g in range(60):
        base = r.choices(words["replaced"], k=r.randrange(80, 300))
        kinds["replaced"] += [" ".join(base)] + [replaced("replaced", base, r.randrange(1, max(2, len(base) // 60))) for _ in range(3)]
        base = r.choices(words["short"], k=r.randrange(25, 60))
        kinds["short"] += [" ".join(base), " ".join(base[r.randrange(1, 3) :]), replaced("short", base[1:], 1), " ".join(base + r.choices(words["short"], k=3))]
        base = r.choices(words["ends"], k=r.randrange(100, 300))
        n = len(base)
        cut = r.randrange(n // 6)
        kinds["ends"] += [" ".join(base), " ".join(base + r.choices(words["ends"], k=int(n * (0.15, 0.2, 0.23)[g % 3]))), " ".join(base[cut : n - (n // 6 - cut)])]
    for _ in range(3):  # texts whose likeliest partners are all of their own cluster
        base = r.choices(words["clusters"], k=300)
        for _ in range(6):
            own = replaced("clusters", base, 3).split(" ")
            kinds["clusters"] += [" ".join(own)] + [replaced("clusters", own, 1) for _ in range(5)]
    base = r.choices(words["group"], k=120)
    kinds["group"] = [replaced("group", base, r.randrange(0, 5)) for _ in range(150)]
    return kinds


def test_recall_over_all_pairs(spark, monkeypatch):
    """Against brute force; buckets are cut into cells."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    monkeypatch.setattr(simhash, "TASK_ROWS", 100)
    texts, want, of, n = [], set(), {}, 0
    for kind, own in copies_of_all_kinds().items():
        sets = [shingles(t) for t in own]
        label, pairs = list(range(len(own))), 0
        for i in range(len(own)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    pairs += 1
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        want |= {len(texts) + x for x in label}
        of |= {len(texts) + i: kind for i in range(len(own))}
        texts += own
        n += pairs
        assert pairs >= 90
    assert n > 500
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for kind in set(of.values()):
        gone = {i for i, k in of.items() if k == kind} - want
        assert len(gone - got) >= 0.99 * len(gone), kind
    assert want <= got


def test_copies_of_a_fingerprint():
    """Shards that the ball around a random fingerprint reaches."""
    r = np.random.default_rng(7)
    f = r.integers(0, 2**63, (2, 200 * 256), dtype=np.int64).view(np.uint64) * np.uint64(2) + r.integers(0, 2, (2, 200 * 256)).astype(np.uint64)
    tree = simhash.build(f[0], 256)
    shards = sum(x[0] == "leaf" for x in tree)
    at, shard, home = simhash.routed(f[1], tree, 3)
    assert shards >= 150 and len(at) / f.shape[1] < 6 and home.sum() == f.shape[1]
    assert np.bincount(shard[home], minlength=shards).max() < 8 * 256
