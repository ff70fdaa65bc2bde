import itertools
import random
import re

from quernstone.llm import decontam

DOCS, ITEMS = "doc_id long, text string, leaked string, id string, key int, h int", "item_id long, text string, doc_id long"


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(doc, item):
    """No seeds: every alignment."""
    d, i = words(doc), words(item)
    if not i:
        return 0.0
    w, best = min(len(i), 13), 0.0
    for shift in range(-len(i), len(d) + 1):
        eq = [0 <= shift + j < len(d) and d[shift + j] == i[j] for j in range(len(i))]
        best = max([best, *(sum(eq[s : s + w]) / w for s in range(len(i) - w + 1))])
    return best if best >= 0.8 and (len(i) >= 5 or best == 1) else 0.0


def data():
    r = random.Random(11)
    vocabulary = [f"wörd{i}" for i in range(400)]
    items = [" ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 6, 7, 9, 10, 12, 14, 21, 30, 45]))) for _ in range(25)] + ["a b", "", None]
    items += [items[3].upper() + "!", items[4] + " tail"]
    docs = []
    for n in range(160):
        own = r.choices(vocabulary, k=r.randrange(0, 60))
        w = words(items[r.randrange(25)])
        lo = r.randrange(len(w))
        w = w if n % 3 else w[lo : lo + 16]
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        at = r.randrange(len(own) + 1)
        docs.append(" ".join(own[:at] + [x + r.choice(["", ",", " --", "\n"]) for x in w] + own[at:]) if n % 4 else " ".join(own))
    return docs + ["", None, "x", " ".join(["common"] * 30_000)], items


def test_against_brute_force(spark):
    docs, items = data()
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(0, docs[1], "x"), (None, items[0], "x")]
    df = spark.createDataFrame([(*x, "y", 3, 4) for x in rows], DOCS)
    bench = spark.createDataFrame([(i, t, 7) for i, t in enumerate(items)], ITEMS)
    got = decontam.report(decontam.contamination(df, bench)).collect()
    one = {}
    for i, t in enumerate(items):
        one.setdefault(" ".join(words(t)), []).append(i)
    want = []
    for i, t, _ in rows:
        found = {} if i is None else {min(ids): (len(ids), s) for w, ids in one.items() if (s := brute(t, w))}
        want.append((i, bool(found), sum(n for n, _ in found.values()), ",".join(map(str, sorted(found))), round(max([0.0, *(s for _, s in found.values())]), 9)))
    assert sorted(map(repr, [(*tuple(r)[:4], round(r.overlap, 9)) for r in got])) == sorted(map(repr, want))
    assert 30 < sum(r.contaminated for r in got) < 130
    kept = decontam.clean(df, bench)
    assert kept.columns == ["doc_id", "text", "leaked", "id", "key", "h"] and kept.count() == sum(not r.contaminated for r in got)
    assert {tuple(r)[2:] for r in kept.collect()} == {("x", "y", 3, 4)}


def test_shuffle_joins_agree(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(i, t, "x", "y", 3, 4) for i, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, t, 7) for i, t in enumerate(items)], ITEMS)
    a = sorted(map(tuple, decontam.report(decontam.contamination(df, bench)).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert a == sorted(map(tuple, decontam.report(decontam.contamination(df, bench)).collect()))


def test_first_mask_meets_two_replaced_of_13():
    mask = decontam.MASKS[0]
    for gone in itertools.combinations(range(13), 2):
        assert any(not any(o + k in gone for k in mask) for o in range(13 - mask[-1]))


def test_empty(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.contamination(no_docs, no_items).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f", "x", "y", 3, 4)], DOCS)
    assert [r.contaminated for r in decontam.report(decontam.contamination(some, no_items)).collect()] == [False]


def test_short_items_with_words_replaced(spark):
    """Every permitted substitution in items of 1 to 12 words, against overlaps without seeds."""
    docs, want = [], []
    items = {n: [f"n{n}x{j}" for j in range(n)] for n in range(1, 14)}
    for n, w in items.items():
        most = n - -(-8 * n // 10)
        for k in range(most + 2):
            for gone in itertools.combinations(range(n), k):
                if k <= most or len(gone) == n or gone[0] % 3 == 0:
                    docs.append((len(docs), "a b " + " ".join("other" if j in gone else x for j, x in enumerate(w)) + " c", None, None, None, None))
                    want.append(str(n) if k <= most else "")
    bench = spark.createDataFrame([(n, " ".join(w), 7) for n, w in items.items()], ITEMS)
    got = {r.doc_id: r.item_ids for r in decontam.report(decontam.contamination(spark.createDataFrame(docs, DOCS), bench)).collect()}
    assert [got[i] for i in range(len(docs))] == want
