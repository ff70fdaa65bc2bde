import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from quernstone.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VILE = ["vile", "rotten", "foul"]


def words_of(lang, r, n):
    bits = {"en": ["the", "and", "ing", "er"], "de": ["der", "und", "sch", "ei"], "fr": ["les", "eau", "que", "oi"], "es": ["los", "ado", "ci", "ez"]}[lang]
    return ["".join(r.choices(bits, k=r.randrange(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows, labels = random.Random(31), [], []
    planted = {"toxic": set(), "copy": set(), "leak": set(), "secret": set()}
    items = [" ".join(words_of("en", r, 30)) for _ in range(6)]

    def add(lang, words, kind=None):
        i = len(rows)
        text = " ".join(words)
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
        if kind:
            planted[kind].add(i)
        if i % 2 or kind == "toxic" and i % 3:
            labels.append((i, 1, int(kind == "toxic")))
        return words

    for _ in range(700):
        lang = r.choice(["en", "en", "de", "fr", "es"])
        w = words_of(lang, r, r.randrange(60, 160))
        kind = r.choice([None] * 8 + ["toxic", "leak", "secret"])
        if kind == "toxic":
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(VILE))
        if kind == "leak":
            item = r.choice(items).split()
            item[r.randrange(len(item))] = "other"
            w[40:40] = item
        if kind == "secret":
            w[10:10] = ["token=0123abcdefXYZ"]
        add(lang, w, kind)
        if kind is None and r.random() < 0.3:
            c = list(w)
            if r.random() < 0.5:
                c[r.randrange(len(c))] = "changed"
            add(lang, c, "copy")
    rows += [(90_000, None, None, None, None), (90_001, "", "en", "src0", 0), (None, "no id here at all", "en", None, 3)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, planted, items


def test_run(spark, folder):
    path, rows, planted, items = folder
    got = cp.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "domain", "membership", "rate"]
    kept = {x.doc_id: x for x in got.collect()}
    gone = planted["toxic"] | planted["copy"] | planted["leak"]
    clean = {i for i, *_ in rows if i is not None and i not in gone and i < 90_000}
    assert len(planted["toxic"] - kept.keys()) >= 0.95 * len(planted["toxic"])
    assert len(planted["copy"] - kept.keys()) >= 0.95 * len(planted["copy"])
    assert not planted["leak"] & kept.keys()
    assert len(clean & kept.keys()) >= 0.99 * len(clean)
    text = {i: t for i, t, *_ in rows}
    for i, x in kept.items():
        want = re.sub(r"token=\w+", "[SECRET]", text[i]) if text[i] is not None else None
        assert x.text == want and (i not in planted["secret"] or "[SECRET]" in x.text and x.n_chars == len(x.text))
    assert all(x.rate >= 0 and x.tokens == len((x.text or "").split()) for x in kept.values())
    share = {d: sum(x.rate * x.tokens for x in kept.values() if x.domain == d) for d in cp.TARGETS}
    assert all(abs(v / sum(share.values()) - cp.TARGETS[d]) < 0.05 for d, v in share.items())


def test_stages_keep_the_columns_and_stand_empty_tables(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, path)
        assert out.count() == 0 and out.columns[:5] == docs.columns and (len(out.columns) == 5) == (k < 4)


def test_stages_carry_other_columns_and_repeated_rows(spark, folder):
    """Columns of the names that operators use inside."""
    path, rows, *_ = folder
    names = "row key_a key_b id key found spans kinds both of_text of_meta keep leaked tokens_ node of __t __p __id __text".split()
    some = [(*x, *range(len(names))) for x in rows[:80] + rows[:3] + rows[-3:]]
    docs = spark.createDataFrame(some, DOCS + "".join(f", `{n}` int" for n in names))
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, path)
        assert out.columns[: len(docs.columns)] == docs.columns and (len(out.columns) == len(docs.columns)) == (k < 4)
        got = out.collect()
        assert {tuple(r)[5 : 5 + len(names)] for r in got} == {tuple(range(len(names)))}
        assert len(got) in ({len(some)} if k > 2 else range(40, len(some) + 1))
        ids = [r.doc_id for r in got]
        assert ids.count(None) == 1 or k == 0
        if k == 1:
            assert len(set(ids)) == len(ids)


def test_python_workers_get_bounded_batches(spark, folder):
    """However long the texts, unless the session names a bound; rows beyond it come alone."""
    path, *_ = folder

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    for _, stage in (x for x in cp.STAGES if x[1] in (cp.quality_stage, cp.dedup_stage, cp.mixing_stage)):
        spark.conf.unset(common.BATCH_SETTING)
        stage(spark, spark.read.parquet(f"{path}/documents.parquet").limit(0), path)
        long = spark.range(400).selectExpr("id", "repeat('abcd', 25000) AS text").coalesce(1)
        got = long.mapInArrow(seen, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 400 and max(r.bytes for r in got) <= common.BATCH_BYTES + 200_000
    spark.conf.set(common.BATCH_SETTING, 50_000)
    got = long.limit(5).coalesce(1).mapInArrow(seen, "n long, bytes long").collect()
    assert [r.n for r in got] == [1] * 5
    common.bounded(spark)
    assert spark.conf.get(common.BATCH_SETTING) == "50000"
    spark.conf.unset(common.BATCH_SETTING)


def test_batches_change_no_result(spark, folder):
    path, *_ = folder
    got = []
    for size in (64 << 20, 20_000):
        spark.conf.set(common.BATCH_SETTING, size)
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, path)
        got.append(sorted((tuple(r) for r in docs.drop("rate", "membership").collect()), key=str))
    spark.conf.unset(common.BATCH_SETTING)
    assert len(got[0]) > 400 and got[0] == got[1]
