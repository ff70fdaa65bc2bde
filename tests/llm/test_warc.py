import base64
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quernstone.llm import warc

SCHEMA = "page_id long, url string, html string, captured long"


def rows():
    r = random.Random(6)
    texts = ["", "<p>é😀</p>", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n", "x" * 300_000, "a\r\n\r\n\r\n\r\n"]
    urls = ["http://www.a.example/x?q=1", "https://a.example:443/x?q=1", "http://b.example:8080/é ü", None, "", "http://[bad/\r\nX: y", "HTTP://A.example/"]
    out = [(i, r.choice(urls), r.choice(texts) if r.random() < 0.5 else f"<p>{i}</p>", r.randrange(0, 4 * 10**9)) for i in range(400)]
    return out + [(900, None, None, None), (900, None, None, None), (901, "u", "only twice", 5), (901, "u", "only twice", 5), (None, "u", "<p>7</p>", 1), (None, "u", "nobody else", 1)]


def run(spark, tmp_path, data, **options):
    df = spark.createDataFrame([(*x, "z") for x in data], SCHEMA + ", payload string")
    warc.write_archives(df, str(tmp_path / "w"), **options)
    return warc.histories(warc.read_archives(spark, str(tmp_path / "w")))


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 17)
    monkeypatch.setattr(warc, "RANGE_ROWS", 90)
    data = rows()
    got = run(spark, tmp_path, data).collect()
    for r in got[::7]:  # a record is found at its offset
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.at)
            one = next(warc.records_of(zlib.decompressobj(31).decompress(f.read())))
        assert warc.url_key(one[1]["warc-target-uri"]) == r.url_key and one[1]["warc-type"] == r.record_type
    assert len({r.run for r in got}) > 3
    last = {}
    for i, _, html, _ in data:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    want = []
    for i, _, html, _ in data:
        body = (html or "").encode()
        to = last.get(html or "")
        to = None if to == i else to
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted(map(repr, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(repr, want))
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert sorted(r.captured for r in got) == sorted(x[3] or 0 for x in data)


def test_least_and_plain_files(spark, tmp_path):
    data = [(1, "u", "ab", 0), (2, "u", "ab", 0), (3, "u", "abc", 0), (4, "u", "abc", 0)]
    got = {r.page_id: r.refers_to for r in run(spark, tmp_path, data, least=3, compression="none").collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*/part-*"))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Type: revisit") == 1


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []).collect() == []


def test_loser_tree():
    r = random.Random(8)
    for k in range(0, 9):
        runs = [sorted(r.choices(range(20), k=r.randrange(6))) for _ in range(k)]
        assert [x for _, x in warc.LoserTree(runs)] == sorted(x for run in runs for x in run)


def test_dates():
    for s in (0, 951_782_400, 1_704_067_200, 4_102_444_799):
        assert warc.seconds(warc.stamp(s)) == s
    assert warc.stamp(951_782_400) == "2000-02-29T00:00:00Z"
    assert warc.url_key("http://www.Example.com/A/?b=C") == "com,example)/a?b=c"


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Large pages in a row, joined by a shuffle."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    data = [(i, "u", "x" * 8000 + str(i // 2) if i > 500 else "y", i) for i in range(560)]
    got = run(spark, tmp_path, data, compression="none").collect()
    assert all(p.stat().st_size < 22_000 for p in (tmp_path / "w").glob("*/part-*"))
    assert [r.captured for r in got] == list(range(560)) and sum(r.refers_to is None for r in got) == 1 + 30
