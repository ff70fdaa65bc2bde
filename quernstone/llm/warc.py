"""WARC archives of pages, and their capture histories by external index merge.

Archives are capture runs: each file's records are sorted by URL key, time and page. The index of
what is read back keeps that order per run; the runs' slices of each range of keys are merged by
a loser tree, so that all ranges together are one globally ordered capture history. Archives are
bounded by bytes and ranges by rows, so that no task holds more, however large the table is. Each
record is a gzip member of its own, found at the offset that the index has.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, ensure_checkpoint_dir, sliced

#: What ends each record; the bytes of records from which the next ones go to another archive; index rows to a range of keys;
#: payloads that occur several times up to which they are broadcast.
END, ARCHIVE_BYTES, RANGE_ROWS, BROADCAST_ROWS = "\r\n\r\n", 16 << 20, 100_000, 200_000
#: An empty gzip member: what stands between the members of an archive, one for each record.
BETWEEN = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
INDEX = "url_key string, captured long, page_id long, run string, at long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """The key that captures of one URL share: host labels reversed, then path and query, lower-cased."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    host = host.removeprefix("www.")
    port = f":{port}" if port and port not in (80, 443) else ""
    path = parts.path.rstrip("/") or "/"
    return f"{','.join(reversed(host.split('.')))}{port}){path}{'?' + parts.query if parts.query else ''}".lower()


def target(url: str | None) -> str:
    """A URL as a header holds it: what is not printable ASCII percent-encoded."""
    return quote(url or "", safe="".join(map(chr, range(33, 127))))


def stamp(captured: int) -> str:
    """Seconds since 1970 as a WARC date."""
    days, s = divmod(captured, 86400)
    era, doe = divmod(days + 719468, 146097)  # 400 years have that many days
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    day, month = doy - (153 * mp + 2) // 5 + 1, mp + 3 if mp < 10 else mp - 9
    y = yoe + era * 400 + (month <= 2)
    return f"{y:04d}-{month:02d}-{day:02d}T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, captured: int, response: int | None) -> bytes:
    """One record without its end; ``response``: the page that a revisit refers to, None for a response."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {stamp(captured)}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if response is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(response)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record, by the lengths that they state."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        yield at, headers, archive[head + 4 : head + 4 + size]
        at = head + 4 + size + len(END)


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def members(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member that is not empty."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        z, out, lo = zlib.decompressobj(31), [], at
        while not z.eof:
            if at >= len(archive):
                raise ValueError("an archive ends within a record")
            part = view[at : at + (1 << 16)]
            out.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        if content := b"".join(out):
            yield lo, content


def resolved(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` with ``refers_to``: the largest page_id with the same payload where that is another, else null.

    Only the digests of payloads that occur several times are joined, so payloads stay where they are
    unless there are more than BROADCAST_ROWS of those.
    """
    keyed = pages.withColumn("payload_key", F.unhex(F.sha2("payload", 256)))
    held = keyed.filter(F.octet_length("payload") >= least).groupBy("payload_key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    last = checkpointed(held.filter("n > 1 and last is not null").select("payload_key", "last"))
    small = last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(last) if small else last, "payload_key", "left")
    return joined.select("page_id", "url", "payload", "captured", F.when(F.col("last") != F.coalesce("page_id", F.col("last") - 1), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """Archives of ``(page_id, url, html, captured)`` under ``path``: a record for every row.

    Of rows with equal payloads of at least ``least`` bytes those with the largest page_id are responses,
    the others revisit it; smaller payloads are all responses. A null html is empty, a null url too, a row
    with a null page_id revisits an equal page that has one. captured: seconds since 1970, null is 0.
    A task's rows go to archives of about ARCHIVE_BYTES, or of one record if that is larger, each sorted.
    Spark's own writer stores the files, so any file system will do and a lost task is written again.
    Repeated rows of a page have records of one id. An empty table gives no archives. ``compression``:
    gzip, a member for each record, or none.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload, F.coalesce(F.col("captured").cast("long"), F.lit(0)).alias("captured"))
    packed = compression == "gzip"
    if compression not in ("gzip", "none"):
        raise ValueError("compression is gzip or none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held = 0
        for b in sliced(batches):
            page, url, payload, captured, refers = (b.column(i) for i in range(5))
            keys = [url_key(target(u.as_py())) for u in url]
            made, runs = [], []
            for i, u, p, c, r in zip(page, url, payload, captured, refers, strict=True):
                made.append(record(i.as_py(), u.as_py(), p.as_py(), c.as_py(), r.as_py()))
                if held and held + len(made[-1]) > ARCHIVE_BYTES:
                    number, held = number + 1, 0
                held += len(made[-1])
                runs.append(number)
                if packed:
                    made[-1] = member(made[-1] + END.encode())
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int32()), pa.array(keys, pa.string()), captured, page, pa.array(made, pa.binary())], ["run", "url_key", "captured", "page_id", "value"])

    made = resolved(pages, least).mapInArrow(run, "run int, url_key string, captured long, page_id long, value binary")
    made = made.sortWithinPartitions("run", "url_key", "captured", "page_id").select("run", F.col("value").cast("string").alias("value"))
    between = {"lineSep": BETWEEN.decode("latin-1"), "encoding": "ISO-8859-1"} if packed else {"lineSep": END}
    made.write.partitionBy("run").options(**between).mode("errorifexists").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of all records: INDEX; ``at``: where the record, or its gzip member, starts in the file ``run``.

    A response's payload is measured and digested anew, a revisit says what it had. No files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                archive = content.as_py()
                packed = archive[:2] == b"\x1f\x8b"
                each = ((at, h, block) for at, one in members(archive) for _, h, block in records_of(one)) if packed else records_of(archive)
                for at, h, block in each:
                    http, _, payload = block.partition(b"\r\n\r\n")
                    page = lambda x: int(x.removeprefix("<urn:page:")[:-1]) if x and len(x) > len("<urn:page:>") else None
                    kind, stated = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and digest_of(payload) != stated:
                        raise ValueError(f"a payload in {name} is not what was written")
                    rows.append((url_key(h["warc-target-uri"]), seconds(h["warc-date"]), page(h["warc-record-id"]), name.as_py(), at, kind, size, stated, page(h.get("warc-refers-to"))))
                yield pa.RecordBatch.from_pydict(dict(zip(SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in SCHEMA.names}, SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def seconds(date: str) -> int:
    y, m, d = (int(x) for x in date[: date.index("T")].rsplit("-", 2))
    h, mi, s = (int(x) for x in date[date.index("T") + 1 : -1].split(":"))
    y -= m <= 2
    era, yoe = divmod(y, 400)
    doe = yoe * 365 + yoe // 4 - yoe // 100 + (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return (era * 146097 + doe - 719468) * 86400 + h * 3600 + mi * 60 + s


SCHEMA = pa.schema(
    [("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("run", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


class LoserTree:
    """A k-way merge of sorted runs: inner nodes hold the loser of each match, so a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [0] * max(1, self.k)
        self.winner = self.play(1) if self.k else None

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def play(self, node: int) -> int:
        """The winner below a node; leaves are k to 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        if self.beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            best = self.winner
            yield best, self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            node = (best + self.k) // 2
            while node:
                if self.beats(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def histories(index: DataFrame) -> DataFrame:
    """The index in global order of url_key, captured and page_id: partition after partition, row after row.

    Ranges of those three, and of the place in the archives among ties, hold about RANGE_ROWS each, so that
    a frequent URL is split too; each range gets its slices of all runs. Ties of all three stay in
    the order of their runs' names and places. An empty index gives no rows.
    """
    index = checkpointed(index)
    ranges = max(1, -(-index.count() // RANGE_ROWS))
    ranged = index.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "at").sortWithinPartitions("run", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), SCHEMA) if (batches := list(batches)) else SCHEMA.empty_table()
        keys = list(zip(*(t[c].to_pylist() for c in ("url_key", "captured", "page_id")), strict=True))
        names = t["run"].to_pylist()
        starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
        order = [(a, b, c is not None, c or 0) for a, b, c in keys]
        runs = [[(order[i], i) for i in range(lo, hi)] for lo, hi in zip(starts, starts[1:], strict=False)]
        merged = t.take(pa.array([i for _, (_, i) in LoserTree(runs)], pa.int64()))
        yield from merged.to_batches()

    return ranged.mapInArrow(run, INDEX)


def new_folder(spark: SparkSession) -> str:
    """A folder for archives beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
