"""Removal of repeated byte strings, by suffix arrays.

A byte goes if it lies in a string of WINDOW bytes that also starts earlier, in a document before
or before in the same one. Every such string holds an anchor, its GRAM bytes of least hash, so equal
strings meet in the shard of their anchor: documents are cut into runs of windows with one anchor,
equal runs shrink to their first, and runs go to shards by anchor. A shard builds a suffix
array by Larsson-Sadakane refinement, common prefixes by Kasai's rule, and has its repeated windows
side by side; a shard beyond a bounded size is built in parts, whose sorted windows are merged by
binary search. Anchors of many different runs have these cut into pieces of PIECE windows, which go
to shards by the bytes that all windows of a piece have in common. Repeats that a task finds among
its own runs go to no anchor's shard.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed

WINDOW, GRAM = 100, 16
#: Bytes of text handled at once, of runs to a package of a task, of runs to a shard as aimed at, of text to a suffix array.
CHUNK, PACKAGE, SHARD, PART = 1 << 19, 32 << 20, 24 << 20, 1 << 20
#: One document in SAMPLED is looked at for anchors with about HOT different runs or more; of these the MOST frequent are
#: cut, runs of others stay whole: that decides where runs meet, never what is found.
SAMPLED, HOT, MOST = 16, 16384, 1 << 17
#: Windows to a piece of a hot anchor's run, and the bytes that all of them have in common.
PIECE = 8
COMMON = WINDOW - PIECE + 1
#: Repeats held by a shard before they are given out.
HELD = 1 << 17
#: What a null id sorts as.
NO_ID = 2**63 - 1


def hashes(t: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(t) - GRAM + 1
    a = np.ndarray((len(t) - 7,), "<u8", t.tobytes(), strides=(1,))
    x = a[:n] * np.uint64(0x9E3779B97F4A7C15) + a[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def anchors(h: np.ndarray, bits: int = 20) -> np.ndarray:
    """For the window from each position on, where its anchor is: the first of the least hashes."""
    low = np.uint64((1 << bits) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = span - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    return (m & low).astype(np.int64)


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(document, first byte, bytes) in lists of about CHUNK bytes; long texts in overlapping parts."""
    held, size = [], 0
    for d, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - WINDOW + 1), CHUNK):
            part = t[lo : lo + CHUNK + WINDOW - 1] if len(t) > CHUNK else t
            if held and size + len(part) > CHUNK + WINDOW:
                yield held
                held, size = [], 0
            if len(part) >= WINDOW:
                held.append((d, lo, part))
                size += len(part)
    if held:
        yield held


def runs(parts: list[tuple[int, int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, part, start, number of windows, anchor, its hash) of each run of windows with one anchor."""
    text = b"".join(p for *_, p in parts)
    sizes = np.array([len(p) for *_, p in parts], np.int64)
    h = hashes(np.frombuffer(text, np.uint8))
    at = anchors(h)
    ends = np.cumsum(sizes)
    valid = np.ones(len(at), bool)
    for e in ends[:-1]:  # windows over the end of a part
        valid[e - WINDOW + 1 : e] = False
    v = np.flatnonzero(valid)
    first = np.flatnonzero((np.diff(v, prepend=-2) != 1) | (np.diff(at[v], prepend=-1) != 0))
    start, number = v[first], np.diff(first, append=len(v))
    anchor = at[start]
    return text, np.searchsorted(ends, start, side="right"), start, number, anchor, h[anchor]


def pieces(start: np.ndarray, number: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, number of windows, where the common bytes begin) of the pieces of runs, cut at fixed distances from the anchor."""
    run = np.repeat(np.arange(len(start)), number)
    at = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
    which = (anchor[run] - at) // PIECE
    first = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(which, prepend=-1) != 0))
    run = run[first]
    return run, at[first], np.diff(first, append=len(at)), anchor[run] - PIECE * which[first]


class Packer:
    """Collects runs, equal ones as their first, and packs them by shard; the others are repeats whatever other tasks hold."""

    def __init__(self, shards: int, frequent: np.ndarray):
        self.shards, self.frequent = shards, np.sort(frequent)
        self.clear()

    def clear(self):
        self.first: dict[bytes, tuple] = {}
        self.gone: list[tuple] = []
        self.size = 0

    def add(self, ids: list[tuple[int, int]], parts: list[tuple[int, int, bytes]]) -> None:
        text, part, start, number, anchor, h = runs(parts)
        shared = np.full(len(h), GRAM)
        if len(self.frequent):
            hot = self.frequent[np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)] == h
            if hot.any():
                own, *cut = pieces(start[hot], number[hot], anchor[hot])
                cut = [part[hot][own], *cut, h[hot][own], np.full(len(own), COMMON)]
                part, start, number, anchor, h, shared = (np.concatenate([x[~hot], y]) for x, y in zip((part, start, number, anchor, h, shared), cut, strict=True))
        offset = np.cumsum([0, *(len(p) for *_, p in parts)])
        shard = (h % np.uint64(self.shards)).astype(np.int64)
        own = np.array([d for d, *_ in parts])[part]
        begins = start - offset[part] + np.array([lo for _, lo, _ in parts])[part]
        for k, d, b, s, e, a, n in zip(shard.tolist(), own.tolist(), begins.tolist(), start.tolist(), (start + number + WINDOW - 1).tolist(), (anchor - start).tolist(), shared.tolist(), strict=True):
            run = text[s:e]
            found = self.first.get(run)
            here = (*ids[d], b)
            if found is None:
                if n == COMMON:
                    k = xxhash.xxh3_64_intdigest(run[a : a + n]) % self.shards
                self.first[run] = (k, here, a, n)
                self.size += len(run) + 100
            elif found[1] == here:  # a repeated row
                continue
            else:
                if here < found[1]:
                    self.first[run] = (found[0], here, *found[2:])
                    here = found[1]
                self.gone.append((*here, here[2] + e - s))
                self.size += 100

    def packages(self) -> tuple[list[int], list[bytes]]:
        by = defaultdict(lambda: ([], [], [], []))
        for run, (k, here, a, n) in self.first.items():
            for held, x in zip(by[k], (run, here, a, n), strict=True):
                held.append(x)
        shards, out = list(by), [packed(pack(*p)) for p in by.values()]
        if self.gone:  # to any shard, which one the first text says
            rows = united(np.array(self.gone, np.int64))
            shards.append(int(rows[0, 1]) % self.shards)
            out.append(packed(rows))
        self.clear()
        return shards, out


def packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x))


def pack(texts: list[bytes], places: list[tuple], offsets: list[int], shared: list[int]) -> tuple:
    columns = [np.array(c, np.int64) for c in zip(*places, strict=True)]
    return b"".join(texts), np.array([len(t) for t in texts], np.int32), columns, np.array(offsets, np.uint8), np.array(shared, np.uint8)


def suffix_order(t: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Positions sorted by the ``depth`` bytes from each on, ties by position: Larsson-Sadakane refinement.

    Positions are sorted by eight bytes; then only groups that are still equal are sorted, by the rank of
    what follows the bytes compared so far, whose number doubles.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).tobytes()
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + depth, np.int64)  # from 1; 0 past the end
    opens = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.empty(0, bool)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0)) + 1
    h = 8
    while h < depth:
        step = min(h, depth - h)
        alone = opens & np.concatenate([opens[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        sub = order[slots]
        key = (rank[sub] << 32) | rank[sub + step]
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[slots] = sub
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        opens[slots] = starts
        rank[sub] = np.maximum.accumulate(np.where(starts, slots, 0)) + 1
        h += step
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int = WINDOW, lanes: int = 16384) -> np.ndarray:
    """For each place in the order how many bytes, at most ``most``, it has in common with the place before.

    Kasai's rule: from one position to the next the common prefix with the predecessor loses at most
    one byte, so comparing goes on from there. That holds where the predecessor's next position comes
    before this one; it may not after a tie, since the order looks at ``most`` bytes only, and then
    comparing starts anew. The text is walked in lanes side by side.
    """
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.arange(n), n
    padded = np.concatenate([t, np.zeros(most + 8, np.uint8)]).tobytes()
    word = np.ndarray((n + most,), "<u8", padded, strides=(1,))
    length = -(-n // min(lanes, n))
    starts = np.arange(0, n, length)
    common, h, j = np.zeros(n, np.int64), np.zeros(len(starts), np.int64), np.full(len(starts), n - 1)
    for step in range(length):
        i = starts + step
        live = i < n
        starts, i, h, j = starts[live], i[live], h[live], j[live]
        goes_on = rank[j + 1] < rank[i]
        j = before[i]
        h = np.where(goes_on & (j >= 0), np.maximum(h - 1, 0), 0)
        open_ = np.flatnonzero((j >= 0) & (h < most))
        while len(open_):
            a, b, g = i[open_], j[open_], h[open_]
            differ = word[a + g] ^ word[b + g]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
            same = np.minimum(same, n - np.maximum(a, b) - g)  # not past the end
            h[open_] = np.minimum(most, g + same)
            open_ = open_[(same == 8) & (h[open_] < most)]
        common[i] = h
    return common[order]


def firsts(place: tuple[np.ndarray, ...], group: np.ndarray) -> np.ndarray:
    """For each row whether it is the first of its group by the columns of ``place``."""
    by = np.lexsort((*place[::-1], group))
    out = np.zeros(len(group), bool)
    out[by[np.flatnonzero(np.diff(group[by], prepend=-1))]] = True
    return out


def merge(windows: np.ndarray, where: np.ndarray, others: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of windows that another part has earlier, the sorted windows of both parts, where each starts first)."""
    k = np.searchsorted(windows, others)
    met = np.flatnonzero(windows[np.minimum(k, len(windows) - 1)] == others)
    old, new = where[k[met]], places[met]
    differs = old != new
    column = differs.argmax(1)[:, None]
    first = (np.take_along_axis(old, column, 1) <= np.take_along_axis(new, column, 1)).ravel()
    where[k[met[~first]]] = new[~first]
    alone = np.ones(len(others), bool)
    alone[met] = False
    gone = np.concatenate([new[first & differs.any(1)], old[~first]])
    return gone, np.insert(windows, k[alone], others[alone]), np.insert(where, k[alone], places[alone], axis=0)


def repeated(texts: list[bytes], places: np.ndarray) -> Iterator[np.ndarray]:
    """(id, key, window start) of each window that starts earlier in another of the runs ``texts``, which start at ``places``."""
    merged: np.ndarray | None = None  # the sorted windows of parts so far, and where each starts first
    where = np.empty((0, 3), np.int64)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PART):
            size += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        sizes = np.array([len(x) for x in part], np.int64)
        t = np.frombuffer(b"".join(part), np.uint8)
        order = suffix_order(t)
        opens = common_prefixes(t, order) < WINDOW
        group = np.cumsum(opens)
        run = np.repeat(np.arange(len(part)), sizes)
        inside = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = inside[order] + WINDOW <= sizes[run[order]]
        at, group = order[keep], group[keep]
        place = places[lo + run[at]].copy()
        place[:, 2] += inside[at]
        first = firsts(tuple(place.T), group)
        yield place[~first]
        if hi - lo < len(texts):  # more than one part
            at, place = at[first], place[first]
            # bytes of UTF-8 are never 255: one more keeps zeros from being cut off
            windows = np.lib.stride_tricks.sliding_window_view(t, WINDOW)[at] + np.uint8(1)
            windows = np.ascontiguousarray(windows).view(f"S{WINDOW}").ravel()
            by = np.argsort(windows, kind="stable")
            windows, place = windows[by], place[by]
            if merged is None:
                merged, where = windows, place
            else:
                later, merged, where = merge(merged, where, windows, place)
                yield later
        lo = hi


def bounded(groups: list[list[tuple]]) -> Iterator[list[tuple]]:
    """The runs of whole groups in lists of at most PART bytes; a larger group by itself."""
    held, size = [], 0
    for own in groups:
        n = sum(len(r) for r, _ in own)
        if held and size + n > PART:
            yield held
            held, size = [], 0
        held += own
        size += n
    if held:
        yield held


def judged(packages: Iterator[bytes]) -> Iterator[np.ndarray]:
    """(id, key, lo, hi): the bytes that go, of one shard's packages."""
    first: dict[bytes, tuple] = {}
    gone: list[tuple] = []
    for package in packages:
        content = pickle.loads(zstandard.ZstdDecompressor().decompress(package))
        if isinstance(content, np.ndarray):  # repeats already
            yield content
            continue
        joined, sizes, places, offsets, shared = content
        at = 0
        for n, d, k, b, a, c in zip(sizes.tolist(), *(x.tolist() for x in places), offsets.tolist(), shared.tolist(), strict=True):
            run, here = joined[at : at + n], (d, k, b)
            at += n
            found = first.get(run)
            if found is None:
                first[run] = (here, a, c)
            elif found[0] != here:
                if here < found[0]:
                    first[run] = (here, a, c)
                    here = found[0]
                gone.append((*here, here[2] + n))
        if len(gone) >= HELD:
            yield united(np.array(gone, np.int64))
            gone = []
    if gone:
        yield united(np.array(gone, np.int64))
    by = defaultdict(list)
    for run, (here, a, c) in first.items():
        by[run[a : a + c]].append((run, here))
    # different runs of one anchor may share windows, unless each is a single window
    meeting = [own for own in by.values() if len(own) > 1 and any(len(r) > WINDOW for r, _ in own)]
    del first, by
    for together in bounded(meeting):
        for found in repeated([r for r, _ in together], np.array([h for _, h in together], np.int64)):
            if len(found):
                yield united(np.column_stack([found, found[:, 2] + WINDOW]))


def united(rows: np.ndarray) -> np.ndarray:
    """Spans (id, key, lo, hi) with those that overlap or touch as one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
    # the furthest end so far within each document
    doc = np.cumsum(new) - 1
    base = doc * (int(rows[:, 3].max(initial=0)) + 1)
    far = np.maximum.accumulate(rows[:, 3] + base) - base
    opens = new | np.concatenate([[True], rows[1:, 2] > far[:-1]])
    at = np.flatnonzero(opens)
    last = np.concatenate([at[1:], [len(rows)]]) - 1
    return np.column_stack([rows[at, :3], far[last]])


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of the anchors with HOT different runs or more, as far as one document in SAMPLED tells; at most MOST of them."""
    sample = docs.filter(F.pmod(F.xxhash64("id", "key"), F.lit(SAMPLED)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in segments([x.as_py() for x in b.column(0)]):
                text, _, start, number, _, h = runs(parts)
                own = [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(start.tolist(), (start + number + WINDOW - 1).tolist(), strict=True)]
                rows = np.unique(np.column_stack([h, np.array(own, np.uint64)]), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], ["h", "run"])

    counts = sample.mapInArrow(run, "h long, run long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.filter(F.col("n") >= max(1, HOT // SAMPLED)).orderBy(F.desc("n"), "h").limit(MOST).select("h").collect()
    return np.array([r.h for r in rows], np.int64).view(np.uint64)


def repeats(docs: DataFrame) -> DataFrame:
    """``(id, key, lo, hi)``: the bytes that go, of ``(id, key, text)`` with text as binary; spans of a document may touch."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size * 10 // (3 * SHARD)))
    frequent = frequent_anchors(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shards, frequent)

        def out() -> pa.RecordBatch:
            shard, package = packer.packages()
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(package, pa.binary())], ["shard", "package"])

        for b in batches:
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for parts in segments([x.as_py() for x in b.column(2)]):
                packer.add(ids, parts)
                if packer.size >= PACKAGE:
                    yield out()
        yield out()

    sent = docs.select("id", "key", "text").mapInArrow(run, "shard long, package binary")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in judged(x.as_py() for b in batches for x in b.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["id", "key", "lo", "hi"])

    # a partition for each shard, so that no task gets several by chance
    return sent.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(judge, "id long, key long, lo long, hi long")


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the last column compressed: they are shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = pa.array([pack.compress(x.as_py()) for x in b.columns[-1]], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=b.schema.names)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)`` of every row: the bytes that remain, and the (lo, hi) of those that went.

    Strings are judged on the texts as they come in. A null text is empty; texts shorter than WINDOW
    lose nothing. A null id sorts after all others. Rows of one id and text are one document and
    all lose the same; rows of one id and different texts are documents one after the other.
    """
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("text"))
    own = own.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"), "text")
    found = checkpointed(repeats(own))
    spans = found.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    joined = own.mapInArrow(packed_texts, own.schema).join(spans, ["id", "key"], "left").select("doc_id", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            sizes, kept, gone = [], [], []
            for x, s in zip(b.column(1), b.column(2), strict=True):
                t, at, out, lost = unpack.decompress(x.as_py()), 0, [], []
                for r in sorted(s.as_py() or [], key=lambda r: r["lo"]):
                    if lost and r["lo"] <= lost[-1]["hi"]:
                        lost[-1]["hi"] = max(lost[-1]["hi"], r["hi"])
                    else:
                        lost.append(dict(r))
                for r in lost:
                    out.append(t[at : r["lo"]])
                    at = r["hi"]
                out.append(t[at:])
                sizes.append(len(t))
                kept.append(b"".join(out))
                gone.append(lost)
            spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, spans_type)], ["doc_id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<lo:long,hi:long>>")


def report(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of deduplicated()'s rows."""
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
