"""SimHash near-duplicates: fingerprints, and exact pairs by vantage-point trees.

A tree over a bounded sample of fingerprints cuts Hamming space into shards: at each node those
in a small ball around a vantage point go left, the others right. By the triangle inequality a
ball of the link radius lies on one side unless its centre is that near to the boundary; only then
is a fingerprint sent to shards beyond its own, and only from outside a ball into it, so that each
pair meets once. Within a shard splits go on at median distances until blocks are small enough to compare. Shards return a spanning forest of their links, never all pairs; components of the
whole come from alternating large and small stars.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import checkpointed, sliced

#: Hash seed; fingerprints to a shard as aimed at; sampled fingerprints, how many of them a ball is chosen by, and vantage points tried; comparisons done at once.
SEED, SHARD_ROWS, SAMPLE_ROWS, NEAR_ROWS, TRIED, BLOCK_CELLS = 42, 4096, 262_144, 65_536, 16, 1 << 20
#: Word fingerprints of a text that one_of_each() links by, and rows up to which a counted side is broadcast.
VIEWS, BROADCAST_ROWS = 2, 200_000
#: Bins of a sketch of a text's shingles, standard errors that an estimate may lie under the similarity, and the likeliest
#: partners of a text in each cell that are compared before all others.
BINS, ERRORS, LIKELIEST = 128, 4, 2
#: Bands of a text's least hashes and hashes to a band: texts of a Jaccard similarity j share none with a chance of
#: (1 - j ** BAND_ROWS) ** BANDS, 0.00003 at 0.8 and less above.
BANDS, BAND_ROWS = 20, 4
#: Nodes to a side of a cell of a bucket, nodes to a task, and sketches compared at once.
CELL_ROWS, TASK_ROWS, SKETCH_CELLS = 4096, 16384, 1 << 16
MIXED = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.int64).view(np.uint64)
#: Shingles whose bits are summed at once.
CHUNK = 1 << 17


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word.

    A-Z are lower-cased, words are runs other than space and \\x09-\\x0D. A bit is 1 if it is set in
    over half of the shingles' XXH64. Fewer words than ``width`` are one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), CHUNK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + CHUNK], ends[lo : lo + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, f)`` of every row, f as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            f = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    cols = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, f long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point among ``points`` and the median distance to it; None if no split is left.

    Of a few spread over the array the one whose distances vary most is taken.
    """
    near = points[:: max(1, len(points) // 512)]
    tried = points[:: max(1, len(points) // 8)][:8]
    order = sorted(range(len(tried)), key=lambda i: -float(distance(near, tried[i]).var()))
    for i in order:
        d = distance(points, tried[i])
        mu = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        if (d > mu).any():
            return tried[i], mu
        if mu > 0 and (d < mu).any():
            return tried[i], mu - 1
    return None


def ball(points: np.ndarray, leaf: int, radius: int) -> tuple[np.uint64, int]:
    """A vantage point and the radius of a ball around it that holds about ``leaf`` of the distinct points, half of them at most.

    Distances to a point crowd around their median, so a cut there has most balls of the link radius on
    both sides. A small ball lies where few points are: of a few vantage points that one is taken for which
    the fewest points are near the cut for each point within.
    """
    near = points[:: max(1, len(points) // NEAR_ROWS)]
    most = max(1, int(len(near) * min(0.5, 1.5 * leaf / len(points))))
    best = None
    for v in points[:: max(1, len(points) // TRIED)][:TRIED]:
        upto = np.cumsum(np.bincount(distance(near, v), minlength=65 + radius))
        mu = max(0, int(np.searchsorted(upto[:65], most, side="right")) - 1)
        cost = upto[mu + radius] / max(1, upto[mu])
        if best is None or cost < best[0]:
            best = cost, v, mu
    return best[1:]


def build(sample: np.ndarray, leaf: int, radius: int = 3) -> list[tuple]:
    """The tree as a list of nodes: ("leaf", shard) or ("node", vantage point, radius, left, right)."""
    nodes: list = [None]
    shards, stack = 0, [(0, sample)]
    while stack:
        at, points = stack.pop()
        if len(points) <= 2 * leaf:
            nodes[at] = ("leaf", shards)
            shards += 1
            continue
        v, mu = ball(points, leaf, radius)
        d = distance(points, v)
        nodes[at] = ("node", v, mu, len(nodes), len(nodes) + 1)
        stack += [(len(nodes), points[d <= mu]), (len(nodes) + 1, points[d > mu])]
        nodes += [None, None]
    return nodes


def sampled(nodes: DataFrame, rows: int, n: int) -> np.ndarray:
    """About ``rows`` of the ``n`` fingerprints ``f``, by a hash of them; all if they are fewer."""
    least = int(1_000_000_000 * min(1.0, rows / max(n, 1))) + 1
    got = nodes.filter(F.pmod(F.xxhash64("f", F.lit("sample")), F.lit(1_000_000_000)) < least).select("f").toArrow()
    return np.sort(np.asarray(got["f"])).view(np.uint64)


def routed(f: np.ndarray, tree: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, shard, home): each fingerprint's own shard, and the earlier ones that its ball reaches."""
    at, shard, own = [], [], []
    stack = [(0, np.arange(len(f)), np.ones(len(f), bool))]
    while stack:
        k, idx, home = stack.pop()
        if not len(idx):
            continue
        node = tree[k]
        if node[0] == "leaf":
            at.append(idx)
            shard.append(np.full(len(idx), node[1]))
            own.append(home)
            continue
        _, p, mu, left, right = node
        d = distance(f[idx], p)
        inner = d <= mu
        # what is at home outside the ball visits it, not the other way: each pair meets in the earlier shard, and
        # a shard has about as many visitors as points are that near to its ball
        go_left = d - radius <= mu
        stack.append((left, idx[go_left], home[go_left] & inner[go_left]))
        go_right = np.where(home, ~inner, d + radius > mu)
        stack.append((right, idx[go_right], home[go_right]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (at, shard, own))


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of pairs; roots are the smallest positions."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = roots(parent)
    return parent


def pairs(f: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) in blocks, i at home: all pairs of positions within the radius, found by further splits."""
    stack = [(np.flatnonzero(home), np.arange(len(f)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        cut = vantage(f[p]) if len(p) * len(q) > BLOCK_CELLS else None
        if cut is not None:
            v, mu = cut
            dp, dq = distance(f[p], v), distance(f[q], v)
            stack.append((p[dp <= mu], q[dq - radius <= mu]))
            stack.append((p[dp > mu], q[dq + radius > mu]))
            continue
        step = max(1, BLOCK_CELLS // len(q))
        for lo in range(0, len(p), step):
            d = distance(f[p[lo : lo + step], None], f[None, q])
            i, j = np.nonzero(d <= radius)
            apart = p[lo + i] != q[j]
            i, j = i[apart], j[apart]
            yield p[lo + i], q[j], d[i, j].astype(np.int64)


def forest(f: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each position the root of what it is linked to, over pairs with at least one at home."""
    parent = np.arange(len(f))
    for i, j, _ in pairs(f, home, radius):
        apart = parent[i] != parent[j]
        parent = unite(parent, i[apart], j[apart])
    return parent


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node on an edge ``(a, b)``; component: the smallest node reachable.

    Alternates large and small stars until nothing changes; each round is written to the
    checkpoint folder. Nodes are longs.
    """
    cols = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = checkpointed(edges.filter("a <> b").select(*cols).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = checkpointed(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            break
        state = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: a spanning forest of the links among ``nodes (f, node)``, f unique."""
    n = nodes.count()
    sample = sampled(nodes, SAMPLE_ROWS, n)
    tree = build(sample, max(32, len(sample) * SHARD_ROWS // max(n, 1)), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, node = np.asarray(b.column(0)), np.asarray(b.column(1))
            at, shard, home = routed(f.view(np.uint64), tree, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(f[at]), pa.array(node[at]), pa.array(home.astype(bool))], ["shard", "f", "node", "home"])

    def within(t: pa.Table) -> pa.Table:
        node = np.asarray(t["node"])
        order = np.argsort(node, kind="stable")  # roots are then the smallest nodes
        node, f, home = node[order], np.asarray(t["f"])[order].view(np.uint64), np.asarray(t["home"])[order]
        root = forest(f, home, radius)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(node[tied]), "b": pa.array(node[root[tied]])})

    met = nodes.select("f", "node").mapInArrow(route, "shard long, f long, node long, home boolean")
    return met.groupBy("shard").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, f, component_id)`` of every row; component_id: the smallest doc_id reachable by links.

    Fingerprints with at most ``radius`` differing bits are linked, equal ones too. A null or empty text
    has fingerprint zero. Rows with a null id have a fingerprint, link nothing and have a null
    component. Repeated rows each come back. Empty tables give no rows.
    """
    all_rows = checkpointed(fingerprints(docs, id, text, width))
    nodes = checkpointed(all_rows.filter(F.col("doc_id").isNotNull()).groupBy("f").agg(F.min("doc_id").alias("node")))
    named = components(links(nodes, radius))
    by_f = nodes.join(named, "node", "left").select(F.col("f").alias("__f"), F.coalesce("component", "node").alias("component_id"))
    joined = all_rows.join(by_f, all_rows.f == by_f["__f"], "left")
    return joined.select("doc_id", "f", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def normal(text: bytes | None) -> bytes:
    """A text's lower-cased words, one space between."""
    return b" ".join((text or b"").lower().split())


def key_of(words: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(words), "<i8")
    return int(a), int(b)


def views_of(words: bytes) -> np.ndarray:
    """VIEWS independent 64-bit SimHashes of a text's words, each counting as often as it occurs."""
    counts = Counter(words.split())
    if not counts:
        return np.zeros(VIEWS, np.uint64)
    raw = b"".join(xxhash.xxh3_128_digest(w, seed=s) for w in counts for s in range(VIEWS // 2))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(counts), -1), axis=1)
    n = np.fromiter(counts.values(), np.float32, len(counts))
    ones = np.zeros(bits.shape[1])
    for lo in range(0, len(n), CHUNK):
        ones += n[lo : lo + CHUNK] @ bits[lo : lo + CHUNK]
    return np.packbits(2 * ones > n.sum(dtype=float)).view(">u8").astype(np.uint64)


def shingles_of(words: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of fewer words the whole is one."""
    ends = np.flatnonzero(np.frombuffer(words + b" ", np.uint8) == 32)
    if len(ends) <= width:
        return np.array([xxhash.xxh64_intdigest(words, SEED)], np.uint64)
    starts = np.concatenate([[0], ends[: len(ends) - width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(words[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``(row, key_a, key_b)``: each row of ``docs`` as a struct, and the key of its words."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys = [key_of(normal(x.as_py())) for x in b.column(0).field(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], ["row", "key_a", "key_b"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("key_a", "long").add("key_b", "long"))


def neighbours(f: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that link each position with its first and its nearest neighbour, over pairs with at least one at home."""
    none = np.int64(2**62)
    first, near = np.full(len(f), none), np.full(len(f), none)
    for i, j, d in pairs(f, home, radius):
        for a, b in ((i, j), (j, i)):
            np.minimum.at(first, a, b)
            np.minimum.at(near, a, (d << 40) + b)
    linked = np.flatnonzero(first != none)
    return np.concatenate([linked, linked]), np.concatenate([first[linked], near[linked] & ((1 << 40) - 1)])


def candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: linked pairs of ``nodes (node, views)`` in any view, a few for each node at most.

    Nodes of one fingerprint link to the smallest of them; different fingerprints within the radius
    link, as the smallest node of each, to their first and their nearest neighbour.
    """
    flat = nodes.select("node", F.posexplode("views").alias("view", "f"))
    same = checkpointed(flat.groupBy("view", "f").agg(F.min("node").alias("first")))
    equal = flat.join(same, ["view", "f"]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    n = max(1, same.count() // VIEWS)
    trees = []
    for v in range(VIEWS):
        sample = sampled(same.filter(F.col("view") == v), SAMPLE_ROWS // VIEWS, n)
        trees.append(build(sample, max(32, len(sample) * SHARD_ROWS // n), radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view, f, node = (np.asarray(b.column(i)) for i in range(3))
            for v in np.unique(view):
                own = np.flatnonzero(view == v)
                at, shard, home = routed(f[own].view(np.uint64), trees[v], radius)
                at = own[at]
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64) * VIEWS + v), pa.array(f[at]), pa.array(node[at]), pa.array(home.astype(bool))], ["shard", "f", "node", "home"])

    def within(t: pa.Table) -> pa.Table:
        node = np.asarray(t["node"])
        order = np.argsort(node, kind="stable")
        node, f, home = node[order], np.asarray(t["f"])[order].view(np.uint64), np.asarray(t["home"])[order]
        i, j = neighbours(f, home, radius)
        return pa.table({"a": pa.array(node[i]), "b": pa.array(node[j])})

    met = same.select("view", "f", F.col("first").alias("node")).mapInArrow(route, "shard long, f long, node long, home boolean")
    found = met.groupBy("shard").applyInArrow(within, "a long, b long").unionByName(equal)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def sketch(shingles: np.ndarray) -> bytes:
    """One-permutation MinHash of sorted hashes, a byte of the least hash in each bin, 0 for an empty bin; then their number."""
    out = np.zeros(BINS, np.uint8)
    bins, at = np.unique(shingles >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = 1 + shingles[at] % np.uint64(255)
    return out.tobytes() + len(shingles).to_bytes(8, "little")


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of the least hashes of a text's shingles under BANDS * BAND_ROWS mixings."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), CHUNK >> 5):
        each = (shingles[lo : lo + (CHUNK >> 5), None] ^ MIXED[0]) * (MIXED[1] | np.uint64(1))
        least = np.minimum(least, each.min(0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)), np.uint64, BANDS)


def sets_of(docs: DataFrame, groups: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, s)``: the shingles of the texts of ``nodes (node)``, from the least of the ``docs (doc_id, text)`` of each.

    Other texts of such an id are nodes of their own, which may come along.
    """
    ends = groups.join(nodes.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    ends = checkpointed(ends)
    small = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [normal(x.as_py()) for x in b.column(0)]
            made = pa.array([shingles_of(t, width).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([key_of(t)[0] for t in texts], pa.int64()), made], ["node", "s"])

    own = docs.join(F.broadcast(ends) if small else ends, "doc_id", "left_semi").select("text")
    return own.mapInArrow(run, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))


def met(edges: DataFrame, held: DataFrame) -> DataFrame:
    """``(a, b, x, y)``: each edge with what is held of both ends."""
    left = edges.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    return left.join(held.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")


def estimates(x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The share of equal bins of sketches, along the last axis, and whether the similarity is not clearly missed.

    It is missed for sure where one text has too few shingles for the other's.
    """
    size = [np.ascontiguousarray(s[..., BINS:]).view("<u8")[..., 0].astype(float) for s in (x, y)]
    x, y = x[..., :BINS], y[..., :BINS]
    n = np.maximum(1, ((x > 0) | (y > 0)).sum(-1))
    alike = ((x == y) & (x > 0)).sum(-1) / n
    fits = np.minimum(*size) >= similarity * np.maximum(*size) - 1e-6
    return alike, fits & (alike >= similarity - ERRORS * np.sqrt(similarity * (1 - similarity) / n))


def stacked(sketches) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), np.uint8) for v in sketches])


def likely(edges: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The edges ``(a, b)`` that sketches do not show to be clearly under the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if b.num_rows:
                kept = pa.array(estimates(stacked(b.column(2)), stacked(b.column(3)), similarity)[1])
                yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], ["a", "b"])

    return met(edges, sketches).mapInArrow(run, "a long, b long")


def buckets_of(groups: DataFrame) -> DataFrame:
    """``(bucket, first, node)``: nodes that share a band, the smallest of them first; buckets of the same nodes once."""
    flat = groups.select(F.col("a").alias("node"), F.explode("bands").alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    sizes = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), *marks).filter("n > 1")
    once = sizes.groupBy("n", "first", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "first")
    return flat.join(once, "bucket").select("bucket", "first", "node")


def torn(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, node, component, minor, n, minors)`` of the buckets that hold several components.

    minor: not of the bucket's largest component; n nodes are in the bucket, minors of them such.
    """
    own = buckets.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    sizes = parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most")).filter("n > most.m")
    sizes = sizes.select("bucket", "n", (F.col("n") - F.col("most.m")).alias("minors"), F.col("most.component").alias("major"))
    return own.join(sizes, "bucket").select("bucket", "node", "component", (F.col("component") != F.col("major")).alias("minor"), "n", "minors")


def crossed(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray, similarity: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of sketches of different components that may be as similar, for each i the likeliest ``most``."""
    step = max(1, SKETCH_CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        alike, kept = estimates(x[at : at + step, None], y[None], similarity)
        kept &= of_x[at : at + step, None] != of_y[None]
        if most < len(y):
            j = np.argpartition(-np.where(kept, alike, -1.0), most - 1, axis=1)[:, :most]
            i = np.repeat(np.arange(len(j)), most)
            j = j.ravel()
            yield at + i[kept[i, j]], j[kept[i, j]]
        else:
            i, j = np.nonzero(kept)
            yield at + i, j


def celled(own: DataFrame, held: DataFrame, within) -> DataFrame:
    """``(a, b)`` of ``within(node, component, left, s, cell)`` for torn()'s rows with what is ``held (node, s)`` of them.

    A bucket is dealt out as a grid of cells with about CELL_ROWS nodes to a side: on the left what is not in
    its largest component, on the right all. A task has several cells, as numbers.
    """
    over = lambda c: F.ceil(F.col(c) / CELL_ROWS).cast("long")
    part = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), over(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), over(c) - 1))
    left = own.filter("minor").withColumn("l", part("minors")).withColumn("r", every("n")).withColumn("left", F.lit(True))
    right = own.withColumn("r", part("n")).withColumn("l", every("minors")).withColumn("left", F.lit(False))
    cells = left.select("bucket", "l", "r", "left", "node", "component").unionByName(right.select("bucket", "l", "r", "left", "node", "component"))
    cells = checkpointed(cells)
    shards = cells.count() // TASK_ROWS + 1

    def run(t: pa.Table) -> pa.Table:
        key = np.stack([np.asarray(t[c]) for c in ("bucket", "l", "r")], 1)
        cell = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        a, b = within(np.asarray(t["node"]), np.asarray(t["component"]), np.asarray(t["left"]).astype(bool), t["s"], cell)
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    dealt = cells.join(held, "node").withColumn("shard", F.pmod(F.xxhash64("bucket", "l", "r"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def by_cell(cell: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows on the left and on the right of each cell."""
    order = np.argsort(cell, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        yield own[left[own]], own[~left[own]]


def proposed(own: DataFrame, sketches: DataFrame, similarity: float, most: int) -> DataFrame:
    """``(a, b)``: of each node on the left of a cell the ``most`` likeliest partners, by sketches."""

    def within(node, component, left, sketch, cell):
        s, out = stacked(sketch), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for x, y in by_cell(cell, left):
            out += [(node[x[i]], node[y[j]]) for i, j in crossed(s[x], component[x], s[y], component[y], similarity, most)]
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))

    return celled(own, sketches, within)


def closing(own: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that join the components of torn()'s buckets, all pairs of a cell compared by their whole sets.

    Of each node on the left one link to each component that it is linked to, so never all pairs.
    """

    def within(node, component, left, s, cell):
        flat, sizes = np.asarray(s.combine_chunks().flatten()).view(np.uint64), np.asarray(pc.list_value_length(s)).astype(np.int64)
        starts, out = np.cumsum(sizes) - sizes, [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for x, y in by_cell(cell, left):
            if not len(x) or not len(y):
                continue
            texts = flat[np.repeat(starts[y] - np.cumsum(sizes[y]) + sizes[y], sizes[y]) + np.arange(sizes[y].sum())]
            at = np.cumsum(sizes[y]) - sizes[y]
            for i in x:
                one = flat[starts[i] : starts[i] + sizes[i]]
                hit = one[np.minimum(np.searchsorted(one, texts), len(one) - 1)] == texts
                both = np.add.reduceat(hit.astype(np.int64), at)
                linked = np.flatnonzero((both >= similarity * (sizes[i] + sizes[y] - both)) & (component[y] != component[i]))
                to = y[linked[np.unique(component[y[linked]], return_index=True)[1]]]
                out.append((np.full(len(to), node[i]), node[to]))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))

    return celled(own, sets, within)


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``edges (a, b)`` whose texts' shingle sets have at least that Jaccard similarity."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], ["a", "b"])

    return met(edges, sets).mapInArrow(alike, "a long, b long")


def contracted(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels (node, component)`` after further ``edges`` between nodes."""
    for side in ("a", "b"):
        of = labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        edges = edges.join(of, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    top = checkpointed(components(edges.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    up = top.select(F.col("node").alias("component"), F.col("component").alias("up"))
    old = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return checkpointed(old.unionByName(top.join(labels, "node", "left_anti")))


def alike_groups(docs: DataFrame, groups: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """``(node, component)`` of the texts linked by that similarity, of ``docs (doc_id, text)``, text as binary.

    First every node is compared with the smallest one that it shares a band with, and what the trees
    propose. In the buckets that hold several components after that, what is not in the largest one is
    compared with the likeliest nodes of other components, by sketches, and in those that still do with
    all of other components. So each pair that shares a band is compared by the whole sets, or of one
    component.
    """
    sketches = groups.select(F.col("a").alias("node"), F.col("sketch").alias("s"))
    labels = docs.sparkSession.createDataFrame([], "node long, component long")
    buckets = checkpointed(buckets_of(groups))
    stars = buckets.groupBy("node").agg(F.min("first").alias("first")).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    trees = candidates(groups.select(F.col("a").alias("node"), "views"), radius)
    edges = checkpointed(likely(stars.unionByName(trees).distinct(), sketches, similarity))
    labels = linked(docs, groups, labels, edges, width, similarity)
    own = checkpointed(torn(buckets, labels))
    if own.isEmpty():
        return labels
    labels = linked(docs, groups, labels, checkpointed(proposed(own, sketches, similarity, LIKELIEST)), width, similarity)
    own = checkpointed(torn(buckets, labels))
    if own.isEmpty():
        return labels
    return contracted(labels, checkpointed(closing(own, checkpointed(sets_of(docs, groups, own, width)), similarity)))


def linked(docs: DataFrame, groups: DataFrame, labels: DataFrame, edges: DataFrame, width: int, similarity: float) -> DataFrame:
    """``labels`` after the ``edges`` that hold when the whole sets are compared."""
    if edges.isEmpty():
        return labels
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    sets = checkpointed(sets_of(docs, groups, ends, width))
    return contracted(labels, checkpointed(verified(edges, sets, similarity)))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` without all but the smallest id of each group of near-duplicates, rows as they were.

    Texts of the same words, but for case and white space, are one group; groups whose shingle sets of
    ``width`` words have a Jaccard similarity of at least ``similarity`` are linked. Links are sought by
    VIEWS word fingerprints within ``radius`` bits, in vantage-point trees, and by bands of least hashes
    of the shingles, and then compared exactly; see alike_groups.
    Null and empty texts are one group. Of repeated rows one stays; rows with a null id all stay. Empty
    tables give no rows; other columns are carried along, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [normal(x.as_py()) for x in b.column(1)]
            keys = [key_of(t) for t in texts]
            views = pa.array([views_of(t).view(np.int64) for t in texts], pa.list_(pa.int64()))
            sets = [shingles_of(t, width) for t in texts]
            bands = pa.array([bands_of(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            sketches = pa.array([sketch(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), views, bands, sketches], ["doc_id", "a", "b", "views", "bands", "sketch"])

    cols = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).filter(F.col("doc_id").isNotNull())
    rows = checkpointed(cols.mapInArrow(run, "doc_id long, a long, b long, views array<long>, bands array<long>, sketch binary"))
    groups = checkpointed(rows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("views", "bands", "sketch"))))
    here = keyed(docs, text)
    named = alike_groups(cols, groups, width, similarity, radius)
    of = groups.join(named, groups.a == named.node, "left").select("a", "b", "least", F.coalesce("component", "a").alias("component"))
    best = of.groupBy("component").agg(F.min(F.struct("least", "a", "b")).alias("best"))
    # a row goes unless its group, key and id are the ones that stay; of those that stay several times one stays
    ruled = rows.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(of.join(best, "component").select("a", "b", "best"), ["a", "b"])
    stays = F.struct(F.col("doc_id").alias("least"), "a", "b") == F.col("best")
    fate = checkpointed(ruled.select(F.col("doc_id").alias("of"), F.col("a").alias("key_a"), F.col("b").alias("key_b"), stays.alias("stays"), "n").filter("not stays or n > 1"))
    small = fate.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def matched(df: DataFrame, side: DataFrame, how: str) -> DataFrame:
        same = (df["row"][id].cast("long") == side["of"]) & (df["key_a"] == side["key_a"]) & (df["key_b"] == side["key_b"])
        return df.join(F.broadcast(side) if small else side, same, how)

    left = matched(here, fate, "left_anti")
    again = fate.filter("stays").select("of", "key_a", "key_b")
    if not again.isEmpty():
        several = matched(here, again, "left_semi")
        left = left.unionByName(several.withColumn("of", F.col("row")[id]).dropDuplicates(["of", "key_a", "key_b"]).drop("of"))
    return left.select("row.*")


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
