"""Quality classification by co-training.

Two classifiers see a document apart: one its text, one its metadata. In each round all unlabelled
documents are passed over, and each classifier labels those that it is sure of for the other: tasks
count the features of such documents by class, so that what is learned from them is not sampled. A
view is a regression on labelled rows, over the features that tell the classes apart and over the mean
log-odds of all features in the counts. Both views are calibrated on labelled rows that neither learned
from, the calibrated views are combined there, and every document is scored by the combination.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import fresh, sliced
from quernstone.llm.features import TEXT_IDS, WORDS, meta_ids, text_ids

#: Labelled documents to learn from, at most about, and labelled ids up to which they are broadcast.
LABELLED_ROWS, BROADCAST_ROWS = 15_000, 1_000_000
#: Features kept of a view; rounds; calibrated certainty for a pseudo-label and its weight; one in so many labelled rows calibrates.
FEATURES, ROUNDS, SURE, PSEUDO_WEIGHT, CALIBRATES = 600, 2, 0.98, 0.5, 4
#: Rows of a regression summed at once, feature numbers of a sample looked at once, standard errors from which log-odds count, and what their mean is multiplied by.
ROWS, NUMBERS, TELLS, LEAN = 2048, 1 << 20, 2.0, 10.0
META = ("lang", "source", "n_chars")
#: Numbers of features of a view.
SIZES = {"text": TEXT_IDS, "meta": WORDS}


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the last coefficient is the free one."""
    k = x.shape[1] + 1
    b, penalty = np.zeros(k), np.full(k, ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        square, slope = np.diag(penalty), -penalty * b
        for lo in range(0, len(x), ROWS):
            part = np.hstack([x[lo : lo + ROWS], np.ones((len(x[lo : lo + ROWS]), 1))])
            p, w = sigmoid(part @ b), weight[lo : lo + ROWS]
            square += (part * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ part
            slope += part.T @ (w * (y[lo : lo + ROWS] - p))
        step = np.linalg.solve(square, slope)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return b


@dataclass
class Sets:
    """Rows of feature numbers, one after the other."""

    flat: np.ndarray
    sizes: np.ndarray

    def blocks(self) -> Iterator[Sets]:
        """The rows in order, in parts of at most NUMBERS feature numbers or one row; at least one part."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        lo = 0
        while True:
            hi = min(len(self.sizes), max(lo + 1, int(np.searchsorted(ends, ends[lo] + NUMBERS, side="right")) - 1))
            yield Sets(self.flat[ends[lo] : ends[hi]], self.sizes[lo:hi])
            lo = hi
            if lo >= len(self.sizes):
                return

    @classmethod
    def of(cls, lists: pa.ChunkedArray) -> Sets:
        a = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        return cls(np.asarray(a.flatten()), np.asarray(a.value_lengths()).astype(np.int64))

    def dense(self, features: np.ndarray) -> np.ndarray:
        """A column for each feature, sorted."""
        out = np.zeros((len(self.sizes), len(features)), np.float32)
        lo = 0
        for part in self.blocks() if len(features) else ():
            at = np.minimum(np.searchsorted(features, part.flat), len(features) - 1)
            hit = features[at] == part.flat
            out[lo + np.repeat(np.arange(len(part.sizes)), part.sizes)[hit], at[hit]] = 1
            lo += len(part.sizes)
        return out


@dataclass
class Counts:
    """By class, good ones first: documents, and documents that have each feature."""

    n: np.ndarray
    features: np.ndarray

    @classmethod
    def none(cls, size: int) -> Counts:
        return cls(np.zeros(2), np.zeros((2, size)))

    @classmethod
    def of(cls, sets: Sets, y: np.ndarray, size: int) -> Counts:
        features, lo = np.zeros((2, size)), 0
        for part in sets.blocks():
            own = y[lo : lo + len(part.sizes)]
            for c in (0, 1):
                features[c] += np.bincount(part.flat[np.repeat(own == c, part.sizes)], minlength=size)
            lo += len(own)
        return cls(np.array([(y == c).sum() for c in (0, 1)], float), features)


@dataclass
class View:
    """A linear classifier over some features and the mean log-odds of all, and its calibration."""

    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: Of the features, of the mean log-odds, and the free one.
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    def lean(self, sets: Sets) -> np.ndarray:
        """LEAN times the mean log-odds of each row's features."""
        return np.concatenate([self.lean_of(part) for part in sets.blocks()])

    def lean_of(self, sets: Sets) -> np.ndarray:
        row = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
        odds = self.odds[np.minimum(sets.flat, len(self.odds) - 1)]
        return LEAN * np.bincount(row, odds, minlength=len(sets.sizes)) / np.maximum(1, sets.sizes)

    def margins(self, sets: Sets) -> np.ndarray:
        """The sums of the weights of each row's features, and what they lean to."""
        return np.concatenate([self.margins_of(part) for part in sets.blocks()])

    def margins_of(self, sets: Sets) -> np.ndarray:
        out = self.weights[-2] * self.lean_of(sets) + self.weights[-1]
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, sets.flat), len(self.features) - 1)
            w = np.where(self.features[at] == sets.flat, self.weights[at], 0.0)
            out += np.bincount(np.repeat(np.arange(len(sets.sizes)), sets.sizes), w, minlength=len(sets.sizes))
        return out

    def log_odds(self, sets: Sets) -> np.ndarray:
        return self.scale[0] * self.margins(sets) + self.scale[1]

    def calibrate(self, sets: Sets, y: np.ndarray) -> None:
        if len(y):
            a = regress(self.margins(sets)[:, None], y, np.ones(len(y)), ridge=0.1)
            self.scale = np.array([max(0.0, a[0]), a[1]])


def learn(sets: Sets, y: np.ndarray, more: Counts) -> View:
    """From labelled rows, and from counts of the documents that the other view is sure of.

    Of the features whose odds surely differ between the classes in both together the surest and the most
    telling have a weight of their own.
    """
    own = Counts.of(sets, y, more.features.shape[1])
    (n_good, n_bad), (good, bad) = own.n + PSEUDO_WEIGHT * more.n + 1, own.features + PSEUDO_WEIGHT * more.features
    each = np.flatnonzero(bad + good)
    bad, good = bad[each] + 0.5, good[each] + 0.5
    odds = np.log(bad / n_bad) - np.log(good / n_good)
    z = np.abs(odds) / np.sqrt(1 / bad + 1 / good)
    sure = np.flatnonzero(z > 3)
    surest = sure[np.argsort(-z[sure], kind="stable")[: FEATURES // 2]]
    rest = np.setdiff1d(sure, surest)
    telling = rest[np.argsort(-np.abs(odds[rest]), kind="stable")[: FEATURES // 2]]
    features = each[np.union1d(surest, telling)]
    dense = np.zeros(more.features.shape[1], np.float32)
    dense[each] = np.where(z > TELLS, odds, 0)
    view = View(features, np.zeros(len(features) + 2), dense)
    if len(y):
        view.weights = regress(np.column_stack([sets.dense(features), view.lean(sets)]), y.astype(float), np.ones(len(y)))
    return view


@dataclass
class Model:
    text: View
    meta: View
    #: Weights of the two views' log-odds, and the free term.
    mixed: np.ndarray

    def bad(self, text: Sets, meta: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of being bad: combined, by text, by metadata."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return sigmoid(self.mixed[0] * a + self.mixed[1] * b + self.mixed[2]), sigmoid(a), sigmoid(b)


def co_train(text: Sets, meta: Sets, label: np.ndarray, calibrates: np.ndarray, gather, rounds: int = ROUNDS) -> Model:
    """``label``: 1 bad, 0 good. Views learn from rows that do not calibrate, and from each other.

    ``gather(model)`` gives, for the text and for the metadata, the Counts of the unlabelled documents that
    the other view of ``model`` is sure of.
    """

    def part(sets: Sets, mask: np.ndarray) -> Sets:
        return Sets(sets.flat[np.repeat(mask, sets.sizes)], sets.sizes[mask])

    sets = {"text": text, "meta": meta}
    given = {k: Counts.none(SIZES[k]) for k in sets}
    y = label[calibrates].astype(float)
    for n in range(rounds + 1):
        views = {k: learn(part(s, ~calibrates), label[~calibrates], given[k]) for k, s in sets.items()}
        for k, s in sets.items():
            views[k].calibrate(part(s, calibrates), y)
        model = Model(views["text"], views["meta"], np.array([1.0, 0.0, 0.0]))
        if n < rounds and len(label):
            given = dict(zip(sets, gather(model), strict=True))
    if len(y):
        both = np.stack([views[k].log_odds(part(s, calibrates)) for k, s in sets.items()], 1)
        mixed = regress(both, y, np.ones(len(y)), ridge=0.1)
        model.mixed = np.array([max(0.0, mixed[0]), max(0.0, mixed[1]), mixed[2]])
    return model


def sets_of(b: pa.RecordBatch, text: str, meta: list[str]) -> tuple[Sets, Sets]:
    """The features of a batch's texts, as binary, and of its metadata."""
    columns = {c: b.column(c).to_pylist() for c in meta}
    t = [text_ids(x.as_py()) for x in b.column(text)]
    m = [meta_ids({c: columns[c][i] for c in meta}) for i in range(b.num_rows)]
    return tuple(Sets(np.concatenate(x) if x else np.empty(0, np.int64), np.array([len(y) for y in x], np.int64)) for x in (t, m))


def listed(sets: Sets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sets.sizes)]), pa.int32()), pa.array(sets.flat.astype(np.int32)))


def gathered(docs: DataFrame, model: Model, meta: list[str]) -> tuple[Counts, Counts]:
    """For the text and for the metadata the Counts of ``docs (text, ...)`` that the other view is sure of.

    Every document is passed over; a task returns a row for each feature that it counted.
    """
    sizes = list(SIZES.values())
    width = max(sizes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, size + 1), np.int64) for size in sizes]
        for b in sliced(batches):
            sets = sets_of(b, "text", meta)
            _, *sides = model.bad(*sets)
            for counts, own, other in zip(held, sets, sides[::-1], strict=True):
                for c, sure in enumerate((other <= 1 - SURE, other >= SURE)):
                    counts[c, :-1] += np.bincount(own.flat[np.repeat(sure, own.sizes)], minlength=counts.shape[1] - 1)
                    counts[c, -1] += sure.sum()
        for k, counts in enumerate(held):
            c, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array((2 * k + c) * width + at), pa.array(counts[c, at])], ["k", "n"])

    got = docs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = np.asarray(got["k"]), np.asarray(got["n"])
    out = []
    for view, size in enumerate(sizes):
        held = np.zeros((2, size + 1))
        own = k // (2 * width) == view
        held[k[own] // width % 2, k[own] % width] = n[own]
        out.append(Counts(held[:, -1], held[:, :-1]))
    return tuple(out)


def labelled(labels: DataFrame) -> DataFrame:
    """``(id, bad)``: 1 where any row of a document says quality 0 or toxic 1; without either value there is no label."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("id"), bad.alias("bad")).dropna().groupBy("id").agg(F.max("bad").alias("bad"))


def drawn_for_calibration(id: str) -> Column:
    return F.pmod(F.xxhash64(id, F.lit("calibrates")), F.lit(CALIBRATES)) == 0


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> Model:
    """Co-trains on the labelled documents, of more than ``labelled_rows`` a sample by a hash of the id, and on all others.

    Repeated rows count as often as they occur. Rows with a null id are unlabelled.
    """
    known = labelled(labels)
    n = known.count()
    meta = [c for c in META if c in docs.columns]
    own = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"), *meta)
    small = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, labelled_rows / max(1, n))) + 1
    sample = own.filter(drawn).join(small(known.filter(drawn)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("bad"), *map(listed, sets_of(b, "text", meta))], ["id", "bad", "text_ids", "meta_ids"])

    lists = T.ArrayType(T.IntegerType())
    got = sample.mapInArrow(run, T.StructType([sample.schema["id"], sample.schema["bad"]]).add("text_ids", lists).add("meta_ids", lists))
    got = got.withColumn("calibrates", drawn_for_calibration("id")).toArrow()
    got = got.sort_by("id")  # sums of doubles come out the same each time
    sets = [Sets.of(got[c]) for c in ("text_ids", "meta_ids")]
    label, calibrates = np.asarray(got["bad"]).astype(np.int64), np.asarray(got["calibrates"]).astype(bool)
    del got
    others = own.join(small(known.select("id")), "id", "left_anti")
    return co_train(*sets, label, calibrates, lambda model: gathered(others, model, meta), rounds)


#: The columns that documents get.
ADDED = ("quality", "text_quality", "meta_quality")


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with probabilities of being good, from the whole text: of both views, of the text, of the metadata.

    Columns of these names are replaced. Null values are values of their own, a null text an empty one.
    """
    docs = docs.drop(*names)
    meta = [c for c in META if c in docs.columns]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            row = b.column(0)
            seen = pa.RecordBatch.from_arrays([row.field(text).cast(pa.binary()), *(row.field(c) for c in meta)], ["text", *meta])
            yield pa.RecordBatch.from_arrays([row, *(pa.array(1 - p) for p in model.bad(*sets_of(seen, "text", meta)))], ["row", "both", "of_text", "of_meta"])

    schema = T.StructType([rows.schema["row"]]).add("both", "double").add("of_text", "double").add("of_meta", "double")
    got = rows.mapInArrow(run, schema)
    return got.select("row.*", *(F.col(c).alias(name) for c, name in zip(("both", "of_text", "of_meta"), names, strict=True)))


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5, names: tuple[str, str, str] = ADDED, keep: str = "keep") -> DataFrame:
    """score()'s rows with ``keep``: whether the document is good with a probability of ``least`` or more.

    With no labelled row every document scores alike and is kept. Repeated rows each come back, scored
    alike; an empty table gives no rows. Columns of the four names are replaced.
    """
    model = fit(docs, labels)
    scored = score(docs.drop(keep), model, names=names)
    if not model.text.odds.any() and not model.meta.odds.any():
        return scored.withColumn(keep, F.lit(True))
    return scored.withColumn(keep, F.col(names[0]) >= least)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they were."""
    *names, keep = fresh(docs.columns, "both", "of_text", "of_meta", "keep")
    return judged(docs, labels, names=tuple(names), keep=keep).filter(keep).drop(*names, keep)


def columns(scored: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("doc_id", "quality", "text_quality", "meta_quality", "keep")]
