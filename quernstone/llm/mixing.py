"""Mixing to target weights with soft memberships.

A classifier learned from a labelled table gives every document a posterior over domains. Rates,
how often a document is taken, are then fitted so that the expected tokens of each domain meet
its target: least squares over all documents by accelerated projected gradients, with a small
pull of every rate to 1. Errors are taken relative to the domain's share of the tokens, so that a
rare domain is fitted as fast and pulled as little as a frequent one. What a document adds to a gradient depends only on its posterior and on
the errors of the domains so far, so an iteration is one aggregate of a few numbers, and tasks
replay the errors so far instead of keeping state.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import checkpointed, sliced, stratified
from quernstone.llm.features import word_ids

#: Labelled rows to learn from, at most about, but about LEAST_ROWS of each domain if it has them, and to scale posteriors with; buckets of words; pull to 1; iterations at most; norm of the projected gradient that ends them.
SAMPLE_ROWS, LEAST_ROWS, SCALE_ROWS, BUCKETS, PULL, ITERATIONS, ENOUGH = 20_000, 500, 4_000, 1 << 16, 1e-3, 80, 2e-5

#: The columns that documents get.
ADDED = ("tokens", "domain", "membership", "rate")


@dataclass
class Classifier:
    """Naive Bayes over distinct words: mean log-likelihoods, scaled to give fair posteriors."""

    domains: tuple[str, ...]
    #: Log-frequency of each bucket in each domain, and log-shares of the domains.
    words: np.ndarray
    prior: np.ndarray
    scale: float = 1.0

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.domains)))
        for i, t in enumerate(texts):
            ids = word_ids(t, BUCKETS)
            if len(ids):
                out[i] = self.words[ids].mean(0)
        return out

    def posteriors(self, likelihoods: np.ndarray) -> np.ndarray:
        z = self.prior + self.scale * likelihoods
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def tokens(text: bytes) -> int:
    return len(text.split())


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """From ``(id, text, domain)``; of more rows than ``sample_rows`` a sample by a hash of the id.

    Rows without a domain or a text teach nothing. A fifth of the sample scales the posteriors. Domains count
    by their share of the whole labelled table.
    """
    rows = labelled.filter(F.col("domain").isNotNull() & F.col("text").isNotNull()).withColumn("domain", F.col("domain").cast("string"))
    rows, held = stratified(rows, "domain", "id", sample_rows, LEAST_ROWS, "mixing")
    rows = checkpointed(rows.select("domain", F.col("text").cast("binary").alias("text"), (F.pmod(F.xxhash64("id", F.lit("scale")), F.lit(5)) == 0).alias("scales"), "id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d not in seen:
                    seen[d] = np.zeros(BUCKETS, np.int64)
                seen[d][word_ids(t.as_py(), BUCKETS)] += 1
        for d, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(d, pa.string()), len(at)), pa.array(at), pa.array(n[at])], ["domain", "at", "n"])

    learned = rows.filter(~F.col("scales")).select("domain", "text")
    counts = learned.mapInArrow(counted, "domain string, at long, n long").groupBy("domain", "at").agg(F.sum("n").alias("n")).toArrow()
    domains = tuple(sorted(set(counts["domain"].to_pylist())))
    code = {d: i for i, d in enumerate(domains)}
    table = np.zeros((BUCKETS, len(domains)))
    if domains:
        table[np.asarray(counts["at"]), np.array([code[d] for d in counts["domain"].to_pylist()])] = np.asarray(counts["n"])
    words = table[:BUCKETS] + 0.1
    known = np.array([held[d] for d in domains], float)
    model = Classifier(domains, np.log((words := table[:BUCKETS] + 0.1) / words.sum(0)) if domains else table[:BUCKETS], np.log(known / max(1.0, known.sum())))
    if len(domains) > 1:
        scales = rows.filter("scales").filter(F.pmod(F.xxhash64("id", F.lit("few")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SCALE_ROWS * 5 / sample_rows)) + 1)
        got = scales.select("domain", "text").mapInArrow(liker(model), "domain string, z array<double>").toArrow()
        of = [i for i, d in enumerate(got["domain"].to_pylist()) if d in code]
        if of:
            z = np.array(got["z"].to_pylist())[of]
            y = np.array([code[got["domain"][i].as_py()] for i in of])
            weight = known[y] / np.bincount(y, minlength=len(domains))[y]  # as frequent as in the table
            loss = lambda s: np.average(-np.log(Classifier(domains, model.words, model.prior, s).posteriors(z)[np.arange(len(y)), y] + 1e-12), weights=weight)
            model.scale = min((2.0**k for k in range(-2, 9)), key=loss)
    return model


def liker(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            z = model.likelihoods([t.as_py() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(z), pa.list_(pa.float64()))], ["domain", "z"])

    return run


def replayed(p: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, the point that the next gradient is taken at, the last projected gradient) after the steps of ``errors``, from rates of 1."""
    rate = at = np.ones(len(p))
    step, slope = 1 / (1 + PULL), np.zeros(len(p))
    for n, e in enumerate(errors):
        new = np.maximum(0.0, at - step * (p @ e + PULL * (at - 1)))
        slope = (at - new) / step
        at = new + n / (n + 3) * (new - rate)
        rate = new
    return rate, at, slope


def fit(own: DataFrame, target: np.ndarray, iterations: int = ITERATIONS, domains: tuple[str, ...] = ()) -> np.ndarray:
    """The errors of each step, over ``(__t, __p)``: a document's tokens and posterior; relative to the domains' shares.

    Ends once the projected gradient, a root mean square over tokens, is under ENOUGH. What the last
    step found is logged for each domain, as a warning if that was not reached.
    """
    budget = own.agg(F.sum("__t")).first()[0] or 0
    errors, norm = np.zeros((0, len(target))), np.inf
    share = np.ones(len(target))
    while budget and len(target) and len(errors) < iterations and norm >= ENOUGH:

        def totals(batches: Iterator[pa.RecordBatch], errors=errors) -> Iterator[pa.RecordBatch]:
            """Tokens of each domain, and the square of the last step's projected gradient."""
            for b in batches:
                t = np.asarray(b.column(0)).astype(float)
                p = np.asarray(b.column(1).flatten()).reshape(len(t), -1)
                if len(t):
                    _, at, slope = replayed(p, errors)
                    each = np.append((t * at) @ p, t @ slope**2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(each))), pa.array(each)], ["k", "tokens"])

        got = own.select("__t", "__p").mapInArrow(totals, "k long, tokens double").groupBy("k").agg(F.sum("tokens").alias("tokens")).collect()
        sums = np.zeros(len(target) + 1)
        for r in got:
            sums[r.k] = r.tokens / budget
        if not len(errors):  # rates are 1 here
            share = np.where(sums[:-1] > 0, sums[:-1], 1.0)
        else:
            norm = float(np.sqrt(sums[-1]))
        error = (sums[:-1] - target) / share
        errors = np.vstack([errors, error])
    if len(errors):
        left = {k: round(float(e), 6) for k, e in zip(domains or range(len(target)), errors[-1] * share)}
        level = logging.INFO if norm < ENOUGH else logging.WARNING
        logging.getLogger(__name__).log(level, "mixing: %d steps, projected gradient %.2g (ends under %.2g), shares less targets %s", len(errors), norm, ENOUGH, left)
    return errors


def described(texts: list[bytes], model: Classifier) -> tuple[pa.Array, np.ndarray]:
    """The texts' tokens and posteriors."""
    p = model.posteriors(model.likelihoods(texts)) if model.domains else np.empty((len(texts), 0))
    return pa.array([tokens(t) for t in texts], pa.int64()), p


def rates(p: np.ndarray, model: Classifier, errors: np.ndarray) -> list[pa.Array]:
    """The likeliest domain, its posterior and the rate for each row of posteriors."""
    if model.domains and len(p):
        return [pa.array([model.domains[k] for k in p.argmax(1)]), pa.array(p.max(1)), pa.array(replayed(p, errors)[0])]
    return [pa.nulls(len(p), pa.string()), pa.nulls(len(p), pa.float64()), pa.array(np.ones(len(p)))]


def members(docs: DataFrame, model: Classifier, text: str, kept: list[str]) -> DataFrame:
    """``(row, __t, __p)``: the ``kept`` columns of ``docs``, the tokens and the posterior of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            t, p = described([t.as_py() or b"" for t in b.column("text")], model)
            yield pa.RecordBatch.from_arrays([b.column("row"), t, pa.array(list(p), pa.list_(pa.float64()))], ["row", "__t", "__p"])

    rows = docs.select(F.struct(*([docs[f"`{c}`"] for c in kept] or [F.lit(0).alias("none")])).alias("row"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("__t", T.LongType()).add("__p", T.ArrayType(T.DoubleType())))


def with_added(rows: DataFrame, run) -> DataFrame:
    """The columns of ``rows (row, ...)``'s row and the four that ``run`` adds to it."""
    schema = T.StructType([rows.schema["row"]]).add("tokens", "long").add("domain", "string").add("membership", "double").add("rate", "double")
    return rows.mapInArrow(run, schema).select("row.*", *ADDED)


def rated(own: DataFrame, model: Classifier, errors: np.ndarray) -> DataFrame:
    """members()'s rows with ``tokens``, ``domain``, ``membership`` and ``rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            p = np.asarray(b.column("__p").flatten()).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("__t"), *rates(p, model, errors)], ["row", *ADDED])

    return with_added(own, run)


def read_and_rated(docs: DataFrame, model: Classifier, errors: np.ndarray, text: str) -> DataFrame:
    """``docs`` with the columns that rated() gives, in one pass: a task has one Python worker, which gets each text once."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            row = b.column(0)
            t, p = described([t.as_py() or b"" for t in row.field(text).cast(pa.binary())], model)
            yield pa.RecordBatch.from_arrays([row, t, *rates(p, model, errors)], ["row", *ADDED])

    return with_added(rows, run)


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text: str = "text", keep: list[str] | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """``docs`` with ``tokens``, ``domain`` (the likeliest), ``membership`` (its posterior) and ``rate``.

    ``labelled (id, text, domain)`` teaches the domains; ``weights`` are the shares of all tokens aimed at,
    scaled to sum to 1 over the domains learned; one without a weight aims at 0. The tokens taken
    in all stay those of the table. Null and empty texts have no tokens, the prior as posterior and a rate
    like others. With no labelled row, or no weight on a learned domain, rates are 1; the domain is
    null if none was learned. Every row comes back, repeated ones too, an empty table gives none; columns of
    the four names are replaced, others come back as they were.

    ``keep`` names short columns to return instead of all: those go with the posteriors to the
    checkpoint folder, and texts are read once; otherwise they are read again at the end.
    """
    docs = docs.drop(*ADDED)
    model = learn(labelled)
    target = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    own = checkpointed(members(docs, model, text, keep or []))
    errors = fit(own, target / target.sum(), iterations, model.domains) if target.sum() > 0 else np.zeros((0, len(target)))
    return rated(own, model, errors) if keep else read_and_rated(docs, model, errors, text)


def vetted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, text, domain)``: the documents that the labels call good and not toxic, by language.

    A null among both values or a null id is no such label; repeated rows count as often as they occur.
    """
    good = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col("doc_id").alias("id")).distinct()
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain")).join(good, "id", "left_semi").select("id", "text", "domain")
