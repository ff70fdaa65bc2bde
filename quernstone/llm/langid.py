"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter holds all languages: each slot is a mask with a bit for each language, and the masks
at an n-gram's slots, and-ed, are the languages that contain it. A text's languages are weighed by
how many of its n-grams each contains (a popcount per bit), corrected for the share that a
language's bits would return by chance.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, stratified

#: Labelled rows to learn from, at most about, but about LEAST_ROWS of each language if it has them; n-grams kept of each language; share of the leading
#: language's frequency from which a language contains an n-gram; slots per n-gram; code points handled at once.
SAMPLE_ROWS, LEAST_ROWS, GRAMS, SHARE, SLOTS, CHUNK = 20_000, 500, 20_000, 0.2, 16, 1 << 20
#: Parts of a language's n-grams that are ranked apart first.
PARTS = 16
UNKNOWN = "und"
HASHES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letter trigrams of texts, word ends as spaces, and which text each is from."""
    points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), "<u4") for t in texts]
    gap = np.array([32], np.uint32)
    sizes = np.array([len(p) + 2 for p in points], np.int64)
    c = letters()[np.concatenate([x for p in points for x in (gap, p, gap)])] if points else gap
    own = np.repeat(np.arange(len(points)), sizes)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    middle = np.flatnonzero(c[1:-1] != 32) + 1
    w = c.astype(np.uint64)
    return w[middle - 1] | (w[middle] << np.uint64(21)) | (w[middle + 1] << np.uint64(42)), own[middle]


def chunked(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) so that not too much is unfolded at once; null texts are empty."""
    at, held, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py() or b""
        if held and size + len(t) > CHUNK:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


@dataclass(frozen=True)
class Model:
    """``masks[slot, word]``: which languages, 64 to a word, have an n-gram there; ``chance``: each language's share of random hits."""

    langs: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray

    def slots(self, g: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(len(self.masks) - 1)
        out = []
        for h in HASHES:
            x = (g ^ (g >> np.uint64(31))) * h
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # all three letters count in the bits taken
            out.append((x >> np.uint64(32)) & size)
        return out

    def containing(self, g: np.ndarray) -> np.ndarray:
        a, b = self.slots(g)
        return self.masks[a] & self.masks[b]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the language's part of all corrected counts."""
        g, own = grams(texts)
        n = np.bincount(own, minlength=len(texts)).astype(float)
        est = np.zeros((len(texts), len(self.langs)))
        if len(g) and self.langs:
            held = self.containing(g)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            for k in range(len(self.langs)):
                bits = (held[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                counts = np.add.reduceat(bits.astype(np.int64), first)
                rows = own[first]
                est[rows, k] = np.maximum(0, (counts / n[rows] - self.chance[k]) / (1 - self.chance[k]))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, total = est.argmax(1), est.sum(1)
        score = np.where(total > 0, est.max(1) / np.maximum(total, 1e-12), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, gram, n)``: occurrences of each n-gram in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).dictionary_encode()
            codes = np.asarray(names.indices)
            for at, texts in chunked(b.column(1)):
                g, own = grams(texts)
                of = codes[at + own]
                for k in np.unique(of):
                    found, n = np.unique(g[of == k], return_counts=True)
                    name = pa.array([names.dictionary[int(k)].as_py()] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays([name, pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    cols = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    parts = cols.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(labelled: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS, most: int = GRAMS) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """The languages, and n-grams and the language that contains each, as its place.

    Of rows with a language and a text, of more than ``sample_rows`` a sample by a hash of the id. Each
    language gives its ``most`` most frequent n-grams to the driver; a language contains
    those whose frequency in it is at least SHARE of that in the language where it is highest.
    Repeated rows count as often as they occur; no rows teach no language.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled, _ = stratified(labelled, lang, id, sample_rows, LEAST_ROWS, "langid")
    found = checkpointed(counts(labelled, lang, text))
    best = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= most).drop("k")
    top = best(best(found.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS))), ["lang", "part"]), ["lang"])
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rows = top.select("lang", "gram", "n").toArrow()
    langs = tuple(sorted(totals))
    code = {x: i for i, x in enumerate(langs)}
    of = np.array([code[x] for x in rows["lang"].to_pylist()], np.int64)
    gram = np.asarray(rows["gram"]).view(np.uint64) if rows.num_rows else np.empty(0, np.uint64)
    rate = np.asarray(rows["n"]) / np.array([totals[x] for x in langs], float)[of] if rows.num_rows else np.empty(0)
    each, back = np.unique(gram, return_inverse=True)
    highest = np.zeros(len(each))
    np.maximum.at(highest, back, rate)
    kept = rate >= SHARE * highest[back]
    return langs, gram[kept], of[kept]


def fit(labelled: DataFrame, id: str = "doc_id", lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS, most: int = GRAMS) -> Model:
    """The filter over what learned() gives."""
    return filled(*learned(labelled, id, lang, text, sample_rows, most))


def filled(langs: tuple[str, ...], gram: np.ndarray, of: np.ndarray) -> Model:
    """The filter over (n-gram, language) pairs."""
    per_lang = np.bincount(of, minlength=max(1, len(langs)))
    size = 1 << max(16, int(per_lang.max() * SLOTS - 1).bit_length())
    masks = np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64)
    empty = Model(langs, masks, np.zeros(len(langs)))
    for slot in empty.slots(gram):
        np.bitwise_or.at(masks, (slot, of // 64), np.uint64(1) << (of % 64).astype(np.uint64))
    fill = [((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))]
    return Model(langs, masks, np.array(fill) ** len(HASHES))


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. Ties go to the
    language first by name. The filter, of a size bounded by GRAMS, goes to every task. Repeated rows each
    come back, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for _, texts in chunked(b.column(1)):
                lang, score = model.predict(texts)
                names += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "lang_pred", "score"])

    cols = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id: str = "doc_id"):
    """Whether a row is left out of learning: crc32 of the id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; learned from rows with an id that are not held out.

    Every row comes back, repeated ones and those with a null id too; an empty table gives no rows.
    """
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
