"""Language identification by string kernels.

A text's features are the distinct character n-grams of orders 1 to 3 (a blended spectrum of presence).
The kernel of two texts is the number of n-grams they share, over the geometric mean of their own
numbers. Landmarks are training texts; by the Nystroem method the kernel against them gives features,
on which one ridge regression per language is fitted against the rest. As the kernel is linear in the
presence of n-grams, landmarks and weights fold into one matrix, and scoring is a product of the batch's
presence matrix with it.

Text is lower-cased, every run of characters that aren't letters is one space, and code points are
folded modulo 1022, so that an n-gram fits 30 bits.

Defined results: a null text or one without letters is ``und`` with score 0, as is everything when
nothing could be learned; ties go to the language that sorts first; a null doc_id is held out; rows
that repeat give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import place, staged

UNKNOWN = "und"
FOLD = 1022


def _symbols() -> np.ndarray:
    """Code point -> 1 (no letter) or a symbol from 2."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, points % FOLD + 2, 1).astype(np.int32)


_TABLE: list[np.ndarray] = []


def grams(text: str | None) -> np.ndarray:
    """The sorted distinct n-grams of a text; none if it has no letter."""
    if not _TABLE:
        _TABLE.append(_symbols())
    s = _TABLE[0][np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(s) or s.max() == 1:
        return np.zeros(0, np.int32)
    space = s == 1
    keep = np.ones(len(s), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    s = s[keep]
    two = (s[:-1] << 10) | s[1:]
    every = np.concatenate([s, two, (two[:-1] << 10) | s[2:]])
    every.sort()
    first = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=first[1:])
    return every[first]


@dataclass
class KernelModel:
    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of scores for each gram set: products of presence matrices and the folded weights.

        A product is over the n-grams of a few texts, not over all that the model knows, so that its size doesn't grow with the languages.
        """
        sizes = np.array([len(s) for s in sets])
        out = np.zeros((len(sets), len(self.languages)), np.float32)
        at = 0
        while at < len(sets):
            to = at + 1
            while to < len(sets) and (to + 1 - at) * sizes[at : to + 1].sum() <= CELLS:
                to += 1
            rows, found = positions(sets[at:to], self.vocabulary)
            if len(found):
                columns, place_ = np.unique(found, return_inverse=True)
                presence = np.zeros((to - at, len(columns)), np.float32)
                presence[rows, place_] = 1
                out[at:to] = presence @ self.weights[columns]
            at = to
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]


#: Cells of a presence matrix.
CELLS = 1 << 23


def positions(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, place in the vocabulary) of each n-gram of the sets that the vocabulary has."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(vocabulary, every), max(0, len(vocabulary) - 1))
    found = vocabulary[at] == every if len(vocabulary) else np.zeros(len(every), bool)
    return rows[found], at[found]


class Landmarks:
    """Which landmarks hold each n-gram of their vocabulary, in place of a matrix with a cell for each of both."""

    def __init__(self, marks: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(marks))
        self.sizes = np.array([len(g) for g in marks])
        rows, at = positions(marks, self.vocabulary)
        order = np.argsort(at, kind="stable")
        self.who, self.starts = rows[order], np.searchsorted(at[order], np.arange(len(self.vocabulary) + 1))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set: its n-grams shared with each landmark over the geometric mean of their numbers."""
        out = np.zeros((len(sets), len(self.sizes)))
        for i, g in enumerate(sets):
            _, at = positions([g], self.vocabulary)
            many = self.starts[at + 1] - self.starts[at]
            before = np.cumsum(many) - many
            held = np.repeat(self.starts[at] - before, many) + np.arange(many.sum())
            out[i] = np.bincount(self.who[held], minlength=len(self.sizes)) / np.sqrt(len(g))
        return out / np.sqrt(self.sizes)

    def folded(self, dual: np.ndarray, together: int = 1 << 17) -> np.ndarray:
        """The weights of the n-grams from those of the landmarks, about ``together`` pairs of both at a time."""
        scaled = dual / np.sqrt(self.sizes)[:, None]
        out = np.empty((len(self.vocabulary), dual.shape[1]), np.float32)
        a = 0
        while a < len(self.vocabulary):
            z = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + together, "right")) - 1)
            out[a:z] = np.add.reduceat(scaled[self.who[self.starts[a] : self.starts[z]]], self.starts[a:z] - self.starts[a], axis=0)
            a = z
        return out


def fit(examples: list[tuple[str, np.ndarray]], landmarks_per_language: int, ridge: float) -> KernelModel:
    """Nystroem features and one-versus-rest kernel ridge regression over (language, gram set) pairs."""
    examples = [x for x in examples if len(x[1])]
    languages = sorted({lang for lang, _ in examples})
    if not languages:
        return KernelModel([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    taken: dict[str, int] = {}
    marks = []
    for lang, g in examples:
        if taken.get(lang, 0) < landmarks_per_language:
            taken[lang] = taken.get(lang, 0) + 1
            marks.append(g)
    known = Landmarks(marks)
    values, vectors = np.linalg.eigh(known.kernel(marks))
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    square, cross = ridge * np.eye(whiten.shape[1]), np.zeros((whiten.shape[1], len(languages)))
    for i in range(0, len(examples), 512):
        part = examples[i : i + 512]
        phi = known.kernel([g for _, g in part]) @ whiten
        square += phi.T @ phi
        cross += phi.T @ np.array([[float(lang == one) for one in languages] for lang, _ in part])
    return KernelModel(languages, known.vocabulary, known.folded(whiten @ np.linalg.solve(square, cross)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def training_sample(docs: DataFrame, per_language: int, most_languages: int = 64) -> list[tuple[str, np.ndarray]]:
    """Gram sets of at most ``per_language`` texts of each language, picked by a hash of their ids.

    The ``most_languages`` with most ids (about; ties by name) are learned, so that a column with very many values can't outgrow the driver.
    """
    known = docs.filter("text is not null and lang is not null").select(F.col("doc_id").cast("long"), F.col("lang").cast("string")).filter(~held_out(F.col("doc_id")))
    counted = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    ids = {r["lang"]: r["n"] for r in counted.orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    if not ids:
        return []
    # enough of each language by far, so that what is ranked doesn't grow with the table
    share = F.create_map(*(F.lit(x) for lang, n in ids.items() for x in (lang, 8.0 * per_language / max(1, n))))[F.col("lang")]
    order = Window.partitionBy("lang").orderBy(place("doc_id"), "doc_id")
    ranked = known.filter(F.col("lang").isin(list(ids))).filter(place("doc_id") < share).distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_language)
    picked = staged(ranked, "picked").select("doc_id", "lang", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["lang", "at", "grams"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).filter("text is not null")
    one = texts.join(picked, ["doc_id", "lang"]).groupBy("lang", "at").agg(F.min("text").alias("text"))  # of rows that share an id
    rows = one.mapInArrow(run, "lang string, at int, grams binary").collect()  # per_language rows of each language
    return [(r["lang"], np.frombuffer(r["grams"], np.int32)) for r in sorted(rows, key=lambda r: (r["at"], r["lang"], r["grams"]))]


def predict(model: KernelModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    sets = [grams(t) for t in texts]
    pred, score = [UNKNOWN] * len(sets), np.zeros(len(sets))
    if model.languages and sets:
        s = model.scores(sets)
        best = s.argmax(1)
        for k, g in enumerate(sets):
            if len(g):
                pred[k], score[k] = model.languages[best[k]], min(1.0, max(0.0, float(s[k, best[k]])))
    return pred, score


def learn(docs: DataFrame, per_language: int = 200, landmarks_per_language: int = 24, ridge: float = 0.1, most_languages: int = 64) -> KernelModel:
    """Learns only from rows with a language whose id isn't held out: at most ``per_language`` texts of each, ``landmarks_per_language`` of them as landmarks.

    Texts of languages beyond the ``most_languages`` most frequent ones are given one of those; ``unlearned`` counts them.
    """
    return fit(training_sample(docs, per_language, most_languages), landmarks_per_language, ridge)


def unlearned(docs: DataFrame, most_languages: int = 64) -> DataFrame:
    """(languages, documents) that ``learn`` leaves out, for a report."""
    rows = docs.filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"), F.count("*").alias("rows"))
    learned = counted.orderBy(F.col("n").desc(), "lang").limit(most_languages).select("lang")
    return counted.join(learned, "lang", "left_anti").agg(F.count("*").alias("languages"), F.coalesce(F.sum("rows"), F.lit(0)).alias("documents"))


def identify(docs: DataFrame, per_language: int = 200, landmarks_per_language: int = 24, ridge: float = 0.1, block: int = 128) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang); ``block`` texts are scored at a time."""
    model = learn(docs, per_language, landmarks_per_language, ridge)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                pred, score = predict(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, per_language: int = 200, landmarks_per_language: int = 24, ridge: float = 0.1, block: int = 128, least_score: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages that were learned, with all their columns.

    Those without letters go, and those whose predicted language has a score below ``least_score``, as
    they share next to nothing with any (of single words of the learned languages the lowest seen is
    0.15, of texts in other scripts the highest 0.04). Where no language could be learned, all with letters
    stay.
    """
    model = learn(docs, per_language, landmarks_per_language, ridge)
    at = docs.columns.index("text")

    def stay(texts: list[str | None]) -> list[bool]:
        if not model.languages:
            return [len(grams(t)) > 0 for t in texts]
        return [p != UNKNOWN and s >= least_score for p, s in zip(*predict(model, texts), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                yield part.filter(pa.array(stay(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
