"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of letters (one to three, word ends included)
with weights ``log(1 + count) * idf``, scaled to length one. The inverse document
frequencies count every training document. The weights are trained by
follow-the-regularised-leader steps with L1 and L2 penalties on a bounded sample of the
labelled training documents, drawn by a hash order with equal shares for the
languages; a part of the sample that the weights never saw sets the temperature that
calibrates the probabilities. Predictions read whole texts.

A text that is null or has no letter gets ``und`` with score 0; so does every text when
nothing can be learned from. Training rows with a null text, a text without letters or a
null language are left out; a null id counts as not held out. Repeated rows are
learned from as often as they occur. Ties go to the language that sorts first. Only
id, text and language are read; the language only of training rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED, hash_share

UNKNOWN = "und"
BITS = 14
BUCKETS = 1 << BITS
#: Labelled documents the weights may be fitted on, over all languages.
SAMPLE_DOCS = 4096
#: One in so many of them sets the temperature instead.
CALIBRATION_PART = 5


@dataclass(frozen=True)
class Steps:
    """Settings of the training: learning rates, penalties and passes over the sample."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    passes: int = 3


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of a text, and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0)
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    factor, mix = np.uint32(1_000_003), np.uint32(0x9E3779B1)
    pairs = codes[:-1] * factor + codes[1:]
    triples = pairs[:-1] * factor + codes[2:]
    counts = np.zeros(BUCKETS, np.int64)
    for n, grams in enumerate((codes[codes != 32], pairs, triples), 1):
        counts += np.bincount(((grams + np.uint32(n)) * mix) >> np.uint32(32 - BITS), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


@dataclass
class Model:
    """Languages in order, idf per bucket, weights per language and bucket (the last is the constant), temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = np.log1p(counts) * self.idf[at]
        return values / max(np.sqrt((values * values).sum()), 1e-12)

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ values + self.weights[:, BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = ngram_buckets(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, self.features(at, counts)) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(langs: list[str], idf: np.ndarray, rows: list[tuple[str, np.ndarray, np.ndarray]], steps: Steps = Steps()) -> Model:
    """Train on ``(language, buckets, counts)`` rows in their order; every fifth row calibrates."""
    model = Model(langs, idf, np.zeros((len(langs), BUCKETS + 1)))
    number = {lang: i for i, lang in enumerate(langs)}
    sample = [(number[lang], np.append(at, BUCKETS), np.append(model.features(at, counts), 1.0)) for lang, at, counts in rows]
    held = sample[CALIBRATION_PART - 1::CALIBRATION_PART]
    learn = [row for i, row in enumerate(sample) if i % CALIBRATION_PART != CALIBRATION_PART - 1]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for _ in range(steps.passes):
        for y, at, x in learn:
            p = softmax(model.weights[:, at] @ x)
            p[y] -= 1.0
            gradient = p[:, None] * x
            squares = n[:, at] + gradient * gradient
            z[:, at] += gradient - (np.sqrt(squares) - np.sqrt(n[:, at])) / steps.alpha * model.weights[:, at]
            n[:, at] = squares
            pull = z[:, at]
            model.weights[:, at] = np.where(
                np.abs(pull) <= steps.l1, 0.0,
                -(pull - np.sign(pull) * steps.l1) / ((steps.beta + np.sqrt(squares)) / steps.alpha + steps.l2),
            )
    if held:
        logits = [(y, model.weights[:, at] @ x) for y, at, x in held]

        def loss(t: float) -> float:
            return -sum(np.log(max(softmax(v / t)[y], 1e-12)) for y, v in logits)

        model.temperature = float(min(np.geomspace(0.05, 5.0, 41), key=loss))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of the training: crc32 of its id modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS,
    steps: Steps = Steps(),
) -> Model:
    """Fit a model on the rows of ``docs`` that are not held out.

    Two passes: one counts the documents of every bucket over all training rows (at most
    ``BUCKETS`` counts reach the driver), one draws the sample.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(~held_out("id") & F.col("text").isNotNull() & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                at, _ = ngram_buckets(text.as_py())
                seen[at] += 1
                if len(at):
                    lang = lang.as_py()
                    langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(at) + list(langs), pa.string()), pa.array([*at, *[-1] * len(langs)], pa.int32()),
             pa.array([*seen[at], *langs.values()], pa.int64())],
            names=["lang", "bucket", "n"],
        )

    counted = rows.select("text", "lang").mapInArrow(frequencies, "lang string, bucket int, n bigint")
    totals = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    of_lang = {r.lang: r.n for r in totals if r.bucket < 0}
    langs = sorted(of_lang)
    frequency = np.zeros(BUCKETS)
    for r in totals:
        if r.bucket >= 0:
            frequency[r.bucket] = r.n
    idf = np.log((1.0 + sum(of_lang.values())) / (1.0 + frequency)) + 1.0
    if not langs:
        return Model([], idf, np.zeros((0, BUCKETS + 1)))

    share = max(8, sample_docs // len(langs))
    keys = F.col("id").cast("string"), F.col("text")
    wanted = F.lit(False)
    for lang, n in of_lang.items():
        wanted = wanted | ((F.col("lang") == lang) & hash_share(share / n, *keys))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_buckets(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([at.astype(np.int16).tobytes() for at, _ in found], pa.binary()),
                 pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())],
                names=["ord", "lang", "at", "counts"],
            )

    drawn = rows.filter(wanted).select(F.xxhash64(F.lit(SEED), *keys).alias("ord"), "lang", "text")
    sample = drawn.mapInArrow(vectors, "ord bigint, lang string, at binary, counts binary").collect()
    sample.sort(key=lambda r: (r.ord, r.lang))
    unpacked = [(r.lang, np.frombuffer(r["at"], np.int16).astype(np.int64), np.frombuffer(r["counts"], np.float32).astype(float)) for r in sample]
    return fit(langs, idf, [r for r in unpacked if len(r[1])], steps)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    rows = docs.select(id_col, held_out(id_col).alias("_held"), text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    """Train on the rows that are not held out and predict every row."""
    model = train(docs, **columns)
    return predict(docs, model, **{k: v for k, v in columns.items() if k != "lang_col"})
