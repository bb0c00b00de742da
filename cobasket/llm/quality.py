"""Document quality from overlapping weak labellers.

Two questions are asked of a document: is it junk, and is it toxic. Heuristic labellers
look at the whole text and vote yes, vote no or abstain on one of them; human
annotations, where a table of them is given, vote as one more labeller on each, and teach
another which words tell toxic texts: by log-odds of document counts over all annotated
documents. A list of words that finds nothing abstains: insults that
are not there do not make a text friendly, and frequent words of languages the list does not
know do not make it junk. So the share of toxic
documents cannot be read from the votes; it is that of the annotations, or else a fixed one. How
often each labeller votes for what, given the truth, is estimated by expectation
maximisation over the counts of the vote patterns of all documents; the number of
patterns is bounded by the labellers, not by the corpus. The posterior classes (clean,
junk, toxic) then train a linear scorer over hashed words and votes, on a bounded sample of
documents drawn by hash order. A document is kept when the scorer's probability of
clean reaches ``min_clean``.

A null or empty text has no votes and no words, so the scorer judges it by its constant
and keeps it when most documents are clean. Annotations that are null, contradict each
other or belong to no document do not vote. Repeated rows vote and are returned as
often as they occur. Without documents the result is empty. Other columns than id and
text are handed on untouched by ``keep_clean`` and not read elsewhere.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED, hash_share
from cobasket.staging import stage_counting

CLASSES = ("clean", "junk", "toxic")
CLEAN = 0
NO, YES, NONE = 0, 1, 2
#: Documents the scorer may be fitted on.
SAMPLE_DOCS = 8192
#: Annotated documents that teach toxic words.
LABELLED_DOCS = 16_384
#: A word of the scorer occurs in so many sampled documents at least.
MIN_DOCS = 3
#: Words in which repetition is looked for, through the whole text.
WINDOW = 200
#: A learned word's log-odds are so many times their standard error at least; so many words may be held.
LEARNED_Z = 4.0
LEARNED_WORDS = 1 << 14
#: Annotated documents for which the prior of a word's log-odds stands.
LEARNED_PRIOR = 5.0
#: The sum of log-odds from which the learned labeller votes, either way.
LEARNED_SUM = 4.0
WORD_BITS = 24

# Endings under which an insult is known, too; one in -ing also without it.
ENDINGS = ("s", "es", "ed", "y", "ly", "ing", "ish", "ic", "ity", "ness", "ically", "ally", "bag", "bags")
# Frequent words of four languages; texts in others hold few of them, which says nothing.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "on", "be", "at", "by", "this", "are", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "pour", "dans", "sur", "au",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "nicht", "auf", "im", "dem",
    "el", "los", "las", "del", "y", "se", "con", "por", "su", "para", "al", "lo", "una", "es", "no",
)
WORD = re.compile(r"[^\W\d_]+")
#: The share of yes before anything is known.
YES_SHARE = 0.15
MARKED = re.compile(r"\w[^\w\s]{2,}(?!\S)")

# Byte classes: 0 other, 1 upper, 2 lower or non-ASCII, 3 digit, 4 white space, 5 symbol, 6 bang.
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (1, range(65, 91)), (2, [*range(97, 123), *range(128, 256)]), (3, range(48, 58)), (4, (9, 10, 11, 12, 13, 32)),
    (5, b"#$%&*|<>{}[]=~^\\@_"), (6, b"!?"),
):
    _KINDS[list(_bytes)] = _kind


def _band(value: float, clean: float, junk: float) -> int:
    """No on the near side of ``clean``, yes beyond ``junk``, no vote between."""
    if clean < junk:
        return NO if value <= clean else YES if value >= junk else NONE
    return NO if value >= clean else YES if value <= junk else NONE


def _least_share(words: list[str]) -> float:
    """The least share of distinct words in windows through the whole text; the last window ends with it."""
    starts = {*range(0, len(words) - WINDOW + 1, WINDOW), max(0, len(words) - WINDOW)}
    return min(len(set(part)) / len(part) for part in (words[k:k + WINDOW] for k in starts))


def inflected(words: Iterable[str]) -> frozenset[str]:
    """``words`` under all endings."""
    stems = {s for w in words for s in (w, w.removesuffix("ing"))}
    return frozenset(stems | {s + e for s in stems for e in ENDINGS})


def _hashed(words: Iterable[str]) -> list[int]:
    mask = (1 << WORD_BITS) - 1
    return [crc32(w.encode("utf-8", "surrogatepass")) & mask for w in words]


@dataclass(frozen=True)
class Labellers:
    """``insults``: words as ``inflected`` gives them; without any two labellers abstain, and annotations alone teach what is toxic."""

    insults: frozenset[str] = frozenset()
    function_words: frozenset[str] = frozenset(FUNCTION_WORDS)
    #: The first one says no where it finds what it looks for, and nothing elsewhere.
    junk: tuple[str, ...] = (
        "function words", "symbols", "capitals", "bangs", "repeated lines", "bare marks", "marked words", "repeated words", "word length",
    )
    toxic: tuple[str, ...] = ("insult", "insults", "learned")
    #: Log-odds of toxic by hashed word.
    learned: dict[int, float] = field(default_factory=dict)

    def votes(self, text: str, words: list[str], hashed: list[int] | None = None) -> list[int]:
        """The votes on junk, then those on toxic; ``hashed`` are the distinct words as ``_hashed`` gives them."""
        if not words:
            return [NONE] * (len(self.junk) + len(self.toxic))
        counts = np.bincount(_KINDS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
        size, letters = max(1, counts.sum() - counts[4]), max(1, counts[1] + counts[2])
        n = len(words)
        lines = text.split("\n")
        tokens = len(text.split())
        insults = sum(map(self.insults.__contains__, words))
        shared = sum(map(self.function_words.__contains__, words)) / n
        long = n >= 20
        return [
            NO if long and shared >= 0.12 else NONE,
            _band(counts[5] / size, 0.01, 0.06),
            _band(counts[1] / letters, 0.15, 0.3),
            _band(counts[6] / n, 0.02, 0.15),
            _band(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 5 else NONE,
            _band((tokens - n) / n, 0.05, 0.3) if long else NONE,
            _band(len(MARKED.findall(text)) / n, 0.1, 0.3),
            _band(_least_share(words), 0.35, 0.2) if n >= 10 else NONE,
            _band(letters / n, 7.0, 9.0) if long else NONE,
            YES if insults else NONE,
            YES if insults >= 2 or insults / n > 0.01 else NONE,
            self._learned_vote(_hashed(set(words)) if hashed is None else hashed),
        ]


    def _learned_vote(self, hashed: list[int]) -> int:
        found = self.learned.keys() & hashed
        return _band(sum(map(self.learned.get, found)), -LEARNED_SUM, LEARNED_SUM) if found else NONE


def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, trust: float = 0.02, share: float | None = None, finders: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shares of no and yes, and for each labeller the chance of each vote under either.

    ``patterns`` are vote tuples with their number of documents; an abstention says nothing
    about the truth. Every labeller starts with
    a moderate accuracy, which keeps the weight of a ``trust`` share of the documents,
    so the answers cannot change places. With a ``share`` that of yes is not estimated.
    The first ``finders`` labellers vote only on what they find: what they voted is
    compared with all documents, those they abstain on included.
    """
    votes = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([n for _, n in patterns], float)
    start = np.array([[0.95, 0.05], [0.5, 0.5]])
    yes = YES_SHARE if share is None else share
    prior, chance = np.array([1 - yes, yes]), np.repeat(start[None], votes.shape[1], axis=0)
    for _ in range(rounds):
        post = posterior(votes, prior, chance) * weight[:, None]
        if share is None:
            prior = (post.sum(axis=0) + 2.0 * np.array([1 - yes, yes])) / (post.sum() + 2.0)
        for j in range(votes.shape[1]):
            for v in (NO, YES):
                chance[j, :, v] = post[votes[:, j] == v].sum(axis=0) + trust * prior * weight.sum() * start[:, v]
        total = chance.sum(axis=2, keepdims=True)
        for j in range(finders):
            total[j, :, 0] += post[votes[:, j] == NONE].sum(axis=0)
        chance /= total
    return prior, chance


def posterior(votes: np.ndarray, prior: np.ndarray, chance: np.ndarray) -> np.ndarray:
    silent = np.ones((2, 1))
    log = np.log(prior)[None, :] + sum(np.log(np.hstack((chance[j], silent))[:, votes[:, j]]).T for j in range(votes.shape[1]))
    e = np.exp(log - log.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classes(patterns: list[tuple[tuple[int, ...], int]], n_junk: int) -> dict[tuple[int, ...], np.ndarray]:
    """Class probabilities of every vote pattern: the first ``n_junk`` votes are on junk, the others on toxic."""
    answers = []
    for part in (slice(None, n_junk), slice(n_junk, None)):
        counts: dict[tuple[int, ...], int] = {}
        for p, n in patterns:
            counts[p[part]] = counts.get(p[part], 0) + n
        share, finders = None, 1
        if part.start:
            finders = len(patterns[0][0]) - n_junk - 1
            # Nobody but the annotations, which come last, votes no whenever nothing is found.
            no, yes = (sum(n for p, n in counts.items() if p[-1] == v) for v in (NO, YES))
            share = (yes + YES_SHARE) / (no + yes + 1.0)
        prior, chance = label_model(sorted(counts.items()), share=share, finders=finders)
        answers.append(posterior(np.array([p[part] for p, _ in patterns]), prior, chance)[:, YES])
    junk, toxic = answers
    found = np.stack([(1 - junk) * (1 - toxic), junk * (1 - toxic), toxic], axis=1)
    return dict(zip((p for p, _ in patterns), found, strict=True))


def features(hashed: list[int], votes: list[int]) -> list[int]:
    """Hashed words, and votes in a range of their own.

    A vote counts as one, the words of a text together as one by their squares: else many
    words that say little outvote the few labellers that found something.
    """
    return hashed + [
        (1 << WORD_BITS) + 3 * j + v for j, v in enumerate(votes) if v != NONE
    ]


@dataclass
class Scorer:
    """Sparse weights by feature: three numbers each; ``constant`` stands for every document.

    It starts from the shares of the classes, and no penalty draws it to zero.
    """

    weights: dict[int, tuple[float, float, float]]
    constant: np.ndarray
    labellers: Labellers
    min_clean: float = 0.5

    def score(self, text: str | None) -> tuple[float, str]:
        """The probability of clean, and the likeliest class."""
        words = WORD.findall((text or "").lower())
        total = self.constant.copy()
        hashed = _hashed(set(words))
        said, found = ([], [])
        for f in features(hashed, self.labellers.votes(text or "", words, hashed)):
            w = self.weights.get(f)
            if w is not None:
                (said if f < 1 << WORD_BITS else found).append(w)
        total += np.sum(found, axis=0) if found else 0.0
        total += np.sum(said, axis=0) / math.sqrt(len(hashed)) if said else 0.0
        e = np.exp(total - total.max())
        p = e / e.sum()
        return float(p[CLEAN]), CLASSES[int(p.argmax())]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labellers: Labellers, passes: int = 4, rate: float = 1.0, l1: float = 0.2) -> Scorer:
    """Train on ``(features, class probabilities)`` rows in their order, with sparse adaptive steps."""
    if not rows:
        return Scorer({}, np.array([1.0, 0.0, 0.0]), labellers)
    names, index, counts = np.unique(np.concatenate([f for f, _ in rows]), return_inverse=True, return_counts=True)
    used = counts >= MIN_DOCS
    place = np.where(used, np.cumsum(used) - 1, -1)
    size = int(used.sum())
    z, n, w = np.zeros((size + 1, 3)), np.zeros((size + 1, 3)), np.zeros((size + 1, 3))
    bounds = np.cumsum([0] + [len(f) for f, _ in rows])
    at = [np.append(np.unique(p[p >= 0]), size) for p in (place[index[a:b]] for a, b in zip(bounds, bounds[1:], strict=False))]
    is_word = np.append(names[used] < 1 << WORD_BITS, False)
    scale = [np.where(is_word[here], 1.0 / math.sqrt(max(1, int((f < 1 << WORD_BITS).sum()))), 1.0)[:, None] for here, (f, _) in zip(at, rows, strict=True)]
    shares = np.log(np.maximum(sum(target for _, target in rows) / len(rows), 1e-9))
    penalty = np.full((size + 1, 1), l1)
    penalty[size] = 0.0
    for _ in range(passes):
        for k, (_, target) in enumerate(rows):
            here = at[k]
            total = (scale[k] * w[here]).sum(axis=0) + shares
            e = np.exp(total - total.max())
            gradient = scale[k] * (e / e.sum() - target)
            squares = n[here] + gradient * gradient
            z[here] += gradient - (np.sqrt(squares) - np.sqrt(n[here])) / rate * w[here]
            n[here] = squares
            pull = z[here]
            held = penalty[here]
            w[here] = np.where(np.abs(pull) <= held, 0.0, -(pull - np.sign(pull) * held) / ((1.0 + np.sqrt(squares)) / rate))
    kept = names[used]
    weights = {int(f): tuple(v) for f, v in zip(kept.tolist(), w[:size].tolist(), strict=True) if any(v)}
    return Scorer(weights, w[size] + shares, labellers)


def learn_words(rows: DataFrame, marks: DataFrame, labelled_docs: int = LABELLED_DOCS) -> dict[int, float]:
    """Log-odds of toxic by hashed word, from ``rows(id, text)`` and ``marks(id, toxic)``.

    Learned from about ``labelled_docs`` annotated documents, drawn by a hash of the id. Counted
    are the documents of every word; only words whose log-odds are certain reach the driver.
    """
    marks = marks.filter("toxic IS NOT NULL").select("id", "toxic")
    share = labelled_docs / max(1, marks.count())
    # The same draw on both sides: no other text is split into words or joined.
    marks, rows = (side.filter(hash_share(share, F.col("id").cast("string"))) for side in (marks, rows))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(_hashed(set(WORD.findall((t.as_py() or "").lower()))))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["id", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    told = rows.select("id", "text").mapInArrow(hashed, f"id {kind}, words array<int>").join(marks, "id")
    # The empty word stands for every document.
    each = told.select("toxic", F.explode(F.concat(F.array(F.lit(-1)), "words")).alias("word"))
    counts, _ = stage_counting(each.groupBy("word").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no")), "toxic-words", n=F.count("*"))
    total = counts.filter("word = -1").first()
    if total is None or not total.yes or not total.no:
        return {}
    share = total.yes / (total.yes + total.no)
    yes, no = F.col("yes") + LEARNED_PRIOR * share, F.col("no") + LEARNED_PRIOR * (1 - share)
    odds = F.log(yes / no) - math.log(share / (1 - share))
    told = counts.filter("word <> -1").select("word", odds.alias("odds"), F.abs(odds / F.sqrt(1 / yes + 1 / no)).alias("z"))
    kept = told.filter(F.col("z") >= LEARNED_Z).orderBy(F.desc(F.round("z", 6)), "word").limit(LEARNED_WORDS)
    return {r.word: r.odds for r in sorted(kept.collect())}


def train(
    docs: DataFrame, annotations: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    labellers: Labellers = Labellers(), sample_docs: int = SAMPLE_DOCS, min_clean: float = 0.5,
) -> Scorer:
    """Fit the label model on all documents and the scorer on a sample.

    ``annotations`` has ``(id_col, quality, toxic)`` with 0 or 1 in the last two.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if annotations is not None:
        marks = annotations.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[
            F.when((F.min(c) == F.max(c)) & F.min(c).isin(0, 1), F.min(c)).alias(c) for c in ("quality", "toxic")
        ])
        labellers = replace(labellers, learned=learn_words(rows, marks))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found.append("".join(map(str, labellers.votes(text, WORD.findall(text.lower())))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.string())], names=["id", "key", "votes"])

    kind = rows.schema["id"].dataType.simpleString()
    key = F.xxhash64(F.lit(SEED), F.col("id").cast("string"), "text")
    voted = rows.select("id", "text", key.alias("key")).mapInArrow(vote, f"id {kind}, key bigint, votes string")
    none = F.lit(NONE)
    if annotations is None:
        voted = voted.withColumns({"quality": none, "toxic": none})
    else:
        voted = voted.join(marks.withColumn("quality", 1 - F.col("quality")), "id", "left")
    junk, toxic = len(labellers.junk), len(labellers.toxic)
    voted = voted.select("id", "key", F.concat(
        F.substring("votes", 1, junk), F.coalesce("quality", none).cast("string"),
        F.substring("votes", junk + 1, toxic), F.coalesce("toxic", none).cast("string"),
    ).alias("votes"))
    voted, seen = stage_counting(voted, "votes", n=F.count("*"))
    if not seen["n"]:
        return fit_scorer([], labellers)
    patterns = [(tuple(map(int, r.votes)), r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    patterns.sort()
    truth = classes(patterns, junk + 1)

    share = sample_docs / seen["n"]
    mine = F.pmod("key", F.lit(1 << 30)) < F.lit(math.floor(min(1.0, share) * (1 << 30)))
    drawn = rows.withColumn("key", key).filter(mine).join(voted.filter(mine).select("key", "votes").dropDuplicates(["key"]), "key")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, votes in zip(batch.column(1), batch.column(2), strict=True):
                own = [int(v) for v in votes.as_py()]
                own = own[:junk] + own[junk + 1:-1]
                words = set(WORD.findall((text.as_py() or "").lower()))
                found.append(np.array(features(_hashed(words), own), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["key", "votes", "f"])

    sample = drawn.select("key", "text", "votes").mapInArrow(vectors, "key bigint, votes string, f binary").collect()
    sample.sort(key=lambda r: (r.key, r.votes, r.f))
    scorer = fit_scorer([(np.frombuffer(r.f, np.int32), truth[tuple(map(int, r.votes))]) for r in sample], labellers)
    scorer.min_clean = min_clean
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, p_clean, label, keep)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py()) for t in batch.column(1)]
            clean = pa.array([p for p, _ in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), clean, pa.array([c for _, c in found], pa.string()), pc.greater_equal(clean, shared.value.min_clean)],
                names=[id_col, "p_clean", "label", "keep"],
            )

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, p_clean double, label string, keep boolean")


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all columns as they were; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py())[0] >= shared.value.min_clean for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
