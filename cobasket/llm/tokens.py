"""Token counts by a Viterbi search that keeps only score and piece count.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a
position; dynamic programming carries the best score and the number of pieces, so no
piece sequence is ever built. The rules are those of a unigram tokenizer with a
word-start mark: blanks become the mark, a text starts with one, and words do not
share pieces. A character without a one-character piece may be an unknown piece, whose
score is the least of the vocabulary minus ten; it counts as its UTF-8 bytes when the
vocabulary has byte pieces, else runs of unknown characters count as one. Of paths
with equal scores the one whose last piece is longer wins.

Texts that are null or empty have 0 pieces and score 0. Repeated rows and repeated ids
give one row each. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Words counted once and looked up after that, for each worker; emptied when full.
MEMO_WORDS = 400_000
MEMO_WORD_CHARS = 80


def read_pieces(model_path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a piece-model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    """Counts the pieces of texts; ``count`` gives (pieces, score)."""

    def __init__(self, pieces: Iterable[tuple[str, float]]):
        import ahocorasick

        pieces = list(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # No piece crosses a line end, and each line end is a byte piece of its own.
        self.by_line = self.by_bytes and not any("\n" in p for p in names)
        self.memo: dict[str, tuple[int, float]] = {}

    def _search(self, word: str) -> tuple[int, float]:
        size = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        best, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end, matches in enumerate(ends):
            top, pieces, single, odd = -math.inf, 0, False, False
            for length, score in sorted(matches, reverse=True):
                start = end + 1 - length
                if best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
                single = single or length == 1
            if not single and best[end] + self.unknown > top:
                top, odd = best[end] + self.unknown, True
                if self.by_bytes:
                    pieces = count[end] + len(word[end].encode("utf-8", "surrogatepass"))
                else:
                    pieces = count[end] + (not unknown[end])
            best[end + 1], count[end + 1], unknown[end + 1] = top, pieces, odd
        return count[size], best[size]

    def _word(self, word: str) -> tuple[int, float]:
        found = self._search(word)
        if len(word) <= MEMO_WORD_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        lines = (text if text[0] == " " else f" {text}").split("\n") if self.by_line else [text if text[0] == " " else f" {text}"]
        pieces, score = len(lines) - 1, (len(lines) - 1) * self.unknown
        memo, word = self.memo, self._word
        for line in lines:
            head, *rest = line.split(" ")
            if head:
                n, s = memo.get(head) or word(head)
                pieces += n
                score += s
            for part in rest:
                part = MARK + part
                n, s = memo.get(part) or word(part)
                pieces += n
                score += s
        return pieces, score


def count_pieces(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_pieces, score)`` for every row of ``docs``.

    The vocabulary goes to the workers as a broadcast: a tokenizer's vocabulary has a
    fixed size, whatever the corpus. Each worker builds its automaton once per task.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary.value)
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=[id_col, "n_pieces", "score"],
            )

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_pieces bigint, score double")
