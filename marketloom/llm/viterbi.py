"""Token counts of a unigram vocabulary: Aho-Corasick matches, count-only Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm.shared import id_and_text, read_bounded, slices

#: A space inside a piece.
SPACE = "▁"
#: How far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Words whose result a Python worker remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; whether an unknown character falls into its UTF-8 bytes, a piece each."""

    pieces: dict[str, float]
    byte_fallback: bool

    @property
    def splits_at_spaces(self) -> bool:
        """No piece reaches over the start of a word, and sums of scores are exact in any order."""
        return all(SPACE not in p.lstrip(SPACE) and float(s).is_integer() for p, s in self.pieces.items())


def read_vocabulary(model: bytes) -> Vocabulary:
    """The pieces of a piece model's file that stand for text, with the scores in the file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=model)
    ids = range(model.get_piece_size())
    text = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in text}, any(model.is_byte(i) for i in ids))


class Counter(dict):
    """Best score and number of pieces of texts; words are remembered where they stand alone."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[float, int]] = {}
        self.by_word = vocabulary.splits_at_spaces
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()

    def best(self, text: str) -> tuple[float, int]:
        """The best segmentation's score and number of pieces.

        Ties between segmentations that end at one place go to the longest last piece. An unknown
        character is taken only where no piece is that character alone. Unknown characters count
        one piece for each UTF-8 byte if the vocabulary has bytes, else one for each run of them.
        """
        n = len(text)
        none = float("-inf")
        score, count, alone = [none] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        at = 0
        unknown, known_end = self.unknown, -1
        bytes_too, run = self.vocabulary.byte_fallback, [False] * (n + 1)

        def close(to: int) -> None:
            """Characters up to the place to are done; those that are no piece alone are unknown ones."""
            nonlocal at
            while at < to:
                at += 1
                if not alone[at] and score[at - 1] + unknown > score[at]:
                    score[at] = score[at - 1] + unknown
                    more = len(text[at - 1].encode()) if bytes_too else int(not run[at - 1])
                    count[at] = count[at - 1] + more
                    run[at] = True

        if len(self.automaton):
            for last, (length, value) in self.automaton.iter(text):
                end = last + 1
                if end != known_end:
                    # all that end earlier are complete; of the same end, longer pieces come first
                    close(end - 1)
                    at, known_end = end - 1, end
                begin = score[end - length] + value
                if length == 1:
                    alone[end] = True
                if begin > score[end]:
                    score[end], count[end] = begin, count[end - length] + 1
                    run[end] = False
        close(n)
        return score[n], count[n]

    def __missing__(self, word: str) -> tuple[float, int]:
        found = self.older.get(word) or self.best(word)
        if len(word) <= LONGEST:
            self[word] = found
        return found

    def count(self, text: str) -> tuple[float, int]:
        """Of a whole text: spaces become pieces' spaces and one stands before the text; an empty text has no piece."""
        if not text:
            return 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.best(marked)
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        # words begin at a run of spaces; a run of several spaces stays with the word behind it
        words = marked.split(SPACE)[1:]
        if "" in words:
            words = _with_runs(words)
            parts = [self[w] for w in words]
        else:
            parts = [self[w] for w in map(SPACE.__add__, words)]
        scores, counts = zip(*parts, strict=True)
        return float(sum(scores)), sum(counts)


def _with_runs(words: list[str]) -> list[str]:
    """Each empty word is a further space before the next word."""
    out, spaces = [], ""
    for word in words:
        spaces += SPACE
        if word:
            out.append(spaces + word)
            spaces = ""
    return out + [spaces] * bool(spaces)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) for every row: pieces and score of the best segmentation of the whole text.

    The vocabulary is the piece model's, read as a unigram vocabulary. A null or empty text has no
    tokens and score 0. Rows are counted where they are; repeated rows and null ids are passed on,
    an empty table gives none, other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(read_bounded(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            for part in slices(batch):
                found = [counter.count(text) for text in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([c for _, c in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, score double")
