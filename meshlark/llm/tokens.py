"""Token counts of a unigram tokenizer, by a Viterbi pass that carries no tokens.

Pieces and scores come from a public vocabulary file.  Text is cut before each space,
which becomes U+2581, as the metaspace pre-tokenizer does; in each such word an
Aho-Corasick automaton lists all pieces by their ends, and a dynamic programme keeps
for each end the best score and that path's number of pieces.  Ties go as in the
tokenizer: the earliest start that reaches a score keeps it, and a character without a
piece of its own (least score minus 10) is tried after all pieces.  Such a character
counts as one byte piece for each of its UTF-8 bytes.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
#: Words remembered by a worker, with their counts; they are forgotten all at once beyond that.
MEMORY = 200_000


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Ordinary pieces and scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Best score and piece count of a word."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.known: dict[str, tuple[float, int, int]] = {}

    def word(self, word: str) -> tuple[float, int, int]:
        """(score, pieces, pieces that are bytes).

        The automaton lists matches by their ends, and for one end the longest, so the
        earliest start, first; a strictly better score is needed to replace it.
        """
        n, single = len(word), self.single
        scores: list = [None] * (n + 1)
        counts, raws = [0] * (n + 1), [0] * (n + 1)
        scores[0] = 0.0
        done = 0  # ends up to here have had their character's own fallback
        for end, (size, score) in self.machine.iter(word):
            while done < end:
                done += 1
                if word[done - 1] not in single:
                    self._fallback(word, done, scores, counts, raws)
            start, end = end + 1 - size, end + 1
            score += scores[start]
            if scores[end] is None or score > scores[end]:
                scores[end], counts[end], raws[end] = score, counts[start] + 1, raws[start]
        while done < n:
            done += 1
            if word[done - 1] not in single:
                self._fallback(word, done, scores, counts, raws)
        return scores[n], counts[n], raws[n]

    def _fallback(self, word: str, end: int, scores: list, counts: list, raws: list) -> None:
        """The character before ``end`` as its UTF-8 bytes, if that is better than what ends there."""
        score = self.unknown + scores[end - 1]
        if scores[end] is None or score > scores[end]:
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            scores[end], counts[end], raws[end] = score, counts[end - 1] + size, raws[end - 1] + size

    def text(self, text: str) -> tuple[int, int, float]:
        """(pieces, byte pieces, score) of a whole text."""
        if not text:
            return 0, 0, 0.0
        text = text.replace(" ", SPACE)
        words = (text if text[0] == SPACE else SPACE + text).split(SPACE)[1:]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        pieces = raw = 0
        total = 0.0
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.word(SPACE + w)
                if len(w) <= 64:
                    known[w] = found
            total += found[0]
            pieces += found[1]
            raw += found[2]
        return pieces, raw, total


@functools.cache
def _counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(list(pieces))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_chars, n_tokens, n_byte_tokens, score), a row for each row.

    ``path`` is read on the driver; its pieces, of a size fixed by the file, go to
    the workers with the task.  A null or empty text has no tokens and score 0; other
    columns are ignored.
    """
    pieces = tuple(vocabulary(path))

    def run(batches):
        counter = _counter(pieces)
        for batch in batches:
            sizes, counts, raws, scores = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                count, raw, score = counter.text(text)
                sizes.append(len(text))
                counts.append(count)
                raws.append(raw)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(raws, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_chars", "n_tokens", "n_byte_tokens", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, score double")
