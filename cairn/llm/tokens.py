"""Token counts of a unigram tokenizer by count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers' files are, and the piece vocabulary that the query counts with.
TOKENIZERS = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"
#: The mark that stands for a blank, and what an unknown character costs below the worst piece.
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a counter remembers, and the length up to which it does.
_CACHE, _LONG = 300_000, 256
#: A run of blanks (or, if each is split off, one blank) and the word after it, or a word at a line's start.
_WORD = {split: re.compile(f"{BLANK}{'' if split else '+'}[^{BLANK}\n]*|[^{BLANK}\n]+") for split in (False, True)}


def piece_scores(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file; control, unknown and byte pieces never match text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not odd(i)]


class UnigramCounter:
    """Counts pieces of the best segmentation of whole texts; unknown characters count their UTF-8 bytes.

    A text is cut before each run of blanks and around each line's end, where no piece reaches across:
    a piece has blanks at its start only, though any number of them. So the best segmentation of a
    text is that of its words one by one, each with all blanks before it, and those can be remembered.
    With `split`, texts are cut before every blank, as the library's Metaspace does unless told not to;
    pieces of several blanks then match nothing.
    """

    def __init__(self, pieces: list[tuple[str, float]], split: bool = True):
        if not pieces:
            raise ValueError("an empty vocabulary")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        if any(BLANK in p.lstrip(BLANK) for p, _ in pieces) or any("\n" in p for p, _ in pieces):
            raise ValueError("a piece has a blank after another character, or a line's end")
        self.longest = max(len(p) for p, _ in pieces)
        self.word = _WORD[split]
        self.count: dict[str, int] = {}
        self.score: dict[str, float] = {}

    def segment(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path. A path takes another's place only if it is better, and those with
        an earlier last start are tried first; a character without a piece of its own is unknown."""
        keep = self.longest + 1
        best, count, gone = [0.0], [0], 0  # by position in the word, of which the first `gone` are forgotten
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(len(word)):
            top, pieces, single = None, 0, False
            while match is not None and match[0] == end:  # the longest, so the earliest start, comes first
                size, score = match[1]
                start = end + 1 - size - gone
                single |= size == 1
                if top is None or best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
                match = next(matches, None)
            if not single and (top is None or best[-1] + self.unknown > top):
                top, pieces = best[-1] + self.unknown, count[-1] + len(word[end].encode("utf-8", "replace"))
            best.append(top)
            count.append(pieces)
            if len(best) > 4096 + keep:
                gone += len(best) - keep
                del best[:-keep], count[:-keep]
        return count[-1], best[-1]

    def _learn(self, word: str) -> None:
        if len(self.count) > _CACHE:
            self.count.clear()
            self.score.clear()
        self.count[word], self.score[word] = self.segment(word)

    def _of(self, word: str) -> tuple[int, float]:
        if len(word) > _LONG:
            return self.segment(word)
        if word not in self.count:
            self._learn(word)
        return self.count[word], self.score[word]

    def __call__(self, text: str | None) -> tuple[int, float]:
        """A blank goes before the text unless it begins with one."""
        text = (text or "").replace(" ", BLANK)
        if not text:
            return 0, 0.0
        count, score = 0, 0.0
        ends = text.count("\n")
        known, scores = self.count, self.score
        for m in self.word.finditer(text if text[0] == BLANK else BLANK + text):
            w = m[0]
            n = known.get(w)
            if n is None:
                n, more = self._of(w)
                score += more
            else:
                score += scores[w]
            count += n
        return count + ends, score + ends * self.unknown


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pieces: str = f"{TOKENIZERS}/{PIECES}") -> DataFrame:
    """One row per document: doc_id, n_tokens, best_score.

    Null and empty texts have no tokens and score 0. Whole texts are counted, whatever their
    length: a word of any length takes the memory of its longest piece's positions. Repeated rows each get their count; an empty table gives no rows; extra columns are
    not read. The vocabulary goes to the tasks as a list of bounded size, the tokenizer's own.
    """
    vocabulary = piece_scores(pieces)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary, split=False)
        for b in batches:
            n, score = zip(*(counter(t.as_py()) for t in b.column("text")), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, best_score double")
