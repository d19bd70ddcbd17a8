"""Token counts of a unigram tokenizer without its tokens.

Text is cut at white space and each word gets the meta symbol in front, so no piece spans two words.  In a word an
Aho-Corasick automaton finds all vocabulary pieces, and dynamic programming over the places carries the best score and
its number of pieces.  Ties follow the tokenizer: places are served left to right and a later way must be strictly
better to replace an earlier one.  A character that starts no one-character piece may be an unknown, at a penalty
below the worst score.  With byte fallback an unknown counts as its UTF-8 bytes, else neighbouring unknowns are one
token.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid.llm.common import SPACES, checkpointed, col, text_batches

META = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts each worker keeps at a time; speed only.
KEPT_WORDS = 1_000_000
_GAPS = str.maketrans({c: " " for c in SPACES})
_counters: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, control pieces and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


def has_bytes(path: str) -> bool:
    """Whether a sentencepiece model file has all 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False) -> None:
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Tokens of one word (its meta symbol included)."""
        n = len(text)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (size, score) in self.automaton.iter(text):
            found[last - size + 1].append((size, score))
        best: list[float | None] = [0.0] + [None] * n
        count, tail = [0] * (n + 1), [False] * (n + 1)  # tail: the last token is unknown
        for i in range(n):
            here, single = best[i], False
            for size, score in found[i]:
                single = single or size == 1
                end, total = i + size, here + score
                if best[end] is None or total > best[end]:
                    best[end], count[end], tail[end] = total, count[i] + 1, False
            if not single:
                total = here + self.unknown
                if best[i + 1] is None or total > best[i + 1]:
                    new = len(text[i].encode("utf-8", "surrogatepass")) if self.byte_fallback else not tail[i]
                    best[i + 1], count[i + 1], tail[i + 1] = total, count[i] + new, True
        return count[n]

    def text(self, text: str) -> int:
        words, known = text.translate(_GAPS).split(" ") if any(c in text for c in SPACES[1:]) else text.split(" "), self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        known.setdefault("", 0)
        new = set(words).difference(known)
        for w in new:
            known[w] = self.word(META + w)
        total = sum(map(known.__getitem__, words))
        for w in new:
            if len(w) > 64:
                del known[w]
        return total


def _counts(path: str):
    def run(texts: pd.Series) -> pd.Series:
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path), has_bytes(path))
        return pd.Series([_counters[path].text(t or "") for t in texts], dtype="int64")

    return run


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of unigram tokens of a text; null or blank: 0."""
    return F.pandas_udf(_counts(path or public_tokenizers.path("piece_bpe_32k.model")), T.LongType())(text)


def op5_token_count(docs: DataFrame) -> DataFrame:
    """Token counts of all documents, whole texts.

    The pieces are those of a merge vocabulary read as unigrams, so the counts are of no published tokenizer.  A null or
    empty text has none, repeated rows are counted each, ties of score go as the library's own model breaks them, an empty
    table gives an empty one, further columns are ignored.
    """
    with text_batches(docs.sparkSession):
        return checkpointed(docs.select("doc_id", token_count(col("text")).alias("n_tokens")))
