"""Token counts of a BPE piece model, without making ids.

A text is a row of symbols, one a character, with blanks written as the model's mark. The
least-ranked adjacent pair is merged again and again; ranks order pieces by falling score,
and of equal ranks the leftmost goes first. The count is the number of first
symbols minus that of merges; a symbol that stays alone and is no piece counts its UTF-8
bytes, as the model falls back to them.

Where no piece joins two kinds of characters (checked on the model), a text falls apart
between them into words that merge by themselves; a task keeps the counts of words it met.
"""

from __future__ import annotations

import re

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.merges import merge_parts
from vecloom.llm.texts import map_texts

MARK = "▁"
# Words kept by a task, beyond which it starts afresh, and the longest that is kept: at most
# some 100 MB together.
CACHE_SIZE, CACHE_CHARS = 400_000, 32


def load_pieces(path: str) -> dict[str, int]:
    """Rank of every ordinary piece of a SentencePiece BPE model with byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "Ａ  ½\t "
    if model.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("a model that rewrites texts is not supported")
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }
    order = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
    return {piece: order[score] for piece, score in scores.items()}


def word_pattern(ranks: dict[str, int]) -> re.Pattern:
    """What may be counted by itself: blanks and what follows them. Letters and other
    characters, and line feeds, are words of their own where no piece joins them."""
    joined = [p.lstrip(MARK) for p in ranks if len(p) > 1]
    if any(MARK in p for p in joined):
        raise ValueError("a model with pieces that end in a blank is not supported")
    letter = re.compile(r"[^\W\d_]")
    if any("\n" in p and p != "\n" for p in joined) or any(
        0 < len(letter.findall(p)) < len(p) for p in joined
    ):
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    other = rf"(?:[^{MARK}\n\w]|[\d_])"
    return re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*{other}+|{MARK}+|\n")


def counter(ranks: dict[str, int]):
    """Function from a word to its number of tokens."""

    def count(word: str) -> int:
        left = merge_parts(word, ranks)
        # A merged part is a piece; only a first symbol can be none.
        unknown = sum(len(x.encode()) - 1 for x in left if x not in ranks)
        return len(left) + unknown

    return count


def token_counts(
    df: DataFrame,
    path: str,
    limit: int = 4096,
    keep: list[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """(keep..., n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` names a model readable on the driver. Nulls and empty texts have no tokens;
    repeated rows stay; an empty table gives none; other columns are not read.
    """
    ranks = load_pieces(path)
    words = word_pattern(ranks)

    def start():
        cut, count = words.findall, counter(ranks)

        class Counts(dict):
            def __missing__(self, word: str) -> int:
                found = count(word)
                if len(word) <= CACHE_CHARS:
                    self[word] = found
                return found

        known = Counts()

        def kernel(texts: list):
            if len(known) > CACHE_SIZE:
                known.clear()
            sizes, tokens = [], []
            for text in texts:
                text = text or ""
                sizes.append(len(text.encode()))
                marked = MARK + text.replace(" ", MARK) if text else ""
                tokens.append(sum(map(known.__getitem__, cut(marked))))
            return [sizes, tokens, [n > limit for n in tokens]]

        return kernel

    keep = [F.col(c) for c in keep]
    return map_texts(
        df, keep, F.col(text_col), start, "n_bytes long, n_tokens long, over_limit boolean"
    )
