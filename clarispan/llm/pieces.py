"""The fixed public vocabulary of pieces that the unigram operators share."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
import sentencepiece

VOCABULARY = "piece_bpe_32k.model"
START = "▁"


@lru_cache(maxsize=2)
def pieces(path: str | None = None) -> dict[str, int]:
    """Piece to its number, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: i for i, p in enumerate(kept)}


def longest(table: dict[str, int]) -> int:
    return max(map(len, table))


def pretokens(text: str) -> list[str]:
    """Runs between white space, each after a START mark."""
    return [START + w for w in text.split()]
