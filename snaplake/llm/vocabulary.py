"""The fixed public vocabulary: pieces of a SentencePiece model file, whose path is a parameter."""

from __future__ import annotations

import os

#: Where the public tokenizers lie unless SNAPLAKE_TOKENIZERS or a caller says otherwise.
TOKENIZERS = os.environ.get("SNAPLAKE_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def load_pieces(path: str | None = None) -> list[str]:
    """All pieces in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or f"{TOKENIZERS}/{MODEL}")
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]
