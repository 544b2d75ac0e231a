"""An existing SentencePiece vocabulary, read once on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_MODEL = "piece_bpe_32k.model"


def default_path() -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", DEFAULT_DIR), DEFAULT_MODEL)


@dataclass
class Pieces:
    """Texts, scores and kinds of a model's pieces."""

    texts: list[str]
    scores: np.ndarray
    #: ids of ordinary pieces, of byte pieces by byte, and of the unknown piece
    normal: np.ndarray
    bytes_at: np.ndarray
    unknown: int
    unigram: bool
    dummy_prefix: bool

    @property
    def has_bytes(self) -> bool:
        return bool((self.bytes_at >= 0).all())


def load(path: str | None = None) -> Pieces:
    """Reads the model file at path."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    normal, bytes_at = [], np.full(256, -1)
    for i in range(n):
        if sp.is_byte(i):
            bytes_at[int(texts[i][3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal.append(i)
    # Unigram scores are log probabilities; scores of merges are ranks.
    whole = bool(len(normal)) and bool(np.all(scores[normal] == np.round(scores[normal])))
    pieces = sp.encode_as_pieces("a")
    return Pieces(texts, scores, np.array(normal), bytes_at, sp.unk_id(), not whole, bool(pieces) and pieces[0].startswith(SPACE))
