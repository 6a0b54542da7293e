"""Words to token ids through a public tokenizer file, with the ids of every word kept."""

from __future__ import annotations

import os
import re

import numpy as np

_OPEN: dict[str, WordIds] = {}

#: Words, and pieces of words, whose ids a process keeps; beyond it starts anew. Both take up to about 100 MB together.
KEEP, KEEP_PIECES = 400_000, 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Bytes of a word to its ids as little-endian unsigned 32-bit numbers.

    For tokenizers whose normaliser and splitter treat ASCII white space as a border that is dropped: what stands between two
    borders has the same ids everywhere. Words of Latin letters, digits and marks are normalised and split here and given to
    the tokenizer's model; any other word goes through the whole tokenizer. Special tokens in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.pieces: dict[str, bytes] = {}
        # fixed values: the splitter of the file, and the bytes that a byte-level vocabulary writes as other characters
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        moved = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.visible = {b: 256 + k for k, b in enumerate(moved)}
        self.plain = re.compile("[\x21-\x7e\xa1-įı-ɏ]+").fullmatch

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain(text):
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in self.split(text.lower())])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= KEEP:
            self.clear()
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.visible)
        ids = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
        if len(self.pieces) >= KEEP_PIECES:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
