"""Token ids of whole texts, encoded word by word with a bounded cache.

The tokenizer's own pre-tokenizer drops white space and never lets a token cross it, and its normaliser works
within words, so the ids of a text are the ids of its words in turn. Each worker therefore encodes a word once
and keeps its ids as little-endian bytes; corpora repeat their words many times over. The cache is emptied when it
reaches CACHE words. Words of plain Latin letters go straight to the tokenizer's model, which is what its
pipeline would hand them to; all others pass the whole pipeline. ``tests/llm`` compares with encoding whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from plumbline.llm.common import held

VOCABULARY = "word_bpe_49k.json"
CACHE = 400_000
# A longer word is not kept, so the cache's bytes are bounded too.
KEPT_BYTES = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """A word's UTF-8 bytes -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.spelled: dict[str, str] = {}  # a letter as the model spells its bytes

    def _spell(self, word: str) -> str:
        for c in word:
            if c not in self.spelled:
                self.spelled[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        return "".join(map(self.spelled.__getitem__, word))

    def _encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if len(word) <= KEPT_BYTES and max(text) < "ƀ":
            if text[-1] in ".," and text[:-1].isalpha():
                return self[word[:-1]] + self[word[-1:]]
            if text.isalpha():
                plain = text.lower()
                if plain != text:
                    text = plain if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
                    return self[text.encode()]
                return np.array([t.id for t in self.tokenizer.model.tokenize(self._spell(text))], "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self._encode(word) if word else b""
        if len(word) <= KEPT_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8; ``split`` parts it at ASCII white space only."""
        return b"".join(map(self.__getitem__, text.split()))


def words(path: str) -> Words:
    """This worker's cache for a vocabulary file, which every node holds at the same path."""
    return held(("words", path), lambda: Words(path))
