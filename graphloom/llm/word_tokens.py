"""Token ids of a word-level vocabulary, by chunks and their pre-tokens.

The vocabulary drops white space, so a text is its chunks (runs without ASCII white space), each on its own. A chunk that was
seen lately is looked up. A new one of plain letters, digits and signs is lower-cased and cut into the vocabulary's
pre-tokens, which are looked up in turn and merged by the tokenizer's model when they are new. Chunks with any other character or
a special string go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from typing import Any

import numpy as np

from .common import held

#: The vocabulary's pattern for pre-tokens, as far as it concerns the characters below.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters that are one character in every normal form and have one lower-case letter each: Latin-1 and Latin Extended-A,
#: without the dotted capital I (U+0130), the n with an apostrophe (U+0149) and the long s (U+017F).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_TOKENS = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class _Generations(dict):
    """Values by key, made when first asked for. Two generations of at most `limit` values; keys over `longest` aren't kept."""

    def __init__(self, make: Any, limit: int, longest: int = 64) -> None:
        self.make, self.limit, self.longest = make, limit, longest
        self.old: dict = {}

    def __missing__(self, key: Any) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordStore:
    """Ids of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else "(?!)")
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {i: chr(i) for i in range(0xC0, 0x180) if _PLAIN.fullmatch(chr(i))}
        self.mapped = {i: bytewise.pre_tokenize_str(c)[0][0] for i, c in letters.items()}
        self.merge = self.tokenizer.model.tokenize
        self.words = _Generations(self._word, limit)
        self.chunks = _Generations(self._chunk, limit)

    def _word(self, word: str) -> bytes:
        tokens = self.merge(word if word.isascii() else word.translate(self.mapped))
        return b"".join([self.raw[t.id] for t in tokens])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            words = _TOKENS.findall(text.lower())
            return self.words[words[0]] if len(words) == 1 else b"".join(map(self.words.__getitem__, words))
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Of a whole UTF-8 text."""
        return b"".join(map(self.chunks.__getitem__, text.split()))


def word_store(path: str) -> WordStore:
    """One store per Python worker."""
    return held((path, "words"), lambda: WordStore(path))
