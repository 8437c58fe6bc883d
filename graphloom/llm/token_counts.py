"""Exact token counts of prefixes, by dynamic programming over prefixes.

The vocabulary drops white space and never merges over it, so count(prefix) at the end of a chunk (a
run without ASCII white space) is the count at the end of the chunk before plus the chunk's own
tokens. These sums are the table stored for a text. Inside a chunk, of any length, the counts of all its prefixes come from one
pass over its characters (`ChunkPrefixes`), made for the chunk that is asked about: the counts of closed pre-tokens, plus, for the
open one, the count at the end of each of its prefixes, which is one more than the count where its last token begins. Token
counts don't always grow with a prefix inside a chunk, hence a table and not an interpolation. With both,
"how many tokens do the first p characters have" and "how long a prefix fits a budget" need no
encoding of prefixes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import ChunkStore, id_counts, shared_store
from .common import small_batches

_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")


class Merges:
    """The vocabulary's merges. Symbols are bytes, the last one of a pre-token with the vocabulary's end of word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.longest = max(map(len, self.vocab))
        self.apart = lru_cache(1 << 18)(self._apart)

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _apart(self, left: str, right: str, last: bool) -> bool:
        symbols = [*left, *right]
        if last:
            symbols[-1] += self.end
        return self._merge(symbols) == ([left] if left else []) + [right + self.end * last]


class OpenToken:
    """Counts of the prefixes of one pre-token while it grows.

    A row of tokens is what the merges give exactly if each two neighbours stay apart when they are merged alone, so the last
    token of a prefix is the one that fits behind the last token of what is in front of it.
    """

    def __init__(self, merges: Merges, bytes_: str = "") -> None:
        self.merges, self.bytes = merges, ""
        self.inner, self.token = [0], [""]  # of each prefix that goes on: its count and its last token
        self.push(bytes_)

    def push(self, bytes_: str) -> None:
        for b in bytes_:
            self.bytes += b
            count, token = self._last(False)
            self.inner.append(count)
            self.token.append(token)

    def drop(self, n: int) -> None:
        """Takes the last `n` bytes away again."""
        if n:
            del self.inner[-n:], self.token[-n:]
            self.bytes = self.bytes[:-n]

    def count(self) -> int:
        """Tokens if it ends here."""
        return self._last(True)[0] if self.bytes else 0

    def _last(self, last: bool) -> tuple[int, str]:
        p, m = len(self.bytes), self.merges
        for q in range(p - 1, max(-1, p - m.longest - 1), -1):
            own = self.bytes[q:p]
            if own + m.end * last in m.vocab and m.apart(self.token[q], own, last):
                return self.inner[q] + 1, own
        raise ValueError("the vocabulary lacks a byte")

    def least(self) -> int:
        """No longer prefix has as few tokens."""
        return min(self.inner[-self.merges.longest :])


@lru_cache(1)
def _composing() -> frozenset[str]:
    """Characters that can be composed with one in front of them."""
    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | {chr(i) for i in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})  # and Hangul's vowels and finals


def _joins(c: str) -> bool:
    """Whether a character can change what is in front of it when the text is normalised."""
    if c < "\u0300":
        return False
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) > 0 or first in _composing()


class ChunkPrefixes:
    """Counts of all prefixes of chunks. A prefix is normalised as it ends, so where its last characters would yet be composed
    with the next ones, they are pushed as they are by themselves and taken away again."""

    #: The pre-tokens that begin with an apostrophe.
    SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

    def __init__(self, store: ChunkStore, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.merges = store.tokenizer, Merges(path)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(store.special, key=len, reverse=True))) + ")") if store.special else None
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = lru_cache(1 << 14)(lambda c: bytewise.pre_tokenize_str(c)[0][0])
        self.kind = lru_cache(1 << 14)(self._kind)

    def _kind(self, c: str) -> str:
        """How the vocabulary's pattern takes a character: as a letter, a number of its own, another sign, or as a space."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if len(cut("a" + c)) == 1:
            return "letter" if cut(c) else "space"
        return "number" if len(cut(c + c)) == 2 else "sign"

    def counts(self, chunk: str, budget: int | None = None) -> list[int]:
        """From the empty prefix on, as far as `budget` tokens can reach, or of all."""
        out, done = [0], 0
        for part in self.special.split(chunk) if self.special else [chunk]:
            if self.special and self.special.fullmatch(part):
                # a special string that is cut belongs to the text in front of it
                cut = self._plain(before + part[:-1], None)[len(before) + 1 :]
                out += [base + n for n in cut]
                done += 1
                out.append(done)
                before, base = "", done
                continue
            own = self._plain(part, None if budget is None else budget - done)
            out += [done + n for n in own[1:]]
            if len(own) <= len(part):
                break
            before, base, done = part, done, done + own[-1]
        return out

    def _plain(self, text: str, budget: int | None) -> list[int]:
        out, state = [0], _State(self)
        ends = [i for i in range(1, len(text)) if not _joins(text[i])] + [len(text)] * bool(text)
        begin = 0
        for end in ends:
            for i in range(begin + 1, end):  # inside of what is normalised together
                fork = state.fork()
                fork.add(self.tokenizer.normalizer.normalize_str(text[begin:i]))
                out.append(fork.count())
                fork.undo()
            state.add(self.tokenizer.normalizer.normalize_str(text[begin:end]))
            out.append(state.count())
            if budget is not None and state.least() >= budget:
                break
            begin = end
        return out


class _State:
    """The tokens of closed pre-tokens, and the open one."""

    def __init__(self, of: ChunkPrefixes) -> None:
        self.of, self.done, self.kind, self.open = of, 0, "", OpenToken(of.merges)
        self.text = ""  # of the open pre-token, as far as it can become a short one
        self.quote: int | None = None  # tokens in front of an apostrophe that one letter follows

    def fork(self) -> _State:
        """A state to go on with for a while; both share the open pre-token, from which `undo` takes what was pushed."""
        out = _State.__new__(_State)
        out.__dict__ = {**self.__dict__}
        out.shared, out.size = self.open, len(self.open.bytes)
        return out

    def undo(self) -> None:
        self.shared.drop(len(self.shared.bytes) - self.size)

    def add(self, text: str) -> None:
        for c in text:
            self._add(c, self.of.kind(c))

    def _add(self, c: str, kind: str) -> None:
        of = self.of
        if kind == "letter" and self.quote is not None and f"'{self.text}{c}" in of.SHORT:
            self.done, self.kind, self.text = self.quote + self._whole(f"'{self.text}{c}"), "", ""
            self.open, self.quote = OpenToken(of.merges), None
            return
        if kind == "letter" and self.kind == "sign" and self.text == "'":
            if f"'{c}" in of.SHORT:
                self.done, self.kind, self.text, self.open = self.done + self._whole(f"'{c}"), "", "", OpenToken(of.merges)
                return
            quote = self.done
            self._close()
            self.kind, self.text, self.open, self.quote = "letter", c, OpenToken(of.merges, of.mapped(c)), quote
            return
        self.quote = None
        if kind == "space":
            self._close()
        elif kind == self.kind and kind != "number":
            self.open.push(of.mapped(c))
            self.text = ""
        else:
            self._close()
            self.kind, self.text, self.open = kind, c, OpenToken(of.merges, of.mapped(c))

    def _whole(self, token: str) -> int:
        return OpenToken(self.of.merges, "".join(map(self.of.mapped, token))).count()

    def _close(self) -> None:
        self.done += self.open.count()
        self.kind, self.text, self.open = "", "", OpenToken(self.of.merges)

    def count(self) -> int:
        return self.done + self.open.count()

    def least(self) -> int:
        """What every longer prefix has more of."""
        if self.quote is not None or self.text == "'":
            return 0
        return self.done + (self.open.least() if self.open.bytes else -1)  # white space adds nothing


class PrefixCounter:
    def __init__(self, path: str) -> None:
        self.store = shared_store(path, id_counts)
        self.prefixes = ChunkPrefixes(self.store, path)

    def counts(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each UTF-8 text the counts at its chunk ends, beginning with 0."""
        parts = [t.split() for t in texts]
        out = []
        for own in self.store.lookup(parts, bytes.decode):
            sums = np.zeros(len(own) + 1, np.int64)
            np.cumsum(np.array(own, np.int64), out=sums[1:])
            out.append(sums)
        return out

    def prefix_table(self, text: str) -> np.ndarray:
        """The counts of all prefixes of a text, from the empty one on."""
        out, done = np.zeros(len(text) + 1, np.int64), 0
        for m in _CHUNK.finditer(text):
            own = self.prefixes.counts(m[0])
            out[m.start() : m.end() + 1] = done + np.array(own)
            done += own[-1]
            out[m.end() :] = done
        return out

    def longest_prefix(self, text: str, sums: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        if sums[-1] <= budget:
            return len(text)
        k = bisect_right(sums, budget) - 1  # chunks 0..k-1 fit as a whole, chunk k doesn't
        for i, m in enumerate(_CHUNK.finditer(text)):
            if i == k:
                left = budget - int(sums[k])
                return m.start() + max(p for p, n in enumerate(self.prefixes.counts(m[0], left)) if n <= left)
        raise ValueError("the table belongs to another text")

    def count(self, text: str, sums: np.ndarray, prefix: int) -> int:
        """Tokens of the first `prefix` characters."""
        done = 0
        for i, m in enumerate(_CHUNK.finditer(text, 0, prefix)):
            whole = m.end() < prefix or not _CHUNK.match(text, prefix) or m.end() == len(text)
            done = int(sums[i + 1]) if whole else int(sums[i]) + self.prefixes.counts(m[0])[-1]
        return done


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_table: bool = False,
) -> DataFrame:
    """One row per input row: the id, `n_bytes`, `n_tokens`, `over_limit` and `fit_chars` (characters of
    the longest prefix of at most `limit` tokens; the whole text if it fits).

    `vocabulary`: a tokenizers JSON file that every executor can open. `with_table` adds
    `prefix_tokens`, the counts at the chunk ends. Null is empty: no bytes, no tokens. One text is one
    row of one batch, so memory follows the longest text.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter(vocabulary)
        for pdf in batches:
            raw = [t.encode() for t in pdf["_text"]]
            sums = counter.counts(raw)
            total = [int(s[-1]) for s in sums]
            out = pd.DataFrame(
                {
                    "_id": pdf["_id"],
                    "n_bytes": [len(r) for r in raw],
                    "n_tokens": total,
                    "over_limit": [n > limit for n in total],
                    "fit_chars": [counter.longest_prefix(t, s, limit) for t, s in zip(pdf["_text"], sums)],
                }
            )
            if with_table:
                out["prefix_tokens"] = [s.tolist() for s in sums]
            yield out

    return slim.mapInPandas(counted, schema + ", prefix_tokens array<long>" * with_table).withColumnRenamed("_id", id_col)
