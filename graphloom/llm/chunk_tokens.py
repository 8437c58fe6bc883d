"""Exact tokenisation by independent chunks.

Both tokenizers used here split a text before they merge symbols, and certain places are always
split: between those places a chunk's tokens don't depend on what stands around it. A chunk that was
seen before is looked up; new ones go to the tokenizer in one call. The store has two generations of
at most `limit` chunks each, and chunks of over `longest` characters are not kept, so its memory is bounded.

For a byte-level vocabulary many texts are cut at once, as bytes (`byte_chunks`), and equal chunks are looked up
once (`chunk_ids`). Most new chunks are then one word, which goes to the vocabulary's merges without its pattern.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held


#: Where a chunk begins; and a space that begins none.
_BEFORE_WORD, _INNER_SPACE = re.compile(r"(?= \S)"), re.compile(r" (?!\S)")

#: What a byte-level pattern never splits: letters (ASCII, Latin-1, Latin Extended-A), digits or ASCII signs behind at most one space.
_WORD = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ž]+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: The character that a byte-level vocabulary writes for each byte; a space for 0xFF, which isn't in UTF-8.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = "".join(chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(255)) + " "

#: Kinds of bytes: ASCII letters and digits, ASCII signs, tabs and line ends, any ASCII white space, bytes that can begin other white
#: space, bytes that begin a character of U+00C0 to U+027F, and second bytes of Latin-1 letters.
_ALNUM, _SIGN, _BREAK, _WHITE, _MAYBE_WHITE, _LATIN, _SECOND = (1 << i for i in range(7))
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (_ALNUM, b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (_SIGN, bytes(b for b in range(33, 127) if not chr(b).isalnum())),
    (_BREAK, b"\t\n\r"),
    (_WHITE, bytes([*range(9, 14), *range(28, 33)])),
    (_MAYBE_WHITE, b"\xc2\xe1\xe2\xe3"),
    (_LATIN, bytes(range(0xC3, 0xCA))),
    (_SECOND, bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))),  # not the signs for times and divided by
):
    _KINDS[list(_bytes)] |= _kind
_WIDE_WHITE = [int.from_bytes(chr(c).encode(), "big") for c in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def id_bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers; `ends` are the places of the separators."""
    raw, cuts = ids.astype("<u4").tobytes(), (ends * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]


def id_counts(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    return (np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1).tolist()


def _byte_sizes(tokenizer: Any) -> np.ndarray | None:
    """The bytes of each token of a byte-level vocabulary with its usual pattern, which writes a byte as one
    character; None for any other."""
    before = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    if tokenizer.normalizer or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(token)
    return sizes


def _in_order(first: list[bool], yes: list, no: list) -> list:
    some, others = iter(yes), iter(no)
    return [next(some) if f else next(others) for f in first]


class ChunkStore:
    """`value`: id_bytes or id_counts."""

    def __init__(self, path: str, value: Callable[[np.ndarray, np.ndarray], list], limit: int = 300_000, longest: int = 64) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.separator = next(((i, t.content) for i, t in added.items() if not (t.lstrip or t.rstrip or t.normalized or t.single_word)), None)
        self.sizes = _byte_sizes(self.tokenizer)
        self.merges = None  # the model alone, on words that are written in its characters with spaces between
        if self.sizes is not None and not any(_WORD.fullmatch(s) for s in self.special):
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.value, self.limit, self.longest = value, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def encode(self, texts: list[str]) -> list[Any]:
        """The values of whole texts, of many in one call."""
        if self.merges is None:
            return self._others(texts)
        single = [_WORD.fullmatch(t) is not None for t in texts]
        return _in_order(single, self._words([t for t, s in zip(texts, single) if s]), self._others([t for t, s in zip(texts, single) if not s]))

    def _others(self, texts: list[str]) -> list[Any]:
        joins = [self.sizes is not None and len(t) > 1 and t[0] == " " and not t[1].isspace() for t in texts]
        return _in_order(joins, self._joined([t for t, j in zip(texts, joins) if j]), self._separated([t for t, j in zip(texts, joins) if not j]))

    def _words(self, words: list[str]) -> list[Any]:
        """Of texts that are one word each: they need no pattern."""
        out: list[Any] = []
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            runs = ["\0".join(part[i : i + 1000]).encode().replace(b"\0", b"\xff") for i in range(0, len(part), 1000)]
            values = self._values(self.merges, [codecs.charmap_decode(r, "strict", _BYTE_CHARS)[0] for r in runs], part)
            out += self._others(part) if values is None else values
        return out

    def _values(self, tokenizer: Any, runs: list[str], part: list[str]) -> list[Any] | None:
        """The values of the texts in `part`, which `runs` has one after the other; None if a token goes over the end of one."""
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
        have, need = np.cumsum(self.sizes[ids]), np.cumsum([len(t.encode()) for t in part])
        ends = np.searchsorted(have, need) + 1
        if len(have) < ends[-1] or not np.array_equal(have[ends - 1], need):
            return None
        return self.value(np.insert(ids, ends[:-1], 0), ends[:-1] + np.arange(len(part) - 1))

    def _joined(self, texts: list[str]) -> list[Any]:
        """Of texts that a byte-level vocabulary cuts off from whatever is in front of them: they are put together
        as they are, and the tokens' bytes tell which of them are whose."""
        out: list[Any] = []
        for at in range(0, len(texts), 5000):
            part = texts[at : at + 5000]
            runs = ["".join(part[i : i + 100]) for i in range(0, len(part), 100)]
            values = None if any(s in r for s in self.special for r in runs) else self._values(self.tokenizer, runs, part)
            out += self._separated(part) if values is None else values
        return out

    def _separated(self, texts: list[str]) -> list[Any]:
        """Of any texts, a special string between them: special strings are found first, so what is between two
        of them is tokenised on its own."""
        out: list[Any] = []
        for at in range(0, len(texts), 5000):
            part = texts[at : at + 5000]
            if self.separator and not any(s in t for s in self.special for t in part):
                ids = self._ids(self.separator[1].join(part))
                out += self.value(ids, np.flatnonzero(ids == self.separator[0]))
            else:
                out += [self.value(self._ids(t), np.zeros(0, np.int64))[0] for t in part]
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def lookup(self, texts: list[list], text_of: Callable[[Any], str]) -> list[list]:
        """The values of all chunks of some texts."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = [list(map(young.get, chunks)) for chunks in texts]
        short = [i for i, values in enumerate(found) if None in values]
        new = {c for i in short for c, v in zip(texts[i], found[i]) if v is None}
        made = {c: old[c] for c in new if c in old} if old else {}
        todo = [c for c in new if c not in made]
        made.update(zip(todo, self.encode([text_of(c) for c in todo])))
        young.update((c, v) for c, v in made.items() if len(c) <= self.longest)
        for i in short:
            found[i] = [made[c] if v is None else v for c, v in zip(texts[i], found[i])]
        return found

    def each(self, chunks: list, text_of: Callable[[Any], str]) -> list[Any]:
        """The values of different chunks."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        values = list(map(self.young.get, chunks))
        gaps = [i for i, v in enumerate(values) if v is None]
        new = [chunks[i] for i in gaps]
        found = list(map(self.old.get, new))
        todo = [c for c, v in zip(new, found) if v is None]
        made = iter(self.encode(list(map(text_of, todo))))
        found = [next(made) if v is None else v for v in found]
        for i, v in zip(gaps, found):
            values[i] = v
        self.young.update((c, v) for c, v in zip(new, found) if len(c) <= self.longest)
        return values


def shared_store(path: str, value: Callable[[np.ndarray, np.ndarray], list]) -> ChunkStore:
    """One store per Python worker: the vocabulary is loaded once, and later tasks find their chunks known."""
    return held((path, value.__name__), lambda: ChunkStore(path, value))


def space_chunks(text: str, special: Iterable[str] = ()) -> list[str]:
    """Chunks for a byte-level vocabulary whose pattern binds one space to the word behind it: cut before
    every space that stands before a character that isn't white space. A text that holds a special
    string is one chunk, as special strings are found before the pattern is applied."""
    if any(s in text for s in special):
        return [text]
    if "\0" in text or _INNER_SPACE.search(text):
        return _BEFORE_WORD.split(text)
    return text.replace(" ", "\0 ").split("\0")  # every space begins a chunk


def byte_chunks(texts: pa.Array, special: Iterable[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """Chunks of many texts for the same vocabularies as `space_chunks`, as binary values, and each text's first chunk (then the
    number of all). A chunk begins at a space before a character that isn't white space, at an ASCII sign, tab or line end behind a
    letter or digit, and behind a single tab or line end. Letters are those of ASCII and Latin-1 here, as a place that isn't
    cut does no harm."""
    held_in = texts.cast(pa.large_binary())
    _, offsets, data = held_in.buffers()
    rows = np.frombuffer(offsets, np.int64)[held_in.offset : held_in.offset + len(held_in) + 1]
    size = int(rows[-1] - rows[0])
    if not size:
        return pa.array([], pa.large_binary()), np.zeros(len(rows), np.int64)
    data, rows = data.slice(int(rows[0]), size), rows - rows[0]
    text = np.frombuffer(data, np.uint8)
    kinds = _KINDS[text]
    begins = np.zeros(size + 1, bool)

    at = np.flatnonzero(text[:-1] == 32)
    after = kinds[at + 1]
    at, after = at[after & _WHITE == 0], after[after & _WHITE == 0]
    doubt = np.flatnonzero(after & _MAYBE_WHITE)
    if len(doubt):
        codes = sum(text[np.minimum(at[doubt] + i, size - 1)].astype(np.int64) << 8 * (3 - i) for i in (1, 2, 3))
        at = np.delete(at, doubt[np.isin(codes, _WIDE_WHITE) | np.isin(codes >> 8, [0xC285, 0xC2A0])])
    last = np.zeros(size, bool)
    last[rows[1:][rows[1:] > rows[:-1]] - 1] = True  # a text's last byte has nothing behind it
    begins[at[~last[at]]] = True

    at = np.flatnonzero(kinds[1:] & (_SIGN | _BREAK)) + 1
    worded = (kinds[at - 1] & _ALNUM > 0) | ((kinds[at - 1] & _SECOND > 0) & (text[at - 2] == 0xC3))
    begins[at[worded]] = True
    at = at[(kinds[at] & _BREAK > 0) & (worded | (kinds[at - 1] & _SIGN > 0)) & (at < size - 1)]
    begins[at[kinds[at + 1] & (_ALNUM | _SIGN | _LATIN) > 0] + 1] = True

    for s in special:
        for i in np.flatnonzero(pc.match_substring(held_in, s).to_numpy(zero_copy_only=False)):
            begins[rows[i] : rows[i + 1]] = False
    begins[rows] = True  # the end, too
    places = np.flatnonzero(begins)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), data])
    return chunks, np.searchsorted(places, rows)


def chunk_ids(store: ChunkStore, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks one after the other, and where each chunk's begin (then the number of all). `store` has id_bytes."""
    coded = chunks.dictionary_encode()
    values = store.each(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), bytes.decode)
    sizes, which = np.fromiter(map(len, values), np.int64, len(values)) // 4, coded.indices.to_numpy()
    ids, many = np.frombuffer(b"".join(values), "<u4"), sizes[which]
    ends = np.cumsum(many)
    places = np.repeat((np.cumsum(sizes) - sizes)[which] - ends + many, many)
    places += np.arange(len(places))
    return ids[places], np.concatenate(([0], ends))
