"""Token ids of whole texts with the tokenizers library, encoded once for each distinct pre-token.

Both vocabularies' pre-tokenizers cut a text by a pattern over letters, digits, white space and the rest, and merge within the
pieces alone. Over ASCII and the Latin-1 letters these classes are the same in every Unicode table and normalisation changes
nothing but case, so the pieces are cut here, where the kind of character changes, and the library encodes each distinct piece once. Of other texts, the parts between
white space are what is encoded once. Texts with white space outside ASCII or with the string of an added token are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

_PARTS = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
#: Texts of these characters alone have their pre-tokens cut here.
_LATIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The pre-tokenizers' patterns over these characters; fixed values of the vocabularies' files.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_KEEPS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_DROPS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
#: Kinds of Latin-1 characters: letters 1, digits 2, space 3, other white space 4, the rest 0.
_KIND = np.zeros(256, np.uint8)
_KIND[[i for i in range(256) if re.match(f"[{_LETTERS}]", chr(i))]] = 1
_KIND[48:58], _KIND[32], _KIND[9:14] = 2, 3, 4
#: Texts with one of these are cut by the pattern: contractions, and white space next to other white space but a line feed.
_CLOSE = ("'", "  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\x0b", "\x0c")
#: Characters of cached parts, and of texts that are encoded together.
_CACHED, _TOGETHER = 11_000_000, 1_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """path: a tokenizers JSON file. drops_space: its pre-tokenizer drops white space, so that parts need not carry it."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library turns the strings of added tokens into their ids wherever they stand, so texts that have one are encoded whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.size = self.tokenizer.get_vocab_size()
        self.drops_space = drops_space
        self.plain = re.compile(f"[{_LETTERS}]+" if drops_space else f" [{_LETTERS}]+")
        self.mark = "." if drops_space else "\n"
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Plain words go to the library as one text, with a mark between them whose one id no word has."""
        plain = [p for p in pieces if self.plain.fullmatch(p)]
        found: dict[str, bytes] = {}
        for a in range(0, len(plain), 256):
            some = plain[a : a + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id) if self.mark_id is not None else ()
            if len(ends) == len(some) - 1:
                data, ends = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
                found.update((p, data[4 * x + 4 : 4 * y]) for p, x, y in zip(some, ends[:-1], ends[1:], strict=True))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self._whole(rest), strict=True))
        return [found[p] for p in pieces]

    def _cut(self, text: str) -> list[str]:
        """The pre-tokens of a text of _LATIN, and perhaps empty ones."""
        if self.drops_space:
            text = text.lower()
            if "'" in text:
                return _DROPS.findall(text)
        elif text.endswith("\n\n") or any(x in text for x in _CLOSE):
            return _KEEPS.findall(text)
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
        kind = _KIND[data]
        new = np.zeros(len(data), bool)
        new[1:] = kind[1:] != kind[:-1]
        if self.drops_space:
            new |= kind == 2
            data = np.where(kind > 2, 0, data)
        else:
            new[1:] &= kind[:-1] != 3  # a space belongs to what follows
            new |= kind == 4
        out = np.zeros(len(data) + np.count_nonzero(new), np.uint8)
        out[np.arange(len(data)) + np.cumsum(new)] = data
        return out.tobytes().decode("latin-1").split("\0")

    def _group(self, texts: list[str]) -> list[bytes]:
        odd, parts = [], []
        for i, text in enumerate(texts):
            if self.added.search(text):
                odd.append(i)
                parts.append([])
            elif _LATIN.fullmatch(text):
                parts.append(self._cut(text))
            elif _ODD.search(text):
                odd.append(i)
                parts.append([])
            else:
                parts.append(text.split() if self.drops_space else _PARTS.findall(text))
        distinct = set().union(*parts)
        if self.held > _CACHED:  # what this group uses stays, which the common pieces do
            self.cache = {p: self.cache[p] for p in distinct if p in self.cache}
            self.held = sum(map(len, self.cache)) + 8 * len(self.cache)
        new = [p for p in distinct if p not in self.cache]
        if new:
            self.cache.update(zip(new, self._pieces(new), strict=True))
            self.held += sum(map(len, new)) + 8 * len(new)
        get = self.cache.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        group, n = [], 0
        for text in texts:
            group.append(text)
            n += len(text)
            if n >= _TOGETHER:
                yield from (np.frombuffer(b, "<u4") for b in self._group(group))
                group, n = [], 0
        yield from (np.frombuffer(b, "<u4") for b in self._group(group))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder for each Python worker."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return _ENCODERS[path, drops_space]
