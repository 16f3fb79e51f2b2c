"""Byte-level BPE with the tokenizers library, remembering the ids of words.

The pre-tokenizer of byte-level BPE never joins two pre-tokens over a single space or newline that stands between two
non-space characters, so a text can be cut there and its parts encoded apart with equal ids. Most words of a corpus
recur; each worker encodes a word once while its memory of words lasts.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

import numpy as np

#: A place where cutting is safe in any text. (\x1c-\x1f are white space to Python only, and never cut at.)
_CUT = re.compile(r"(?<=[^\s])(?=[ \n][^\s])")
#: White space but a space or newline.
_OTHER = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile(r"\s")

_ENCODERS: dict[tuple[str, int, int], "WordCachedEncoder"] = {}


def uneven(text: str) -> bool:
    """Whether spaces or newlines stand side by side or at an end of a text that isn't empty."""
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n "))


class WordCachedEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in bytes.

    ``max_words`` bounds the memory: when it is full, no more words are kept (frequent ones come early). Words of over
    ``max_chars`` characters are never kept. Words to be encoded are handed to the library in one text, a line each.
    """

    def __init__(self, path: str, max_words: int = 800_000, max_chars: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words, self.max_chars = max_words, max_chars
        self.newline = self._ids("\n")
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, max_words: int = 800_000, max_chars: int = 48) -> "WordCachedEncoder":
        """One encoder for a Python worker, kept over its tasks."""
        key = (path, max_words, max_chars)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(*key)
        return _ENCODERS[key]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words after a space, or after the newline they begin with."""
        ids = np.frombuffer(self._ids("\n".join([w[1:] if w[0] == "\n" else " " + w for w in words])), "<u4")
        ends = [*(4 * np.flatnonzero(ids == int.from_bytes(self.newline, "little"))).tolist(), 4 * len(ids)]
        data, out, at = ids.tobytes(), {}, 0
        for w, end in zip(words, ends, strict=True):
            out[w] = self.newline + data[at:end] if w[0] == "\n" else data[at:end]
            at = end + 4
        return out

    def _join(self, parts: list[str]) -> bytes:
        known = self.words
        missing = [w for w in parts if w not in known]
        if missing:
            new = self._new(list({*missing}))
            kept = ((w, x) for w, x in new.items() if len(w) <= self.max_chars)
            known.update(islice(kept, self.max_words - len(known)))
            if len(known) == self.max_words or max(map(len, new)) > self.max_chars:  # not all of them are kept
                return b"".join([known.get(w) or new[w] for w in parts])
        return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if uneven(text) or _OTHER.search(text):
            first, *rest = _CUT.split(text)
            out = [self._ids(first)]
            run: list[str] = []
            for x in rest:
                if _SPACE.search(x, 1):  # other white space inside: encoded by itself
                    out += [self._join(run), self._ids(x)]
                    run = []
                else:
                    run.append(x if x[0] == "\n" else x[1:])
            return b"".join([*out, self._join(run)])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._ids(first) + self._join(rest)
