"""Token ids of a word-level BPE tokenizer file, with a cache of white-space words.

The tokenizer's pre-tokens never span white space and white space itself has no id, so the ids
of a text are the ids of its white-space words in order. Words that are not in the cache are
cut into pre-tokens, which have a cache of their own.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

from .common import resident

assert array("I").itemsize == 4 and sys.byteorder == "little"

#: Characters at which str.split() splits and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]").search


#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


class WordEncoder(dict):
    """Word -> ids as little-endian unsigned 32-bit bytes. Holds at most ``3 * most`` entries."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.find = None
        if norms == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"]:
            self.find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.model = self.tokenizer.model
        self.most, self.old, self.parts = most, {}, {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # Below the combining marks a text is in composed form already. Pre-tokens go to the
            # BPE model alone, far cheaper than a whole encoding, which other words take.
            if self.find is None or not (word.isascii() or max(word) < "\u0250") or any(s in word for s in self.special):
                ids = self._whole(word)
            else:
                parts, out = self.parts, []
                for p in self.find(word.lower()):
                    x = parts.get(p)
                    if x is None:
                        x = array("I", [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_BYTES))]).tobytes()
                        parts[p] = x
                    out.append(x)
                ids = b"".join(out)
        self[word] = ids
        return ids

    def rest(self) -> None:
        """Between tasks only the newer words and the pre-tokens stay."""
        self.old = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        if len(self.parts) > self.most:
            self.parts.clear()
        get = self.__getitem__
        return [self._whole(t) if _ODD(t) else b"".join(map(get, t.split())) for t in texts]


def encoder(path: str) -> WordEncoder:
    """This worker process's encoder of ``path``."""
    return resident(("words", path), lambda: WordEncoder(path))
