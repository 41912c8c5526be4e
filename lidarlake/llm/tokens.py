"""Token ids from public tokenizers, fast: words are encoded once and remembered."""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

#: White space beside a space: only then a space may not open a token.
_BESIDE = (re.compile(r" \s").search, re.compile(r"\s ").search)
#: White space of Latin-1 but for the space and the line feed, and the pairs of those two that hold a space.
_ODD_SPACES, _TWO_SPACES = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0", ("  ", " \n", "\n ")
_AT_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: A space at most, Latin-1 letters (no composition or unusual case can touch them), ASCII punctuation at most.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level models name bytes by printable characters: those that are printable, then the rest from U+0100 on.
_BYTE_NAMES = str.maketrans({b: chr(b) for b in _SHOWN} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))})


_SPACE_NAME = " ".translate(_BYTE_NAMES)


#: Marks of pieces met once, by hash.
_SEEN = 1 << 22


class Encoder(dict):
    """text -> ids as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode`` without special tokens.

    A text is cut before each single space that stands between two other characters, and at single line ends. No token of the
    tokenizers used here crosses such a place (``word_bpe``: white space is dropped, so it is cut at all spaces; ``byte_bpe``: a space
    opens the next token), so ids of the pieces can be kept and joined: the encoder is the dictionary of the pieces that
    it knows, in two bytes an id where the vocabulary allows. A new piece that is a plain word goes
    straight to the tokenizer's model; any other takes the tokenizer's whole way. A piece is kept when it is met again. At
    most 2 * ``most`` pieces are kept: the older half is forgotten, but for what was used since. Special tokens' strings in a text are
    ordinary text.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        kinds = b"".join(part.__getstate__() for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer) if part).decode()
        self.plain = type(self.model).__name__ == "BPE" and "ByteLevel" in kinds
        self.lower = "Lowercase" in kinds  # such a tokenizer also drops white space
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.type = ("u2", "H") if self.narrow else ("u4", "I")
        self.most, self.old, self.seen = most, {}, bytearray(_SEEN)

    def _part(self, space: str, part: str) -> bytes:
        """Ids of a run of letters or of marks, with the space before it, if the tokenizer keeps that."""
        if self.lower:
            space, part = "", part.lower()
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array(self.type, [t.id for t in self.model.tokenize(_SPACE_NAME + part if space else part)]).tobytes()

    def __missing__(self, x: str) -> bytes:
        ids = self.old.get(x)
        if ids is None:
            if self.plain and (m := _PLAIN.fullmatch(x)):
                space, letters, marks = m.groups()
                if marks:  # the bare word and the marks may be known
                    ids = self[space + letters] + (self[marks] if len(marks) == 1 else self._part("", marks))
                else:
                    ids = self._part(space, letters)
            elif (k := x.find("\n")) > 0 and k + 1 < len(x) and not x[k - 1].isspace() and not x[k + 1].isspace():
                ids = self[x[:k]] + self["\n"] + self[x[k + 1 :]]  # a line's end between two words is a token of its own, or none
            else:
                ids = array(self.type, self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        k = hash(x) & (_SEEN - 1)
        if self.seen[k]:  # met before: most pieces are never met again, and those are not worth a place
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                self.seen = bytearray(_SEEN)
            self[x] = ids
        else:
            self.seen[k] = 1
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            raw = text.encode("latin-1")
            flat = len(raw) == len(raw.translate(None, _ODD_SPACES))
        except UnicodeEncodeError:
            flat = False
        if self.lower:  # white space is in no token; Latin-1 has no marks to compose, and one way to lower a letter
            pieces = (text.lower() if flat else text).replace("\n", " ").split(" ")
        elif "\0" in text or (any(x in text for x in _TWO_SPACES) if flat else any(beside(text) for beside in _BESIDE)):
            pieces = _AT_SPACE.split(text)
        elif flat and "\n\n" not in text:  # each line's end is between two words, and a token of its own
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            pieces = text.replace(" ", "\0 ").split("\0")
        raw = b"".join(map(self.__getitem__, pieces))
        return np.frombuffer(raw, self.kind).astype("<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a tokenizer: reused Python workers keep what they know from task to task."""
    if path not in _ENCODERS:
        gc.set_threshold(100_000)  # what is kept are strings and bytes: nothing to collect
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
