"""Token ids of whole texts by the byte-level BPE of the ``tokenizers`` library.

The library spends most of its time on words it has met before, so every task
keeps what it returned: chunks (a space and what follows up to the next space)
and the pre-tokens inside them.  A pre-token that is new goes through the
library's BPE model; texts with special tokens, with runs of spaces that a
chunk would cut, or with unusual white space go through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Id appended to every document.
END_ID = 0
#: Entries of a cache (some 170 bytes each).
CACHE = 600_000
#: Longer strings than this are encoded without being kept.
LONGEST = 40


def default_path() -> str:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Encoder(dict):
    """Encodes texts to ids as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The dict holds the packed ids of chunks and pre-tokens; when it is full, it begins anew.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # white space that regular expression engines class differently
        self.odd = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]").search
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.space = self.letters[0x20]

    def _model(self, piece: str) -> bytes:
        """The ids of one pre-token, by the library's model."""
        return array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        rest = chunk[1:]
        if rest.isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            # no white space and no sign but the first: most of what is new
            got = array("I", [t.id for t in self.tokenize(self.space + rest if chunk[0] == " " else chunk)]).tobytes() if chunk.isascii() else self._model(chunk)
        elif len(chunk) == 1:
            got = self._model(chunk)
        elif not chunk:
            got = b""
        elif chunk[-1] in ".," and rest[:-1].isalpha() and chunk[0] == " ":
            got = self[chunk[:-1]] + self[chunk[-1]]
        else:
            parts = self.split(chunk)
            got = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else self._model(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, the end id last; null counts as empty."""
        if not text:
            return b"\0\0\0\0"
        if "  " in text or "\0" in text or self.odd(text) or any(s in text for s in self.special):
            return np.array([*self.whole.encode(text, add_special_tokens=False).ids, END_ID], "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0"))) + b"\0\0\0\0"


_OPEN: dict[str, Encoder] = {}


def forget() -> None:
    """Drops this process's encoders and all they kept."""
    _OPEN.clear()


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; its caches live as long as the worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
