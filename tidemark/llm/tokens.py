"""Token ids of whole texts with a published vocabulary, one white-space word at a time.

The vocabulary's splitting pattern never joins characters across white space, and its normal form
(NFC, lower case) leaves ASCII white space where it is. So the ids of a text are those of its words one
after the other, and each distinct word is encoded once per worker. Long words aren't remembered.
"""

from __future__ import annotations

import os
from itertools import chain
from unicodedata import is_normalized

import pyarrow as pa

from .scratch import flat

VOCABULARY = "word_bpe_49k.json"
#: Words met twice that a worker remembers, words met once, and the longest one, in bytes.
MOST_WORDS, MOST_NEW, LONGEST_WORD = 400_000, 100_000, 48
#: ASCII marks that the pattern keeps together (the apostrophe starts units of its own).
_MARKS = ".,;:!?\"()[]{}<>/\\|@#$%^&*-_=+~`"
#: Letters whose lower case depends on what stands around them or has two characters.
_ODD = frozenset("\u03a3\u0130")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes by words. Plain words skip the general pipeline: their letters, lower-cased, are one unit of
    the pattern, and so are the ASCII marks behind them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.fresh: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model

    def _unit(self, unit: str) -> bytes:
        """Ids of one unit of the pattern, through the vocabulary's byte alphabet."""
        found = self.model.tokenize(unit.encode("utf-8").decode("latin-1").translate(_ALPHABET))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        rest = []
        for word in words:
            text = word.decode("utf-8")
            letters = text.rstrip(_MARKS)
            if letters.isalpha() and not _ODD.intersection(letters) and (text.isascii() or is_normalized("NFC", letters)):
                into[word] = self._unit(letters.lower()) + (self._unit(text[len(letters) :]) if len(letters) < len(text) else b"")
            else:
                rest.append(word)
        for word, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in rest], add_special_tokens=False), strict=True):
            into[word] = b"".join([i.to_bytes(4, "little") for i in e.ids])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split() for t in texts]
        seen = set(chain.from_iterable(split)).difference(self.known)
        again = seen.intersection(self.fresh)
        if len(self.known) + len(again) > MOST_WORDS:
            self.known.clear()
            seen = set(chain.from_iterable(split))
        self.known.update((w, self.fresh.pop(w)) for w in again)
        if len(self.fresh) > MOST_NEW:
            self.fresh.clear()
        own: dict[bytes, bytes] = {}
        self._learn([w for w in seen if w not in self.known], own)
        self.fresh.update((w, own[w]) for w in own if len(w) <= LONGEST_WORD)
        known = self.known
        return [b"".join([known[w] if w in known else own[w] for w in ws]) for ws in split]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = VOCABULARY) -> WordEncoder:
    """The worker's own encoder; found by name on the worker, as each machine has its own files."""
    path = name if os.path.sep in name else vocabulary_path(name)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_ids(column: pa.Array, name: str = VOCABULARY) -> list[bytes]:
    data, at = flat(column)
    held, at = data.tobytes(), at.tolist()
    return encoder(name).encode([held[a:b] for a, b in zip(at, at[1:])])
