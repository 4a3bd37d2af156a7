"""Token ids of whole texts by a public word-BPE vocabulary, remembered by word.

The vocabulary's rule drops white space before anything else and never joins across it, so a text's ids are its words'
ids in order; a word's are those of its letter runs, digits and punctuation runs. Special-token strings in a text
keep the library's own reading: words that hold one go to the library whole.
"""

from __future__ import annotations

import unicodedata
from array import array

#: Words and units remembered by a Python worker before it starts anew.
REMEMBERED = 400_000
_encoders: dict[str, WordEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        # A fixed value: the vocabulary's own splitting pattern.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.words: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def unit(self, u: str) -> bytes:
        found = self.units.get(u)
        if found is None:
            if len(self.units) >= REMEMBERED:
                self.units.clear()
            shown = u if u.isascii() and u.isprintable() else u.encode().decode("latin-1").translate(self.letters)
            found = self.units[u] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def word(self, w: bytes) -> bytes:
        if b"<|" in w:
            return array("I", self.whole.encode(w.decode(), add_special_tokens=False).ids).tobytes()
        if w.isascii():
            low = w.lower().decode()
        else:
            low = "".join([c.lower() for c in unicodedata.normalize("NFC", w.decode())])
        if low.isalpha():
            return self.unit(low)
        if low[:-1].isalpha() and not low[-1].isspace():
            return self.unit(low[:-1]) + self.unit(low[-1])
        return b"".join([self.unit(u) for u in self.split(low)])

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        words = (text or "").encode().split()
        known = self.words
        for w in set(words).difference(known):
            known[w] = self.word(w)
        ids = b"".join([known[w] for w in words])
        if len(known) > REMEMBERED:
            known.clear()
        return ids


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
