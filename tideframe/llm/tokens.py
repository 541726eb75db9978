"""Token ids of whole texts by a public tokenizer file, with ids of repeated units remembered.

A text is split at single spaces into units at whose ends the tokenizer always splits too, so the ids
of a text are those of its units, one after another. Units repeat far more than texts do; each
worker remembers the ids of those it has seen (a bounded number) and asks the library for new ones.
Units of ASCII and Latin-1 letters, digits and signs go straight to the library's BPE model; any
other unit, and any text whose white space could be split differently or that writes a special token out, goes through the
whole library tokenizer. tests/llm compares both ways on arbitrary text.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Units of more characters are not remembered.
LONG = 100
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How each kind of tokenizer file splits a unit of the plain characters.
_SPLIT = {
    "byte": re.compile(rf"{_ENDINGS}| ?[{LETTER}]+| ?[0-9]+| ?[^ \n{LETTER}0-9]+|\n"),
    "word": re.compile(rf"{_ENDINGS}|[{LETTER}]+|[0-9]|[^ {LETTER}0-9]+"),
}
#: A word and perhaps a sign after it, of which most units are.
_ENDS = ".,!?;:"
_WORD = {
    "byte": re.compile(rf"( ?[{LETTER}]+)([{_ENDS}]?)"),
    "word": re.compile(rf"([{LETTER}]+)([{_ENDS}]?)"),
}
_PLAIN = {
    "byte": re.compile(rf" ?[!-~{LETTER[6:]}]+(?:\n[!-~{LETTER[6:]}]+)*"),
    "word": re.compile(rf"[!-~{LETTER[6:]}]+"),
}
#: White space before and after a space, or a space at the end after white space: split differently in a unit.
_BETWEEN = re.compile(r"\s (?:\s|$)")


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that byte-level BPE writes for it: itself if printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitTokenizer:
    """Ids as bytes (`dtype`, little endian) of each text: those that the library gives with add_special_tokens=False."""

    def __init__(self, path: str, max_units: int = 200_000):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        #: Texts in which a special token is written out go through the library whole.
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = [p["type"] for p in (norm or {}).get("normalizers", [])]
        self.kind = None
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
        elif parts == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.kind = "word"
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.library.model, _byte_letters()
        self.packed = [np.array([i], self.dtype).tobytes() for i in range(self.library.get_vocab_size())]
        #: unit -> ids in two generations: what isn't asked for while max_units others come is forgotten.
        self.max_units, self.known, self.old = max_units, {}, {}
        if self.kind:
            self.split, self.plain, self.word = _SPLIT[self.kind].findall, _PLAIN[self.kind].fullmatch, _WORD[self.kind].fullmatch
            self.ends = {c: self._piece(c) for c in _ENDS}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of a piece of a plain unit, from the library's BPE model."""
        if piece.isascii():
            letters = piece.replace(" ", self.letters[0x20]).replace("\n", self.letters[0x0A])
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def _unit(self, unit: str) -> bytes:
        """Of a plain unit by its pieces, of another by the library."""
        if not unit:
            return b""
        if not self.plain(unit):
            return self.whole(unit)
        return b"".join(map(self._piece, self.split(unit.lower() if self.kind == "word" else unit)))

    def _learn(self, units: list[str]) -> None:
        """Ids of units that aren't known into self.known; a word with a sign after it by its word, which is a unit too."""
        known, old, lower = self.known, self.old, self.kind == "word"
        for u in units:
            if u in known:
                continue
            ids = old.get(u)
            if ids is None:
                m = self.word(u)
                if m is None:
                    ids = self._unit(u)
                else:
                    word, end = m.groups()
                    if lower:
                        word = word.lower()
                    ids = known.get(word)
                    if ids is None:
                        ids = old.get(word)
                        if ids is None:
                            ids = self._piece(word)
                        known[word] = ids
                    if end:
                        ids += self.ends[end]
            known[u] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind is None:
            return [self.whole(t) for t in texts]
        out = []
        for t in texts:
            if "\0" in t or self.kind == "byte" and _BETWEEN.search(t) or any(x in t or x in t.lower() for x in self.special if x[:2] in t):
                out.append(self.whole(t))
                continue
            if len(self.known) > self.max_units:
                self.known, self.old = {}, self.known
            units = t.replace(" ", "\0 ").split("\0") if self.kind == "byte" else t.replace("\n", " ").split(" ")
            ids = list(map(self.known.get, units))
            if None in ids:
                new = [i for i, x in enumerate(ids) if x is None]
                self._learn([units[i] for i in new])
                for i in new:
                    ids[i] = self.known[units[i]]
                for i in new:
                    if len(units[i]) > LONG:
                        self.known.pop(units[i], None)
            out.append(b"".join(ids))
        return out


_LOADED: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """One per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
