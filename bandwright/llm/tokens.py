"""Token ids of whole texts by the tokenizers library, with its work done once for each distinct word.

Both vocabularies split a text into pieces and merge inside a piece alone, so the ids of a text are those of
its pieces one after another.  A text is cut at blanks (where a piece always ends), each distinct part
is encoded once by the library, and the ids are kept in a bounded table of the worker.  Texts or parts of
which this does not hold beyond doubt (two white-space characters together, letters outside Latin) go
through the library's whole encode.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex

from .common import kept

# fixed values: the published pattern by which the byte-level vocabulary's pieces are split
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# fixed values: the published pattern of the word vocabulary's pieces
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile("[\x00-įı-ɏ]*").fullmatch
_RUN = re.compile(r"\s\s").search
#: Finds a mark before a blank that is in one piece with what stands before it, among plain characters.
_JOINED = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x250)) if not (c.isalnum() or c.isspace()))) + "][.,] ").search

#: Finds a mark before a blank that follows no letter or digit, among plain characters.
_LOOSE = re.compile("[.,] (?<=[^" + "".join(c for c in map(chr, range(0x250)) if c.isalnum()) + "][.,] )").search

#: Each Latin-1 character's kind: d for a mark that is a part of its own before a blank, m for other marks, a blank, x for the rest.
_KINDS = bytes(ord("d" if c in ".," else " " if c in " \n" else "x" if c.isalnum() or c.isspace() else "m") for c in map(chr, range(0x100)))

#: Marks that are one piece of the word vocabulary where they stand together after letters.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"

#: White space beside blanks and line ends, among plain characters.
_RARE = "".join(c for c in map(chr, range(0x250)) if c.isspace() and c not in " \n")


def _plain(text: str) -> tuple[bool, bytes]:
    """Whether _PLAIN(text), which scans only what has letters outside Latin-1, and the text's bytes if it has none."""
    try:
        return True, text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_PLAIN(text)), b""


def _joined(text: str, latin: bytes) -> bool:
    """_JOINED(text) for a text whose line ends are blanks already; latin: its bytes in Latin-1, or none."""
    if not latin:
        return bool(_JOINED(text))
    kinds = latin.translate(_KINDS)
    return b"md " in kinds or b"dd " in kinds


def _runs(text: str, plain: bool) -> bool:
    """_RUN(text), which scans a plain text only if it has rare white space."""
    if not plain or any(c in text for c in _RARE):
        return bool(_RUN(text))
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
#: The letters of each plain character's UTF-8 bytes.
_TO_LETTERS = {c: "".join(_LETTERS[b] for b in chr(c).encode()) for c in range(0x250)}


class Encoder(dict):
    """Ids of texts.  kind: "byte" (byte_bpe) or "word" (word_bpe).  most: parts that the table may hold.

    The table (the dict itself) has the ids of each part as bytes; a part stands for itself after a blank, but one
    that begins with a line end or, for "byte", with the character 0 (a mark after a word) for what follows.  When
    the table is half full, a new one begins and takes over from the one before what comes again.
    """

    def __init__(self, path: str, kind: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.byte, self.most = kind == "byte", most
        self.old: dict[str, bytes] = {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.end = {m: self._encoded(m) for m in ".,"}
        self.line = self._encoded("\n") if self.byte else b""

    def _encoded(self, part: str) -> bytes:
        """Ids of one part; for "byte" the part begins as it does in the text (with its blank)."""
        tokenize, word = self.model.tokenize, part[1:] if self.byte else part
        if not (part.isascii() or _PLAIN(part)):
            return array("i", self.whole.encode(part, add_special_tokens=False).ids).tobytes()
        if self.byte:
            pieces = [part] if part[:1] == " " and word.isalpha() else BYTE_PIECES.findall(part)
        else:
            part = part.lower()
            pieces = [part] if part.isalpha() else WORD_PIECES.findall(part)
        return array("i", [t.id for p in pieces for t in tokenize(p.translate(_TO_LETTERS))]).tobytes()

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None and not self.byte:
            if part.isalpha() and (part.isascii() or _PLAIN(part)):  # one piece; ASCII letters stand for themselves
                low = part.lower()
                got = array("i", [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(_TO_LETTERS))]).tobytes()
            # a mark joins a letter that lower-casing or the library may end in a combining mark: only plain ones are parted
            elif (word := part.rstrip(_MARKS)) != part and word.isalpha() and _PLAIN(part):
                return self[word] + self[part[len(word) :]]
            else:
                got = self._encoded(part)
        elif got is None:
            if part.isalpha() and (part.isascii() or _PLAIN(part)):  # one piece; ASCII letters stand for themselves
                got = array("i", [t.id for t in self.model.tokenize("\u0120" + (part if part.isascii() else part.translate(_TO_LETTERS)))]).tobytes()
            elif part[-1:] in self.end and part[-2:-1].isalpha() and _PLAIN(part):
                return self[part[:-1]] + self.end[part[-1]]
            elif part[:1] == "\n" and part[1:].isalpha() and _PLAIN(part):
                got = self.line + array("i", [t.id for t in self.model.tokenize(part[1:].translate(_TO_LETTERS))]).tobytes()
            elif part[:1] == "\0":
                got = self.end[part[1]]
            else:
                got = self._encoded(part if part[:1] == "\n" else " " + part)
        if 2 * len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[part] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, as the library's encode gives them without special tokens."""
        plain, latin = _plain(text)
        if any(s in text for s in self.special) or (self.byte and ("\0" in text or _runs(text, plain))):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
        text = text.replace("\n", " \n" if self.byte else " ")
        if plain and not (_LOOSE(text) if self.byte else _joined(text, latin)):  # marks are parts of their own
            text = text.replace(". ", " \0. ").replace(", ", " \0, ") if self.byte else text.replace(". ", " . ").replace(", ", " , ")
        parts = text.split(" ")
        first = self._encoded(parts.pop(0)) if self.byte else b""
        return np.frombuffer(first + b"".join(map(self.__getitem__, parts)), np.int32)


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder of this vocabulary, kept between tasks."""
    return kept(("encoder", path, kind), lambda: Encoder(path, kind))
