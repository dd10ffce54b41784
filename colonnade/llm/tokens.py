"""Token ids of whole texts, with a bounded cache of encoded words.

The ids are the ``tokenizers`` library's own: a text is cut only at single spaces and
line breaks between two non-white characters, where neither of the supported pre-tokenizers
(byte-level with its usual pattern; word patterns that drop white space) can have a
piece that crosses, so the pieces' ids joined are the text's ids.  A word of Latin-1
letters, with punctuation marks (``_MARKS``) after it, is the two pieces the
patterns make of it, which the library's model encodes without the steps before it.
"""

from __future__ import annotations

import os
import re
import struct

#: White space beside a space may join it in one piece; such texts are cut more carefully.
_WHITE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_WHITE = "\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: No apostrophe, which may begin a piece with letters, and no "_", which word patterns count among letters.
_MARKS = ".,!?;:$%&#*"
#: Packs so many ids, of the usual words.
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as its Latin-1 character, the others as U+0100 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, with ``before`` in front of it.

    A cache of more than half of ``most`` words takes a word at its second sight only (the
    first marks a place in a bit table).
    """

    def __init__(self, tok, before: str, lower: bool, most: int):  # noqa: ANN001
        self.tok, self.model, self.before, self.lower, self.most = tok, tok.model, before, lower, most
        self.letters = _byte_letters()
        self.space = self.letters[32] if before else ""
        self.tokenize, self.half = tok.model.tokenize, most // 2
        self.marks: dict[str, bytes] = {}
        self.seen = bytearray(1 << 21)

    def start_anew(self) -> None:
        self.clear()
        self.marks.clear()
        self.seen = bytearray(1 << 21)

    def encode(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        base = word.rstrip(_MARKS)
        if base.isalpha() and (base.isascii() or max(base) <= "\xff"):
            marked = len(base) < len(word)
            out = self.get(base) if marked else None
            if out is None:
                piece = base.lower() if self.lower else base
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.tokenize(self.space + piece)]
                out = _PACKS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)
            if marked:
                tail = word[len(base) :]
                if tail not in self.marks:
                    if len(self.marks) >= self.half:
                        self.marks.clear()
                    self.marks[tail] = self.encode(tail)
                out += self.marks[tail]
        else:
            out = self.encode(self.before + word)
        if len(self) < self.half:
            self[word] = out
            return out
        h = hash(word) & 0xFFFFFF
        bit = 1 << (h & 7)
        if self.seen[h >> 3] & bit:
            self[word] = out
        else:
            self.seen[h >> 3] |= bit
        return out


class WordCache:
    """``ids(text)`` through caches of at most ``most`` words.

    ``spaced``: a word's ids depend on whether a space stands before it, and a single line
    break is a piece of its own (byte-level vocabularies); otherwise white space only parts
    words.  ``lower``: the tokenizer lower-cases.
    """

    def __init__(self, path: str, spaced: bool, lower: bool, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.most = spaced, most
        self.inner = _Words(tok, " " if spaced else "", lower, most)
        self.heads = _Words(tok, "", lower, max(2, most // 4)) if spaced else self.inner
        self.line = self.inner.encode("\n") if spaced else b""

    def ids(self, text: str) -> bytes:
        for words in (self.inner, self.heads):
            if len(words) > words.most:
                words.start_anew()
        get = self.inner.__getitem__
        if "  " in text or " \n" in text or "\n " in text or any(map(text.__contains__, _WHITE)) or not text.isascii() and any(map(text.__contains__, _WIDE_WHITE)):
            words = _CUT.split(text)
            return self.heads[words[0]] + b"".join(map(get, words[1:]))
        if not self.spaced:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if "\n\n" in text:
            words = text.split(" ")
            return self.heads[words[0]] + b"".join(map(get, words[1:]))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.heads[words[0]] + b"".join(map(get, words[1:])) if len(words) > 1 else self.heads[line])
        return self.line.join(lines)


_caches: dict[tuple[str, bool, bool], WordCache] = {}


def worker_cache(path: str, spaced: bool, lower: bool) -> WordCache:
    """This worker process's cache, which its later tasks use too."""
    key = (path, spaced, lower)
    if key not in _caches:
        _caches[key] = WordCache(*key)
    return _caches[key]
