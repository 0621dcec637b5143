"""Token ids of whole texts by the installed ``tokenizers`` library, with a cache of pieces between blanks.

A blank between two characters that are not white space always ends a piece of
pre-tokenization for both vocabularies used here, so the ids of a text are the
ids of its pieces one after the other. Texts with any other white-space pattern
go to the library whole. A piece of Latin letters, with ASCII marks after them
perhaps, goes to the library's model at once, as its normalizer and pre-tokenizer
would pass it on; any other piece goes through the whole tokenizer. Ids come as
little-endian unsigned 32-bit bytes. ``encode_column`` does the same for a column
of texts at once, in finer parts, and gives arrays.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges, slices, text_bytes

#: Ids put in place at a time; only memory and time depend on it.
PLACED = 1 << 16
#: Pieces in each of the two generations a worker keeps. Only memory and time depend on it.
CACHE_ENTRIES = 400_000
#: White space other than single blanks and line ends between words.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: What sends a text to the library whole, where blanks count: special strings, NUL, and blanks and line ends that are not single between other characters.
_WHOLE = r"<\||\x00|[ \n][ \n]|\A[ \n]|[ \n]\z|" + _ODD.pattern
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Up to here letters and their lower case are the same in every version of Unicode since 5.
_LATIN = "ɏ"
#: Kinds of bytes for ``part_starts``; _LEAD begins the two bytes of a character from U+00C0 to U+023F.
_MARK, _LETTER, _LEAD, _BLANK, _LINE = range(1, 6)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in _MARKS if c != "'"]] = _MARK
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[0xC3:0xC9] = _LEAD
_KINDS[[32, 10]] = _BLANK, _LINE


class _Known(dict):
    """Ids by piece; the older generation is asked before the library."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        self[piece] = ids = self.learn(piece) if ids is None else ids
        return ids

    def age(self, entries: int) -> None:
        """Make a generation of more than ``entries`` the older one."""
        if len(self) > entries:
            self.older = dict(self)
            self.clear()


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of UTF-8 texts begin, at places that always end a piece of byte-level pre-tokenization.

    These are blanks, line ends and what follows them, and ASCII marks after a Latin letter, but
    for the apostrophe, which may begin a contraction. In the texts blanks and line ends must stand alone.
    """
    start = np.zeros(len(data) + 1, bool)
    kind = _KINDS[data]
    start[:-1] = kind >= _BLANK
    start[1:] |= kind == _LINE
    letter = kind == _LETTER
    letter[1:] |= (kind[:-1] == _LEAD) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # but for the signs of multiplication and division
    start[1:-1] |= letter[:-1] & (kind[1:] == _MARK)
    start[offsets] = True
    start[-1] = False
    return np.flatnonzero(start)


class TokenCache:
    """Token ids of texts by the vocabulary file at ``path``."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.entries = self.tokenizer.model.tokenize, entries
        self.drops_space = self._ids("a b") == self._ids("a  b")
        letters = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # How the library writes the bytes that texts hold: learned from its own pre-tokenizer.
        self.written = {c: "".join(x for x, _ in letters(c)) for c in map(chr, range(33, 0x250)) if c.isalpha()}
        self.blank = "" if self.drops_space else letters(" a")[0][0][:-1]
        # A line end is a piece of its own before a letter, or else what begins with one goes to the library whole.
        self.line = self._bytes("\n") if not self.drops_space and [x for x, _ in letters("\na")] == [letters("\n")[0][0], "a"] else None
        self.known = _Known(self._learn)
        self.parts = _Known(self._part)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _model(self, text: str) -> bytes:
        return array("I", [t.id for t in self.cut(text)]).tobytes()

    def _learn(self, piece: str) -> bytes:
        """Ids of a piece with the blank before it; one that begins with a line end or, to say that nothing is before it, with NUL has none."""
        if piece.isascii() and piece.isalpha():
            return self._model(self.blank + (piece.lower() if self.drops_space else piece))
        lead = piece[:1]
        if lead == "\0" or lead == "\n" and self.line is not None:
            rest = piece[1:]
            core = rest.rstrip(_MARKS)
            if not self._latin(core):
                return self._bytes(rest if lead == "\0" else piece)
            ids = self._model(self._shown(core)) + (self.known["\0" + rest[len(core) :]] if len(core) < len(rest) else b"")
            return ids if lead == "\0" else self.line + ids
        core = piece.rstrip(_MARKS)
        if self._latin(core):
            if len(core) < len(piece):
                return self.known[core] + self.known["\0" + piece[len(core) :]]
            return self._model(self.blank + self._shown(core))
        return self._bytes(piece if self.drops_space or lead == "\n" else " " + piece)

    def _latin(self, core: str) -> bool:
        """Whether the model may be asked at once: letters that every version of Unicode writes alike."""
        return core.isalpha() and (core.isascii() or max(core) <= _LATIN and (not self.drops_space or max(core.lower()) <= _LATIN))

    def _shown(self, core: str) -> str:
        """Latin letters as the model reads them."""
        shown = core.lower() if self.drops_space else core
        return shown if shown.isascii() else "".join(map(self.written.__getitem__, shown))

    def _part(self, part: str) -> bytes:
        """Ids of a part of a text as ``part_starts`` cuts it, with the blank it begins with, if any."""
        blank, core = (self.blank, part[1:]) if part[0] == " " else ("", part)
        if core.isascii() and core.isalpha():
            return self._model(blank + core)
        return self._model(blank + self._shown(core)) if self._latin(core) else self._bytes(part)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column one after the other, and the number of each text's ids; null counts as empty.

        The same ids as by ``encode``. Where blanks count, Arrow finds the different parts of all
        texts, so that a part is looked up once however often the column has it, and letters and
        the marks after them are parts of their own, so that there are fewer to learn.
        """
        texts = pc.fill_null(texts, "")
        plain = self.line is not None and self.tokenizer.normalizer is None
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) if plain else np.ones(len(texts), bool)
        data, offsets = text_bytes(texts.filter(pa.array(~whole)))
        starts = part_starts(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        parts = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        which = parts.indices.to_numpy()
        self.parts.age(self.entries)
        found = list(map(self.parts.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)))
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(size[which])))  # of the parts' ids
        ids = np.empty(int(ends[-1]), np.uint32)
        for a, b in slices(ends, PLACED):
            some = which[a:b]
            ids[ends[a] : ends[b]] = flat[ranges(begin[some], size[some])]
        counts = np.zeros(len(texts), np.int64)
        counts[~whole] = np.diff(ends[np.searchsorted(starts, offsets)])
        alone = np.flatnonzero(whole)
        if len(alone):
            own = [np.frombuffer(code, "<u4") for code in self.encode([texts[i].as_py() for i in alone.tolist()])]
            places, more = np.cumsum(counts)[alone], np.array([len(x) for x in own])  # places among the others' ids
            counts[alone] = more
            ids = np.insert(ids, np.repeat(places, more), np.concatenate(own))
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        known, out = self.known, []
        known.age(self.entries)
        find = known.__getitem__
        for text in texts:
            if not text or "<|" in text or "\0" in text:  # special strings may be cut otherwise
                out.append(self._bytes(text) if text else b"")
            elif self.drops_space:
                out.append(b"".join(map(find, text.replace("\n", " ").split(" "))))
            elif "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or not text.replace("\n", "").isprintable() and _ODD.search(text):  # printable: no other white space, which takes less time to see
                out.append(self._bytes(text))
            else:
                out.append(b"".join(map(find, ("\0" + text.replace("\n", " \n")).split(" "))))
        return out


@lru_cache(maxsize=4)
def token_cache(path: str, entries: int = CACHE_ENTRIES) -> TokenCache:
    """The worker's cache for the vocabulary file at ``path``."""
    return TokenCache(path, entries)
