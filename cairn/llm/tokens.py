"""Encoding of whole texts by public tokenizers, with a bounded memory of pieces already encoded.

Texts are cut where each tokenizer's own rules always cut, so joined pieces equal
the encoding of the whole text; a piece seen before is not encoded again. Pieces of a group of texts are
numbered by Arrow and their ids gathered by numpy: only distinct pieces are Python objects.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa

#: Pieces remembered by an encoder of a Python worker; its memory is emptied when full.
MEMORY = 400_000
#: Longer pieces are encoded anew each time.
LONGEST = 48
#: Characters of texts handled at once.
GROUP = 2_000_000

_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_workers: dict = {}


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _bytes_in(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
_LETTER = _bytes_in(string.ascii_letters.encode())
_UPPER = _bytes_in(string.ascii_uppercase.encode())
#: Without |, which ends the name of a special token.
_MARK = _bytes_in(b".,!?;:#$%&*")


def piece_starts(data: np.ndarray, begins: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces start in the bytes of joined texts, which themselves start at begins.

    The tokenizers' patterns always begin a match at a mark behind a letter. One that drops white space is cut at every space
    too. In byte-level patterns a word takes the one space before it: they are cut at a space between two non-space characters,
    which begins a match, and around such a line end, which is one.
    """
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = _MARK[data[1:]] & _LETTER[data[:-1]]
    if spaced:
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        for m in _WIDE_SPACE.finditer(data) if data.max(initial=0) > 0x7F else ():
            solid[m.start() + 1 : m.end() + 1] = False
        before, behind = solid[:-2].copy(), solid[2:].copy()
        inner = begins[begins < len(data)]
        before[inner], behind[inner - 1] = False, False
        between = before & behind
        starts[:-1] |= between & (data == 0x20)
        line = between & (data == 0x0A)
        starts[:-1] |= line
        starts[1:] |= line
    else:
        starts[:-1] |= data == 0x20
    starts[begins] = True
    starts[-1] = False
    return np.flatnonzero(starts)


class PieceEncoder:
    """encode_new: distinct unknown pieces -> the ids of each, as little-endian unsigned 32-bit integers.

    spaced: pieces have the space before them as part; else white space gives no ids. lower: case gives none either.
    """

    def __init__(self, encode_new: Callable[[list[str]], Iterable[bytes]], spaced: bool, memory: int = MEMORY, lower: bool = False):
        self.encode_new, self.spaced, self.memory, self.lower = encode_new, spaced, memory, lower
        self._forget()

    def _forget(self) -> None:
        """known: piece -> its number; the ids of number i are ids[bounds[i] : bounds[i + 1]]."""
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the number among them of each piece in order, and how many pieces there are up to each text's end."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        joined = b"".join(raw)
        if not self.spaced:
            joined = joined.replace(b"\n", b" ")
        data = np.frombuffer(joined, np.uint8)
        if self.lower:  # a letter before a byte of another alphabet may be one character with it
            data = data.copy()
            data[np.flatnonzero(_UPPER[data] & (np.append(data[1:], 0) < 0x80))] |= 0x20
        starts = piece_starts(data, np.concatenate([[0], ends[:-1]]), self.spaced)
        bounds = np.append(starts, len(data)) if len(data) else np.zeros(1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        return pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(), np.searchsorted(starts, ends)

    def encode_joined(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind another, each followed by end_id if given, and where each text's ids end."""
        pieces, order, upto = self._cut(texts)
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if (place < 0).sum() + len(self.known) > self.memory:
            self._forget()
            place[:] = -1
        new = np.flatnonzero(place < 0)
        # long pieces come last, so that they are forgotten with this call
        long = np.array([len(pieces[i]) > LONGEST for i in new.tolist()], bool)
        new = np.concatenate([new[~long], new[long]])
        place[new] = len(self.bounds) - 1 + np.arange(len(new))
        fresh = [pieces[i] for i in new.tolist()]
        found = [ids for x in range(0, len(fresh), 20_000) for ids in self.encode_new(fresh[x : x + 20_000])]
        ids = np.concatenate([self.ids, as_ids(b"".join(found))])
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) // 4 for x in found], dtype=np.int64)])
        short = len(new) - int(long.sum())
        self.known.update(zip(fresh[:short], range(len(self.bounds) - 1, len(self.bounds) - 1 + short), strict=True))
        self.bounds = bounds[: len(self.bounds) + short]
        self.ids = ids if short == len(new) else ids[: self.bounds[-1]].copy()
        begin, size = bounds[:-1][place][order], np.diff(bounds)[place][order]
        stops = np.cumsum(size)
        out = ids[np.repeat(begin - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        ends = np.concatenate([[0], stops])[upto]
        return (out, ends) if end_id is None else (np.insert(out, ends, end_id), ends + np.arange(1, len(ends) + 1))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        ids, ends = self.encode_joined(texts)
        return [ids[a:b].tobytes() for a, b in pairwise([0, *ends.tolist()])]


def _byte_chars() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


_CHARS = _byte_chars()
#: Latin letters that are their own normal form, then marks: the tokenizers' patterns cut between the two and nowhere else.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,!?;:|#$%&*]*)")


class LibraryPieces:
    """Pieces through the tokenizers library.

    Plain pieces go straight to its model, past slow normalising and cutting; the others to the whole tokenizer.
    """

    def __init__(self, path: str, lower: bool, specials_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = specials_as_text
        self.batch, self.model, self.lower = getattr(t, "encode_batch_fast", t.encode_batch), t.model, lower
        self.tails: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        if match.isascii() and match[0] == " ":
            match = "Ġ" + match[1:]  # U+0120 stands for a space
        elif not match.isascii() or match[0] == "\n":
            match = match.encode().decode("latin-1").translate(_CHARS)
        return array("I", [x.id for x in self.model.tokenize(match)]).tobytes()

    def __call__(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        # a word comes back with other marks behind it
        if len(self.cores) + len(pieces) > MEMORY:
            self.cores = {}
        cores, plain, tails, rest = self.cores, _PLAIN.fullmatch, self.tails, []
        for i, p in enumerate(pieces):
            if (word := p.removeprefix(" ")).isalpha() and word.isascii():  # remembered as a piece
                out[i] = self._match(word.lower() if self.lower else p)
                continue
            m = plain(p)
            if m is None:
                rest.append(i)
                continue
            core, tail = m.groups()
            if self.lower:
                core = core.lower().removeprefix(" ")
            ids = cores.get(core)
            if ids is None:
                ids = cores[core] = self._match(core)
            if tail:
                if tail not in tails:
                    if len(tails) > 1000:
                        tails.clear()
                    tails[tail] = self._match(tail)
                ids += tails[tail]
            out[i] = ids
        for i, e in zip(rest, self.batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out


def library_encoder(path: str, spaced: bool, specials_as_text: bool = True) -> PieceEncoder:
    """An encoder by the tokenizers library, one per worker process and file.

    spaced: a byte-level vocabulary whose words take the space before them; else one that drops white space and case.
    specials_as_text: the string of a special token in a text is ordinary text, as the files' own README encodes, so that no
    document forges an end mark; else it gets the special id.
    """
    key = "library", path, specials_as_text
    if key not in _workers:
        _workers[key] = PieceEncoder(LibraryPieces(path, not spaced, specials_as_text), spaced, 2 * MEMORY, lower=not spaced and specials_as_text)
    return _workers[key]


def grouped(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in groups of about GROUP characters, with their texts (null: empty)."""
    for b in batches:
        texts = [t or "" for t in b.column(text).to_pylist()]
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= GROUP or i == len(texts) - 1:
                yield b.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def as_ids(encoded: bytes) -> np.ndarray:
    return np.frombuffer(encoded, "<u4")
