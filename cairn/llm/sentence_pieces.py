"""SentencePiece encoding and decoding for merge-type vocabularies with an agenda of adjacent symbol pairs.

A text becomes symbols of one character. Every pair of neighbours whose union is in the vocabulary stands on an
agenda ordered by score, then by place; the best is united, and the pairs with its new neighbours join the agenda. Agendas of
many short words are the columns of a matrix, that of a long part is a heap.
What is left is looked up, unknown characters fall back to bytes. Texts are cut where no piece of the vocabulary
spans the cut: at single spaces into words that Arrow numbers, so that only distinct ones are Python objects, and texts with other
spaces into parts. Both are encoded alone and remembered, and Arrow joins the ids of words and the bytes of ids. Of each group of texts the
sentencepiece library encodes the words not seen before and decodes every document; rows carry whether its ids and texts agree.

Edge cases: null and empty texts have the begin and end ids only and decode to an empty text; repeated rows are
encoded each; an empty table gives an empty result; other columns of the input are not looked at. U+2581, which stands
for a space in pieces, decodes to a space, as in the library.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import NONE, PairTable
from cairn.llm.tables import table
from cairn.llm.tokens import LONGEST, MEMORY, as_ids, grouped

#: Stands for a space in pieces.
SPACE = "▁"
#: Latin letters; most vocabularies have no piece of these and of other characters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: What the id of an unknown piece decodes to.
UNKNOWN = " ⁇ "
#: Characters of a part whose agenda may be a column of a matrix, and columns of that; symbols from here on are in no pair.
SHORT, COLUMNS, STRANGE = 40, 8192, 1 << 30
#: Words that the library is asked for at once.
ASKED = 64
TWO_SPACES = 2 * SPACE
#: Kinds of pieces in the model's format.
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6
#: The model's number for merge-type vocabularies.
MERGES = 2

# every byte that is no part of a character becomes one replacement character
codecs.register_error("cairn-each-byte", lambda e: ("�", e.start + 1))


def united(symbol: np.ndarray, pairs: PairTable) -> None:
    """Unites the first of the best pairs of each column until no column has a pair left; a symbol taken in by another becomes -1.

    Columns are padded with -1, and the first and the last row hold nothing else.
    """
    height, n = symbol.shape
    bits = height.bit_length()
    row = np.arange(height, dtype=np.int32)[:, None]

    def entries(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A pair's rank, then where it begins: the least of a column is the first of its best pairs."""
        ranks = pairs.ranks(left, right)
        return np.where(ranks == NONE, NONE, ranks << bits | at)

    agenda = np.full((height, n), NONE)
    agenda[:-1] = entries(symbol[:-1], symbol[1:], row[:-1])
    before, after = np.repeat(row - 1, n, 1).ravel(), np.repeat(row + 1, n, 1).ravel()
    symbol, flat = symbol.ravel(), agenda.ravel()
    while len(column := np.flatnonzero((best := agenda.min(0)) != NONE)):
        best = best[column]
        i, whole = best & ((1 << bits) - 1), best >> bits
        first = i * n + column
        second = after[first] * n + column
        k, h = after[second], before[first]
        behind, ahead = k * n + column, h * n + column
        symbol[first], symbol[second], flat[second] = whole, -1, NONE
        after[first], before[behind] = k, i
        flat[first] = entries(whole, symbol[behind], i)
        flat[ahead] = entries(symbol[ahead], whole, h)


def joined(values: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Of the values at these places joined, one for each stretch of places that ends there."""
    got = values.take(pa.array(at))
    bounds = np.frombuffer(got.buffers()[1], np.int64)[np.concatenate([[0], ends])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), got.buffers()[2]])


class _Known:
    """Strings and their ids in two generations: the older one goes when the younger is full, so what comes often stays."""

    def __init__(self, most: int):
        self.young, self.old, self.most = {}, {}, max(1, most // 2)

    def lacking(self, strings: Iterable[str]) -> list[str]:
        """Those of distinct strings that aren't known; the others are in the younger generation after this."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        left = [x for x in strings if x not in young]
        young.update([(x, old[x]) for x in left if x in old])
        return [x for x in left if x not in old]


class _Symbols(dict):
    """Symbol -> the bytes of its id; an unknown character -> those of its bytes' ids."""

    def __init__(self, ids: dict[str, int], byte_ids: list[int]):
        super().__init__((p, array("I", [i]).tobytes()) for p, i in ids.items())
        self.byte_ids = byte_ids

    def __missing__(self, symbol: str) -> bytes:
        return array("I", [self.byte_ids[b] for b in symbol.encode()]).tobytes()


class MergePieces:
    """A merge-type model with byte fallback, read from its file."""

    def __init__(self, path: str, memory: int = MEMORY):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        how, pieces = model.normalizer_spec, model.pieces
        if model.trainer_spec.model_type != MERGES or not {p.type for p in pieces} <= {NORMAL, UNK, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies of plain, control and byte pieces are supported")
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        if len(byte_ids) < 256:
            raise ValueError("the vocabulary has no piece for some bytes")
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are and mark spaces are supported")
        self.library = SentencePieceProcessor(model_file=path)
        self.ends = self.library.bos_id(), self.library.eos_id()
        self.begin, self.end = (array("I", [i]).tobytes() for i in self.ends)
        self.prefixed = how.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        place = {x: i for i, x in enumerate(sorted({p.score for p in pieces if p.type == NORMAL}, reverse=True))}
        #: Piece -> its place in the order of scores, best first; equal scores share one.
        self.order = {p.piece: place[p.score] for p in pieces if p.type == NORMAL}
        self.symbols = _Symbols(self.ids, [byte_ids[b] for b in range(256)])
        self.bytes_of = [b"" if p.type == CONTROL else UNKNOWN.encode() if p.type == UNK else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in pieces]
        self.bytes_values = pa.array(self.bytes_of, pa.large_binary())
        self.control = {i for i, p in enumerate(pieces) if p.type == CONTROL}
        self.is_control = np.array([p.type == CONTROL for p in pieces])
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        #: Whether no piece goes on behind a space or a line end inside it.
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids if len(p) > 1)
        self.cut = re.compile(self._cuts()).findall
        #: Parts and words with their ids, and words for which the library gives others.
        self.parts, self.words, self.wrong = _Known(memory // 4), _Known(memory), set()
        # numbers of pieces by falling score; columns of a matrix need different scores where pairs are united
        number = {p: i for i, p in enumerate(sorted(self.ids, key=self.order.get))}
        self.pairs, self.id_values = PairTable(number), pa.array([self.symbols[p] for p in number], pa.large_binary())
        #: Code point -> the number of its piece; the last is that of all greater ones.
        self.numbers = np.full(max(ord(p) for p in number if len(p) == 1) + 2, STRANGE, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.numbers[ord(p)] = i
        times = Counter(self.order[p] for p in self.ids if len(p) > 1)
        tied = [p for p in self.ids if len(p) > 1 and times[self.order[p]] > 1]
        self.single_scores, self.by_columns = not tied, all(TWO_SPACES in p for p in tied)

    def _cuts(self) -> str:
        """A pattern of parts that no piece joins with what stands before or behind them."""
        long = [p.lstrip(SPACE) for p in self.ids if len(p) > 1]
        if not self.by_words:
            return r"(?s:.+)"
        letter, other = f"[{LETTERS}]", rf"[^{LETTERS}{SPACE}\n]"
        mixed = re.compile(f"{letter}{other}|{other}{letter}")
        inner = rf"[^{SPACE}\n]+" if any(map(mixed.search, long)) else f"(?:{letter}+|{other}+)"
        return rf"{SPACE}*{inner}|{SPACE}+|\n"

    def merged(self, part: str) -> list[str]:
        """The symbols that stay when the agenda is empty. An entry of it is a pair's place in the order of scores, then where it begins."""
        n, order = len(part), self.order.get
        width = n.bit_length()
        agenda = [o << width | i for i, two in enumerate(map(add, part, part[1:])) if (o := order(two)) is not None]
        if not agenda:
            return list(part)
        heapify(agenda)
        symbol, after, before, here = list(part), list(range(1, n + 1)), list(range(-1, n)), (1 << width) - 1
        while agenda:
            first = heappop(agenda)
            i = first & here
            j = after[i]
            # a side has gone or grown since
            if j >= n or not symbol[i] or order(whole := symbol[i] + symbol[j]) != first >> width:
                continue
            symbol[i], symbol[j] = whole, ""
            k = after[i] = after[j]
            before[k] = i
            if k < n and (o := order(whole + symbol[k])) is not None:
                heappush(agenda, o << width | i)
            if (h := before[i]) >= 0 and (o := order(symbol[h] + whole)) is not None:
                heappush(agenda, o << width | h)
        return [s for s in symbol if s]

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.symbols.__getitem__, self.merged(part)))

    def _rows(self, parts: list[str]) -> list[bytes]:
        """Ids of short parts: their agendas are columns of a matrix, and each round unites the first of the best pairs of every column."""
        height = max(map(len, parts))
        points = np.frombuffer("".join([p.ljust(height, "\0") for p in parts]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(parts), height)
        m = self.numbers[np.minimum(points, len(self.numbers) - 1)]
        m[np.arange(height) >= np.fromiter(map(len, parts), np.int64, len(parts))[:, None]] = -1
        values = self.id_values
        if (strange := m == STRANGE).any():  # characters without a piece have numbers behind those of the pieces
            found, at = np.unique(points[strange], return_inverse=True)
            m[strange] += at.astype(np.int32)
            values = pa.concat_arrays([values, pa.array([self.symbols[chr(c)] for c in found.tolist()], pa.large_binary())])
        symbol = np.full((height + 2, len(parts)), -1, np.int32)
        symbol[1:-1] = m.T
        united(symbol, self.pairs)
        m = symbol.T
        there = m >= 0
        at = m[there]
        return joined(values, np.where(at < STRANGE, at, at - STRANGE + len(self.id_values)), there.sum(1).cumsum()).to_pylist()

    def _alone(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are short and may be columns."""
        short = sorted([p for p in parts if len(p) <= SHORT and (self.single_scores or TWO_SPACES not in p)], key=len) if self.by_columns else []
        out = {}
        for x in range(0, len(short), COLUMNS):
            some = short[x : x + COLUMNS]
            out.update(zip(some, self._rows(some), strict=True))
        return out

    def _learn_parts(self, parts: set[str]) -> None:
        new = self.parts.lacking(parts)
        self.parts.young.update(self._alone(new))
        self.parts.young.update((p, self._part(p)) for p in new if p not in self.parts.young)

    def _marked(self, marked: list[str]) -> list[bytes]:
        """Ids of texts with marks for spaces."""
        cut = [self.cut(x) for x in marked]
        self._learn_parts(set().union(*cut))
        get = self.parts.young.__getitem__
        out = [b"".join(map(get, parts)) for parts in cut]
        for p in [p for parts in cut for p in parts if len(p) > LONGEST]:
            self.parts.young.pop(p, None)
        return out

    def _plain(self, text: str) -> bool:
        """Whether the text's words can be encoded each with the one space before it: it has no other spaces."""
        return bool(self.prefixed and self.by_words and text and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ")

    def _learn(self, words: list[str], check: bool) -> list[str]:
        """New words, each with the space before it, are encoded and, with check, compared with the library's ids; they are returned."""
        new = self.words.lacking(words)
        marked = [SPACE + w[1:] for w in new]
        found = self._alone(marked)
        other = [w for w in marked if w not in found]
        found.update(zip(other, self._marked(other), strict=True))
        ids = [found[w] for w in marked]
        self.words.young.update(zip(new, ids, strict=True))
        if check and new:
            # each is a word of one of some texts; only where a text's ids differ its words are compared one by one, and none passes if no one is found
            slices = [slice(x, x + ASKED) for x in range(0, len(new), ASKED)]
            for part, own in zip(slices, self.library.encode(["".join(new[part])[1:] for part in slices], num_threads=1), strict=True):
                if array("I", own).tobytes() != b"".join(ids[part]):
                    alone = self.library.encode([w[1:] for w in new[part]], num_threads=1)
                    self.wrong.update([w for w, own, i in zip(new[part], ids[part], alone, strict=True) if array("I", i).tobytes() != own] or new[part])
        return new

    def encode_batch(self, texts: list[str], check: bool = True) -> tuple[pa.Array, list[bool | None]]:
        """Of each whole text: begin id, ids and end id as little-endian unsigned 32-bit integers; with check, whether the library gives the same.

        No piece spans the space before a word, so the ids of a text are those of its words; the library encodes each distinct new word of
        a batch, and whole texts that have other spaces.
        """
        plain = [self._plain(t) for t in texts]
        data = np.frombuffer("".join([f" {t}" for t, p in zip(texts, plain, strict=True) if p]).encode(), np.uint8)
        bounds = np.append(np.flatnonzero(data == 0x20), len(data))
        cut = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        words = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self._learn(words, check)
        other = self._marked([(SPACE + t if self.prefixed and t else t).replace(" ", SPACE) for t, p in zip(texts, plain, strict=True) if not p])
        values = pa.array([*map(self.words.young.__getitem__, words), *other, self.begin, self.end], pa.large_binary())
        # places of values: begin, the words of a text or a whole other text, end
        rows = np.array([t.count(" ") + 1 if p else 1 for t, p in zip(texts, plain, strict=True)], np.int64)
        ends, total = (rows + 2).cumsum(), int(rows.sum()) + 2 * len(rows)
        at, inner = np.empty(total, np.int64), np.ones(total, bool)
        whole = (ends - 2)[~np.array(plain, bool)]
        for place, number in ((ends - rows - 2, len(values) - 2), (ends - 1, len(values) - 1), (whole, len(words) + np.arange(len(other)))):
            at[place], inner[place] = number, False
        at[inner] = cut.indices.to_numpy()
        out = joined(values, at, ends)
        for w in [w for w in new if len(w) > LONGEST]:
            del self.words.young[w]
        if not check:
            return out, [None] * len(texts)
        agrees = []
        for i, (text, p) in enumerate(zip(texts, plain, strict=True)):
            if p:
                agrees.append(not self.wrong or self.wrong.isdisjoint(f" {w}" for w in text.split(" ")))
            else:
                agrees.append(array("I", self.library.encode(text, add_bos=True, add_eos=True)).tobytes() == out[i].as_py())
        return out, agrees

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text], check=False)[0][0].as_py()

    def _text(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "cairn-each-byte")

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for; control ids stand for none, the space put before a text goes."""
        found = as_ids(ids[4:-4] if ids[:4] == self.begin and ids[-4:] == self.end and len(ids) > 4 else ids).tolist()
        if self.control.isdisjoint(found):
            runs = [found] if found else []
        else:  # bytes on both sides of a control id don't make one character
            runs = [list(run) for of_control, run in groupby(found, self.control.__contains__) if not of_control]
        text = "".join(map(self._text, runs))
        return text[1:] if self.prefixed and runs and runs[0][0] in self.spaced else text

    def decode_batch(self, encoded: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids; those between a begin and an end id and without other control ids are joined by Arrow."""
        ids = np.concatenate([*encoded, np.zeros(0, "<u4")])
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ends, control = sizes.cumsum(), np.append(0, self.is_control[ids].cumsum())
        usual = (sizes > 1) & (control[ends] - control[ends - sizes] == 2)
        texts = joined(self.bytes_values, ids, ends).to_pylist()
        for i, x in enumerate(encoded):
            if usual[i] and (x[0], x[-1]) == self.ends:
                text = texts[i].decode("utf-8", "cairn-each-byte")
                texts[i] = text[1:] if self.prefixed and len(x) > 2 and int(x[1]) in self.spaced else text
            else:
                texts[i] = self.decode(x.tobytes())
        return texts


_workers: dict[str, MergePieces] = {}


def model(path: str) -> MergePieces:
    """One model per worker process and file."""
    if path not in _workers:
        _workers[path] = MergePieces(path)
    return _workers[path]


_ENCODED = "doc_id long, ids binary, agrees boolean"


def _encoded(batches: Iterable[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for rows, texts in grouped(batches):
        ids, agrees = m.encode_batch(texts, check)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids.cast(pa.binary()), pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "agrees"])


def encode(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, the ids of each whole text with begin and end ids (little-endian unsigned 32-bit integers), and with
    ``check`` whether the library gives the same ids (else null)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_encoded, path=path, check=check), _ENCODED)


def _texts(m: MergePieces, ids: list[bytes], agrees: list[bool | None], check: bool) -> tuple[list[str], list[bool | None]]:
    encoded = [as_ids(i) for i in ids]
    texts = m.decode_batch(encoded)
    if check:
        agrees = [a is not False and t == own for a, t, own in zip(agrees, texts, m.library.decode(encoded, num_threads=1), strict=True)]
    return texts, agrees


def _decoded(batches: Iterable[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for b in batches:
        for x in range(0, b.num_rows, 200):
            part = b.slice(x, 200)
            texts, agrees = _texts(m, part.column("ids").to_pylist(), part.column("agrees").to_pylist(), check)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string()), pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "decoded", "agrees"])


_DECODED = "doc_id long, ids binary, decoded string, agrees boolean"


def decode(encoded: DataFrame, path: str, check: bool = True) -> DataFrame:
    """Adds the decoded text; with ``check`` agrees also says whether the library decodes the same."""
    return encoded.select("doc_id", "ids", "agrees").mapInArrow(partial(_decoded, path=path, check=check), _DECODED)


def _round_trip(batches: Iterable[pa.RecordBatch], path: str, check: bool) -> Iterator[pa.RecordBatch]:
    for b in _encoded(batches, path, check):
        yield from _decoded([b], path, check)


def round_trip(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """What decode(encode(docs)) gives, by one worker for a task."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_round_trip, path=path, check=check), _DECODED)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; agrees says whether the library gives the same ids and the same decoded text."""
    import public_tokenizers

    both = round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    n = F.expr("octet_length(ids) div 4").alias("n_tokens")
    return both.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
