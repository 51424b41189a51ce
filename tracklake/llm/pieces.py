"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text's words are its parts before each space, marked by U+2581; no piece crosses such a mark. The
distinct words of a batch are sorted, so that words with a common prefix follow each other: this is a
depth-first walk of their trie. Each node keeps the forward state of its prefix, and a word starts from
the state of the longest prefix that it shares with the word before.

- Unigram models: Viterbi. A node's state is the best score of a segmentation of its prefix and the last
  piece of it.
- Byte-pair models: sums of scores don't give the library's result there, merges do. The state is the last
  piece of the prefix's merge result, which is unique: it is the one piece that ends there and whose pair
  with the state at its start survives the merges. Whether a pair survives is found by undoing the two
  pieces' merges along their border, latest first, and remembered.

Characters without a piece become byte pieces, or the unknown piece in models without them. Models whose
normaliser changes characters or that have user-defined pieces are refused. A null or empty text has no pieces;
texts of any length are encoded whole; repeated rows are encoded alike; an empty table gives an empty result; other
columns pass through, but one named as ``out`` is replaced.
The spaces at which a text is split come back in decoding; a literal U+2581 reads as a space, as in the
library.
"""

from __future__ import annotations

import os.path
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import release

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Words and pairs that a worker remembers before it starts anew.
MAX_WORDS, MAX_PAIRS, MAX_CHARS = 400_000, 1_000_000, 8_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at - size : at])[0]


class PieceModel:
    """A model file's pieces; encodes and decodes."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), got.get(2, 0.0), got.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or any(t == USER for *_, t in pieces):
            raise ValueError("only models with identity normalisation, a leading mark and no user-defined pieces are supported")
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a mark")
        self.scores = {p: pieces[i][1] for p, i in self.ids.items()}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = [i for i, (_, _, t) in enumerate(pieces) if t == BYTE]
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        #: What a piece of two characters or more can end with: no longer one begins where this has no entry.
        #: Each is mapped to whether it is a piece itself.
        self.suffixes = {p[i:]: p[i:] in self.ids for p in self.ids for i in range(len(p) - 1)}
        self.breaks = not any("\n" in p and len(p) > 1 for p in self.ids)
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p])
        self.rank: dict[str, int] = {}
        for p in order:  # equal scores have equal ranks
            self.rank[p] = self.rank[last] if self.rank and self.scores[p] == self.scores[last] else len(self.rank)
            last = p
        self.raw = [bytes([self.bytes.index(i)]) if t == BYTE else b"" if t == CONTROL else p.encode() for i, (p, _, t) in enumerate(pieces)] if len(self.bytes) == 256 else [b"" if t == CONTROL else p.encode() for p, _, t in pieces]
        if not self.raw[self.unknown:self.unknown + 1] or pieces[self.unknown][2] == UNKNOWN:
            self.raw[self.unknown] = " ⁇ ".encode()
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    # ---- byte-pair merges

    def merged(self, text: str) -> list[str]:
        """The plain merge loop: the best-ranked neighbours first, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        return symbols

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes the piece; None if merging its characters doesn't."""
        if piece not in self.parts:
            symbols, last = list(piece), None
            while len(symbols) > 1:
                best = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
                if best[0] == 1 << 60:
                    last = None
                    break
                i = best[1]
                last = (symbols[i], symbols[i + 1])
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            self.parts[piece] = last if len(symbols) == 1 else None
        return self.parts[piece]

    def survives(self, a: str, b: str) -> bool:
        """Whether the pieces a and b stay two when the characters of both are merged."""
        key = (a, b)
        if key in self.pairs:
            return self.pairs[key]
        limit, right_undone, out = 1 << 60, False, True
        rank = self.rank
        while True:
            joint = rank.get(a + b)
            if joint is not None and (joint < limit or (right_undone and joint == limit)):
                out = False
                break
            made_a, made_b = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                limit, right_undone, a = made_a, False, self.split(a)[1]
            else:  # of equal merges the left one came first, so the right one is undone first
                limit, right_undone, b = made_b, True, self.split(b)[0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def _walk_bpe(self, words: list[str]) -> dict[str, list[str]]:
        """segment() by merges: ``last`` holds the last piece of the merge result of each prefix."""
        parts, pairs, suffixes, longest = self.parts, self.pairs, self.suffixes, self.longest
        out, before, last = {}, "", [""]
        for word in words:
            shared, n = 0, len(word)
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n + 1):
                found = word[i - 1]
                ends = []
                for j in range(i - 2, max(i - longest, 0) - 1, -1):
                    piece = word[j:i]
                    whole = suffixes.get(piece)
                    if whole is None:
                        break
                    if whole:
                        ends.append(piece)
                for piece in reversed(ends):
                    made = parts.get(piece, 0)
                    if made == 0:
                        made = self.split(piece)
                    if made is None:
                        continue
                    j = i - len(piece)
                    if j:
                        kept = pairs.get((last[j], piece))
                        if kept is None:
                            kept = self.survives(last[j], piece)
                        if not kept:
                            continue
                    found = piece
                    break
                last.append(found)
            pieces, i = [], n
            while i:
                piece = last[i]
                pieces.append(piece)
                i -= len(piece)
            pieces.reverse()
            out[word] = pieces
            before = word
        return out

    def _extend_unigram(self, word: str, i: int, state: list[tuple[float, int]]) -> None:
        """Append the best score of word[:i] and the length of its last piece."""
        best = (state[i - 1][0] + self.floor, 1)
        for size in range(1, min(i, self.longest) + 1):
            score = self.scores.get(word[i - size : i])
            if score is not None and state[i - size][0] + score > best[0]:
                best = (state[i - size][0] + score, size)
        state.append(best)

    def segment(self, words: list[str]) -> dict[str, list[str]]:
        """The pieces of each of the sorted distinct words, by a walk of their trie."""
        if self.bpe:
            return self._walk_bpe(words)
        out, before, state = {}, "", [(0.0, 0)]
        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            del state[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                self._extend_unigram(word, i, state)
            found, i = [], len(word)
            while i:
                found.append(word[i - state[i][1] : i])
                i -= state[i][1]
            out[word] = found[::-1]
            before = word
        return out

    # ---- texts

    def _split(self, text: str) -> list[str]:
        """The marked words; where no piece crosses a line break, words also begin at breaks."""
        text = text.replace(MARK, " ")
        parts = (text.replace("\n", " \n") if self.breaks else text).split(" ")
        out, empty = [], 0
        for part in parts:
            if not part:
                empty += 1
            elif self.breaks and part[0] == "\n":
                # the break's own separator isn't a space of the text
                if empty:
                    out.append(MARK * empty)
                    empty = 0
                out.append(part)
            else:
                out.append(MARK * (empty + 1) + part)
                empty = 0
        if empty:
            out.append(MARK * empty)
        return out

    def _pieces_to_ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The piece ids of each text."""
        split = [self._split(t) if t else [] for t in texts]
        known = self.words
        new: set[str] = set()
        for words in split:
            new.update(words)
        fresh = sorted(w for w in new if w not in known)
        size = sum(map(len, fresh))
        if len(known) + len(fresh) > MAX_WORDS or self.held + size > MAX_CHARS:
            known.clear()
            fresh = sorted(new)
            self.held, size = 0, sum(map(len, new))
        self.held += size
        for word, pieces in self.segment(fresh).items():
            known[word] = self._pieces_to_ids(pieces)
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in split]

    def forget(self) -> None:
        """Give up what encode() remembers of words and pairs."""
        self.words.clear()
        self.pairs.clear()
        self.held = 0
        release()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of piece ids; the mark of the first word isn't a space of the text."""
        raw = self.raw
        text = b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> bytes:
    """The model file, read on the driver; executors get its bytes by broadcast (its size is that of a vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


_PIECES = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
_MODELS: dict[int, PieceModel] = {}


def encoded(batches: Iterator[pa.Array], m: PieceModel, rows_at_once: int) -> Iterator[pa.Array]:
    """The results of so many rows after each other: the ids of a whole batch are never held together."""
    for column in batches:
        for lo in range(0, len(column), rows_at_once) or [0]:
            texts = column.slice(lo, rows_at_once).to_pylist()
            ids = m.encode(texts)
            same = [m.decode(i) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
            ends = np.concatenate(([0], np.cumsum([len(i) for i in ids], dtype=np.int64))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])
    m.forget()


def encode(df: DataFrame, model: bytes, text: str = "text", out: str = "pieces", rows_at_once: int = 300) -> DataFrame:
    """df with a struct column ``out``: ids, and whether decoding them gives the text again.

    So many rows' words are sorted together. What a task remembers ends with it, as its worker serves other stages too.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_PIECES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hash(shared.value)
        if key not in _MODELS:
            _MODELS[key] = PieceModel(shared.value)
        yield from encoded(batches, _MODELS[key], rows_at_once)

    return df.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with a string column ``out``: the text of the piece ids; null for null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = PieceModel(shared.value)
        for column in batches:
            yield pa.array([None if i is None else m.decode(i) for i in column.to_pylist()], pa.string())

    return df.withColumn(out, run(F.col(ids)))
