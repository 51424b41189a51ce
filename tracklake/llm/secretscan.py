"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The text is cut into tokens (runs of letters, digits and ``_ - + /``; any other visible character alone).
The field tags each token as outside (0), begin (1) or inside (2) of a secret. Its features are the
token's shape and word, the shapes and words of its neighbours, and features of the whole file (shares of
digits and symbols, length of lines). It is trained by maximum likelihood with the base patterns' spans as
labels, on windows of documents picked by a hash of id and text, an expected ``train_docs`` at most of those
with base spans and as many of the others: what the patterns find teaches how secrets and their surroundings
look, however rare they are. As the field would then only find again what the patterns find, training also sees these
documents with other values in the places of the spans (varied()): secret ones of alphabets that no pattern has, and
names, which are none. Without any base span in the table nothing is added, and train() warns.

Decoding is Viterbi over the whole text. A token whose outside score exceeds its other scores by more than
the transitions can ever return is outside on the best path, whatever its neighbours are; this splits the
text exactly, and only the stretches between such tokens need the recursion.

Base kinds: assign, access, hex; spans are offsets in code points, end exclusive. Spans of the field are
kind ``crf``. One that extends beyond the base spans it overlaps is kept whole, overlap included, so all of a
longer token around a base span is masked; one within base spans adds nothing and is left out, and so is one
that overlaps none and is under MIN_CRF characters.
Defined results: a null text counts as empty and has no spans; repeated rows are judged alike; spans of different
kinds that start in one place are all given, in the order of KINDS; a text is scanned whole, whatever its length; an
empty table gives an empty result; other columns pass through, but one named as find()'s ``out`` is replaced.
"""

from __future__ import annotations

import functools
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_CRF = 12, 18, 16, 12

SHAPES, WORDS, FILES = 1 << 10, 1 << 11, 1 << 6
#: Alphabets of the values that training puts in place of the base spans' own, and from which to below which size.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASE62 = "0123456789" + _LETTERS + _LETTERS.upper()
ALPHABETS, VARIED_SIZES = ("0123456789abcdef", "0123456789ABCDEF", "0123456789" + _LETTERS, _BASE62, _BASE62 + "+/", _BASE62 + "-_"), (16, 65)
#: From how many first characters training takes the words of such names.
VARIED_WORDS = 10_000
#: Places of the neighbours whose words and shapes are features.
NEAR_WORDS, NEAR_SHAPES = (0, -1, -2, -3, 1), (0, -1, 1)
#: Sizes of the features that are parts of a token's own shape: its length, what it has, its changes, length with changes.
PARTS = (8, 16, 8, 64)
SIZE = SHAPES * len(NEAR_SHAPES) + WORDS * len(NEAR_WORDS) + sum(PARTS) + FILES
WINDOW = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    points = W.code_points(text)
    if points.size >= MIN_HEX:
        hexes = np.zeros(points.size + 2, np.int8)
        hexes[1:-1] = _hex_table()[np.minimum(points, 128)]
        edges = np.flatnonzero(hexes[1:] != hexes[:-1])
        long = edges[1::2] - edges[::2] >= MIN_HEX
        out += [(int(a), 2, int(b)) for a, b in zip(edges[::2][long], edges[1::2][long], strict=True)]
    return sorted(out)


@functools.cache
def _hex_table() -> np.ndarray:
    table = np.zeros(129, np.int8)
    table[[ord(c) for c in "0123456789abcdef"]] = 1
    return table


@functools.cache
def _class_table() -> np.ndarray:
    """0 space, 1 lower, 2 upper, 3 digit, 4 joiner, 5 other visible, 6 beyond ASCII."""
    table = np.full(129, 5, np.uint8)
    table[128] = 6
    table[[32, *range(9, 14)]] = 0
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[[ord(c) for c in "_-+/"]] = 4
    return table


def tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and the class of each character."""
    kinds = _class_table()[np.minimum(points, 128)]
    single = kinds == 5
    run = (kinds != 0) & ~single
    prev = np.concatenate(([False], run[:-1]))
    start = (run & ~prev) | single
    starts = np.flatnonzero(start)
    ends = np.flatnonzero((run & ~np.concatenate((run[1:], [False]))) | single) + 1
    return starts, ends, kinds


def features(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """(tokens, features) places in the weight table, whose last row is for places beyond the text."""
    n = starts.size
    lengths = ends - starts
    digits, uppers, lowers = (np.add.reduceat((kinds == k).astype(np.int32), starts) if n else np.zeros(0, np.int32) for k in (3, 2, 1))
    if n:  # a stretch from one start to the next also holds spaces, which none of the three counts has
        change, alike = np.zeros(points.size, np.int32), np.where(kinds == 6, 1, kinds)
        change[1:] = (alike[1:] != alike[:-1]) & (alike[1:] != 0) & (alike[:-1] != 0)
        change[starts] = 0
        changes = np.add.reduceat(change, starts)
    else:
        changes = np.zeros(0, np.int32)
    size = np.searchsorted(np.array([2, 4, 7, 12, 16, 24, 33]), lengths, side="right")  # 8 sizes
    digit = np.searchsorted(np.array([0.01, 0.25, 0.8]), digits / np.maximum(lengths, 1), side="right")  # 4 shares
    case = (uppers > 0) + 2 * (lowers > 0)  # 4
    mixed = np.minimum(changes // 2, 7)  # 8
    shape = ((size * 4 + digit) * 4 + case) * 8 + mixed
    word = (W.word_hashes(np.where((points >= 65) & (points <= 90), points + np.uint32(32), points), starts, ends) >> np.uint64(53)).astype(np.int64)
    symbols = int((kinds == 5).sum())
    total = max(points.size, 1)
    lines = int((points == 10).sum()) + 1
    file = (int(np.searchsorted([0.005, 0.02, 0.1], int(digits.sum()) / total, side="right")) * 4 + int(np.searchsorted([0.02, 0.05, 0.15], symbols / total, side="right"))) * 4 + int(np.searchsorted([40, 120, 400], total / lines, side="right"))
    out = np.full((n, len(NEAR_SHAPES) + len(NEAR_WORDS) + len(PARTS) + 1), SIZE, np.int32)
    base = 0
    for j, (values, at) in enumerate([(shape, d) for d in NEAR_SHAPES] + [(word, d) for d in NEAR_WORDS]):
        lo, hi = max(0, -at), min(n, n - at)
        if hi > lo:
            out[lo:hi, j] = base + values[lo + at : hi + at]
        base += SHAPES if j < len(NEAR_SHAPES) else WORDS
    for j, (values, cells) in enumerate(zip((size, digit * 4 + case, mixed, size * 8 + mixed), PARTS, strict=True), len(NEAR_SHAPES) + len(NEAR_WORDS)):
        out[:, j] = base + values
        base += cells
    out[:, -1] = base + file
    return out


def labels(text: str, starts: np.ndarray, ends: np.ndarray, values: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Tags from the places of secret values; without them from the base spans: of an assignment, its value."""
    spans = values
    if spans is None:
        spans = [(ASSIGN.match(text, a).start(2) if kind == 0 else a, b) for a, kind, b in base_spans(text)]
    tags = np.zeros(starts.size, np.int8)
    for a, b in spans:
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        if not tags[lo:hi].any():
            tags[lo:hi] = 2
            tags[lo : min(lo + 1, hi)] = 1
    return tags


@dataclass
class Field:
    """Weights (SIZE + 1, 3) of the features and (5, 3) of the transitions: rows 0-2 from a tag, 3 the start, 4 the end."""

    weights: np.ndarray
    moves: np.ndarray

    def __post_init__(self) -> None:
        relative = self.weights[:, 1:] - self.weights[:, :1]
        self.relative = [np.ascontiguousarray(relative[:, k], np.float32) for k in (0, 1)]
        step, first, last = self.moves[:3], self.moves[3], self.moves[4]
        enter = np.vstack((step, first[None]))  # from each tag or the start
        leave = np.hstack((step, last[:, None]))  # to each tag or the end
        # what a path can gain in transitions by another tag than 0 in one place
        self.swing = max(float((enter[:, k] - enter[:, 0]).max() + (leave[k] - leave[0]).max()) for k in (1, 2))

    def scores(self, places: np.ndarray) -> np.ndarray:
        """(tokens, 2): begin and inside, relative to outside."""
        return np.stack([table[places].sum(axis=1) for table in self.relative], axis=1)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best path's tags."""
        tags = np.zeros(len(scores), np.int8)
        open_ = scores.max(axis=1, initial=-np.inf) + self.swing >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.astype(np.int8), [0]))))
        step = self.moves[:3]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            best = (step[0] if lo else self.moves[3]) + np.concatenate(([0.0], scores[lo]))
            back = []
            for i in range(lo + 1, hi):
                paths = best[:, None] + step
                back.append(paths.argmax(axis=0))
                best = paths.max(axis=0) + np.concatenate(([0.0], scores[i]))
            best = best + (step[:, 0] if hi < len(scores) else self.moves[4])
            tag = int(best.argmax())
            for i in range(hi - 1, lo - 1, -1):
                tags[i] = tag
                if i > lo:
                    tag = int(back[i - lo - 1][tag])
        return tags


def viterbi(field: Field, scores: np.ndarray) -> np.ndarray:
    """The best path by the plain recursion over all tokens (what decode() must equal)."""
    if not len(scores):
        return np.zeros(0, np.int8)
    full = np.concatenate((np.zeros((len(scores), 1)), scores), axis=1)
    best, back = field.moves[3] + full[0], []
    for row in full[1:]:
        paths = best[:, None] + field.moves[:3]
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    tag = int((best + field.moves[4]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return np.array(tags[::-1], np.int8)


def fit(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 600, batch: int = 128, rate: float = 0.08, l2: float = 1e-5, seed: int = 3) -> Field | None:
    """Maximum likelihood by ``steps`` of Adam over batches of windows (places, tags); None without any secret."""
    windows = [w for w in windows if len(w[1])]
    if not any(t.any() for _, t in windows):
        return None
    rng = np.random.default_rng(seed)
    w, moves = np.zeros((SIZE + 1, 3)), np.zeros((5, 3))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, moves)]
    order: list[int] = []
    for turn in range(1, steps + 1):
        if not order:
            order = rng.permutation(len(windows)).tolist()
        part, order = [windows[i] for i in order[:batch]], order[batch:]
        gw, gm = _gradient(part, w, moves)
        for x, g, s in ((w, gw + l2 * w, state[0]), (moves, gm + l2 * moves, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= rate * (s[0] / (1 - 0.9**turn)) / (np.sqrt(s[1] / (1 - 0.99**turn)) + 1e-8)
    return Field(w, moves)


def _gradient(part: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood: expected minus observed counts, by forward and backward sums."""
    rows, longest, wide = len(part), max(len(t) for _, t in part), part[0][0].shape[1]
    places = np.full((rows, longest, wide), SIZE)
    tags, real = np.zeros((rows, longest), int), np.zeros((rows, longest), bool)
    for r, (p, t) in enumerate(part):
        places[r, : len(t)], tags[r, : len(t)], real[r, : len(t)] = p, t, True
    emit = w[places].sum(axis=2)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    step = moves[:3]
    ends = real.sum(axis=1) - 1
    every = np.arange(rows)
    forward = np.empty((rows, longest, 3))
    forward[:, 0] = moves[3] + emit[:, 0]
    for i in range(1, longest):
        forward[:, i] = lse(forward[:, i - 1][:, :, None] + step, 1) + emit[:, i]
    z = lse(forward[every, ends] + moves[4], 1)
    backward = np.empty((rows, longest, 3))
    backward[:, -1] = moves[4]
    for i in range(longest - 2, -1, -1):
        onward = lse(step + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
        backward[:, i] = np.where((i >= ends)[:, None], moves[4], onward)
    p = np.exp(forward + backward - z[:, None, None]) * real[:, :, None]
    p[every[:, None], np.arange(longest)[None], tags] -= real
    gw = np.stack([sum(np.bincount(places[:, :, j].ravel(), p[:, :, k].ravel(), SIZE + 1) for j in range(wide)) for k in range(3)], axis=1)
    gm = np.zeros((5, 3))
    if longest > 1:
        pair = np.exp(forward[:, :-1, :, None] + step + (emit + backward)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        gm[:3] = pair.sum(axis=(0, 1))
        np.subtract.at(gm, (tags[:, :-1][real[:, 1:]], tags[:, 1:][real[:, 1:]]), 1.0)
    first, last = np.exp(forward[:, 0] + backward[:, 0] - z[:, None]), np.exp(forward[every, ends] + moves[4] - z[:, None])
    gm[3], gm[4] = first.sum(axis=0), last.sum(axis=0)
    np.subtract.at(gm, (np.full(rows, 3), tags[:, 0]), 1.0)
    np.subtract.at(gm, (np.full(rows, 4), tags[every, ends]), 1.0)
    gw[SIZE] = 0
    return gw / rows, gm / rows


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch how many texts there are, and how many have base spans."""
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "n_with": [sum(bool(base_spans(t.as_py())) for t in batch.column(0))]})


def varied(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text with others in place of its base spans' values, where secret ones now stand, and where names do.

    Two values in three are drawn from one of ALPHABETS, which no base pattern knows; the others are names made of the
    text's own words, which are no secrets. In half of the cases what an assignment says before its value goes too. So
    neither the base patterns' alphabets nor their cues are needed to see a secret, and length alone makes none.
    """
    out, secrets, names, done, length = [], [], [], 0, 0
    words = re.findall(r"[^\W\d_]+", text[:VARIED_WORDS]) or ["x"]
    for start, kind, end in base_spans(text):
        value = ASSIGN.match(text, start).start(2) if kind == 0 else start
        if start < done:
            continue
        is_secret = rng.random() < 2 / 3
        if is_secret:
            chars = ALPHABETS[rng.integers(len(ALPHABETS))]
            new = "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(*VARIED_SIZES)))
        else:
            some = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 8))]
            new = ("".join(some), "_".join(some), "-".join(some), "".join(w.capitalize() for w in some))[rng.integers(4)]
        before = text[done : start if rng.random() < 0.5 else value]
        out += [before, new]
        length += len(before)
        (secrets if is_secret else names).append((length, length + len(new)))
        length, done = length + len(new), end
    return "".join(out) + text[done:], secrets, names


def _windows(batches: Iterator[pa.RecordBatch], below: tuple[float, float], per_doc: tuple[int, int, int], versions: int) -> Iterator[pa.RecordBatch]:
    """Labelled windows of the sampled documents: around secrets, around other tokens with digits, and elsewhere.

    A document is sampled if its draw is under the first limit, or with base spans under the second. per_doc has
    how many windows of each of the three it gives at most, all drawn from the whole document; with base spans it
    gives as many of the first again from each of ``versions`` texts with varied values.
    """
    for batch in batches:
        keys, numbers, places_out, tags_out = [], [], [], []
        for key, draw, t in zip(*(batch.column(i) for i in range(3)), strict=True):
            text, key = t.as_py(), key.as_py()
            has_spans = bool(base_spans(text))
            if draw.as_py() >= below[has_spans]:
                continue
            rng, number = np.random.default_rng(key & (2**64 - 1)), 0
            for version, values, names in [(text, None, []), *(varied(text, rng) for _ in range(versions if has_spans else 0))]:
                points = W.code_points(version)
                starts, ends, kinds = tokens(points)
                if not starts.size:
                    continue
                places, tags = features(points, starts, ends, kinds), labels(version, starts, ends, values)
                odd = np.flatnonzero((np.add.reduceat((kinds == 3).astype(np.int32), starts) > 0) & (tags == 0))
                named = np.searchsorted(ends, [a for a, _ in names], side="right")
                centres = [*rng.permutation(np.concatenate((np.flatnonzero(tags == 1), named)).astype(np.int64))[: per_doc[0]]]
                if values is None:
                    centres += [*rng.permutation(odd)[: per_doc[1]], *rng.integers(0, starts.size, per_doc[2])]
                for c in centres:
                    lo, hi = max(0, int(c) - WINDOW), min(starts.size, int(c) + WINDOW)
                    keys.append(key)
                    numbers.append(number)
                    places_out.append(places[lo:hi].astype(np.int16).tobytes())
                    tags_out.append(tags[lo:hi].tobytes())
                    number += 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(places_out, pa.binary()), pa.array(tags_out, pa.binary())], ["key", "number", "places", "tags"])


def train(docs: DataFrame, train_docs: int = 1000, seed: int = 17, text: str = "text", doc_id: str = "doc_id", per_doc: tuple[int, int, int] = (4, 3, 2), versions: int = 4) -> Field | None:
    """A field trained on an expected train_docs documents with base spans and as many without, at most; equal rows teach once.

    per_doc: how many training windows a document gives at most around base spans, around other tokens with digits,
    and at random places. They are drawn from the whole document, so with more spans than that each can be among them.
    versions: how many texts with varied values a document with base spans gives besides its own.
    """
    key = F.xxhash64(F.lit(seed), doc_id, text)
    rows = docs.select(key.alias("key"), F.shiftrightunsigned(key, 11).alias("draw"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    counted = rows.select("text").mapInArrow(_counts, "n long, n_with long").agg(F.sum("n").alias("n"), F.sum("n_with").alias("n_with")).first()
    total, with_spans = counted["n"] or 0, counted["n_with"] or 0
    below = tuple(min(1.0, train_docs / n) * 2.0**53 if n else 0.0 for n in (total - with_spans, with_spans))
    drawn = rows.where(F.col("draw") < F.lit(max(below))).mapInArrow(lambda batches: _windows(batches, below, per_doc, versions), "key long, number int, places binary, tags binary")
    got = drawn.distinct().select("places", "tags").toArrow()
    got = sorted(zip(got["places"].to_pylist(), got["tags"].to_pylist(), strict=True))
    field = fit([(np.frombuffer(p, np.int16).reshape(len(t), -1), np.frombuffer(t, np.int8)) for p, t in got])
    if field is None:
        warnings.warn(f"no field could be fitted: {with_spans} of {total} texts have base spans; only base spans are given", stacklevel=2)
    return field


def scan(text: str | None, field: Field | None) -> list[tuple[int, int, int]]:
    """All spans (start, kind's place, end) of a text, in order."""
    text = text or ""
    base = base_spans(text)
    if field is None or not text:
        return base
    points = W.code_points(text)
    starts, ends, kinds = tokens(points)
    if not starts.size:
        return base
    tags = field.decode(field.scores(features(points, starts, ends, kinds)))
    marked = np.flatnonzero(tags)
    if not marked.size:
        return base
    begins = (tags[marked] == 1) | (np.concatenate(([-2], marked[:-1])) != marked - 1)
    lo = np.flatnonzero(begins)
    hi = np.append(lo[1:], marked.size) - 1
    taken = np.zeros(points.size, bool)
    for a, _, b in base:
        taken[a:b] = True
    added = [(int(starts[marked[i]]), 3, int(ends[marked[j]])) for i, j in zip(lo, hi, strict=True)]
    kept = lambda inside: not inside.all() and (inside.any() or inside.size >= MIN_CRF)
    return sorted(base + [s for s in added if kept(taken[s[0] : s[2]])])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))


def find(df: DataFrame, field: Field | None, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with an array column ``out`` of the spans (start, kind, end)."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf(_SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in scan(t.as_py(), shared.value)] for t in texts]
            yield pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))

    return df.withColumn(out, run(F.col(text)))


def digest(spans: str = "secrets") -> dict:
    """Columns n_assign, n_access, n_hex, base_sha256 and spans of a column that find() made."""
    join = lambda kept: f"array_join(transform({kept}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    out = {f"n_{k}": F.expr(f"cast(size(filter({spans}, s -> s.kind = '{k}')) as bigint)") for k in KINDS[:3]}
    return out | {"base_sha256": F.sha2(F.expr(join(f"filter({spans}, s -> s.kind <> 'crf')")), 256), "spans": F.expr(join(spans))}


def redact(df: DataFrame, field: Field | None, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """df with every span of the text replaced by the mask; overlapping spans become one. A null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, done = [], 0
        for a, _, b in scan(t, shared.value):
            if a >= done:
                out += [t[done:a], mask]
            done = max(done, b)
        return "".join(out) + t[done:] if out else t

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([clean(t.as_py()) for t in texts], pa.string())

    return df.withColumn(text, run(F.col(text)))
