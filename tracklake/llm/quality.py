"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths give, for each whole text, the characters that lie inside
n-grams found more than once and inside lines found before. Limits on these shares, beside the base
rules, decide whether a document is kept. Each text is judged alone, so no row leaves its partition.

Defined results: a null text counts as an empty one; an empty text has no words and fails the base rules;
repeated rows are judged alike; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Largest share of word characters inside n-grams that occur more than once, by n (published web-text limits).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters and of lines that repeat an earlier line.
LINE_CHAR_LIMIT, LINE_LIMIT = 0.20, 0.30
WINDOW = 5
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in NGRAM_LIMITS)]
RESULT = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


def repeated(hashes: np.ndarray) -> np.ndarray:
    """True where a hash occurs more than once."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(hashes.size, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the words inside a window of n words that begins at one of the starts."""
    edge = np.zeros(size + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> list[int]:
    """The values of FIELDS for one text."""
    text = text or ""
    points = W.code_points(text)
    starts, ends = W.word_bounds(points)
    lengths = ends - starts
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    seen: set[str] = set()
    dup_line_chars = sum(len(x) for x in lines if x in seen or seen.add(x))
    hashes = W.word_hashes(points, starts, ends)
    chars, repeat_words, at = [], 0, None
    for n in NGRAM_LIMITS:
        grams = W.window_hashes(hashes, n)
        # A repeated n-gram begins with a repeated shorter one: only such places are looked at again.
        at = np.arange(grams.size) if at is None else at[at < grams.size]
        at = at[repeated(grams[at])] if at.size else at
        inside = covered(at, n, hashes.size) if at.size else None
        chars.append(0 if inside is None else int(lengths[inside].sum()))
        if n == WINDOW and inside is not None:
            repeat_words = int(inside.sum())
    ascii_points = points[points < 128]
    return [hashes.size, int(lengths.sum()), int(_SYMBOLS[ascii_points].sum()), len(lines), len(lines) - len(set(lines)), dup_line_chars, repeat_words, *chars]


@F.arrow_udf(RESULT)
def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(FIELDS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], FIELDS)


def repetition(df: DataFrame, text: str = "text", out: str = "repetition") -> DataFrame:
    """df with a struct column ``out`` of the measured FIELDS."""
    return df.withColumn(out, _measures(F.col(text)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def passes(m: Column) -> Column:
    """The verdict of the method: no measured share is above its limit."""
    ok = (m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["word_chars"]) & (m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"])
    for n, limit in NGRAM_LIMITS.items():
        ok = ok & (m[f"dup_chars_{n}"] <= F.lit(limit) * m["word_chars"])
    return ok


def kept(m: Column) -> Column:
    return ~base_failed(m) & passes(m)
