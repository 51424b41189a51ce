"""Numbers: bins, bands, guarded ratios, and numbers as text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, decimals: int = 0, plus: bool = False) -> Column:
    """x with so many decimals, ties to even as in binary floating-point formatting; a sign for plus."""
    sign = F.when(x < 0, "-").otherwise("+" if plus else "")  # also of a number that rounds to zero
    text = F.concat(sign, F.format_string(f"%.{decimals}f", F.abs(F.bround(x, decimals)).cast("double")))
    return F.when(x.isNull(), None).otherwise(text)


def round_even(x: Column, decimals: int) -> Column:
    """x rounded as a binary number: the product with the power of ten, not x's decimal text, tells what is halfway."""
    return F.rint(x * float(10**decimals)) / float(10**decimals)


def band(x: Column, step: float) -> Column:
    """The nearest multiple of step, ties to the even multiple."""
    return F.bround(x / step, 0) * step


def digitise(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin 0 to bins-1 of equal width; values beyond fall into the end bins, NaN into the last."""
    place = F.least(F.greatest(F.floor((x - low) / ((high - low) / bins)).cast("int"), F.lit(0)), F.lit(bins - 1))
    return F.when(F.isnan(x.cast("double")), F.lit(bins - 1)).when(x.isNull(), None).otherwise(place)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn); 0 without any."""
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def decay(error: Column, half: float) -> Column:
    """1 without error, one half at ``half``, and towards 0."""
    return F.lit(half) / (F.lit(half) + F.greatest(error, F.lit(0.0)))


def finite(x: Column, decimals: int = 4) -> Column:
    """x rounded, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x, decimals))


def lookup(x: Column, table: Mapping[str, str]) -> Column:
    """x mapped by a small fixed table; null for what the table hasn't."""
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x]


def vision_tokens(width: int, height: int, patch: int = 14, merge: int = 2) -> int:
    """How many merged patches a frame of this size has."""
    side = patch * merge
    return max(1, width // side) * max(1, height // side)


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each evaluated once however often f uses it; plain reuse of a column repeats its whole tree."""
    names = [f"v{i}" for i in range(len(values))]
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])), lambda s: f(*[s[n] for n in names])), F.lit(0))
