"""Numeric claims in prose: extraction, checking against labels, verdicts, safe rewriting, dropping."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import temporal as TE

# The wording of what can be mentioned, who else is on the road, and how far a stated value may be off.
_NUM = r"((?<![\d.])-?\d+(?:\.\d+)?)"
_PAIR = rf"\(\s*{_NUM}\s*,\s*{_NUM}(?:\s*,\s*{_NUM})?\s*\)"
MENTIONS = {
    "ego": r"\bego(?:[- ]vehicle)?(?:'s)?\b",
    "forecast": r"predicted|projected|will be|expected",
    "moment": rf"t\s*=\s*{_NUM}\s*s",
    "pair": _PAIR,
    "position": rf"pos(?:ition)?\s*(?:=|is|of|at)?\s*{_PAIR}",
    "motion": r"speed|velocity|travelling at|moving at",
    "pace": rf"{_NUM}\s*m/s",
    "pace_of": rf"(?:speed|velocity)\s+of\s+{_NUM}\s*m/s",
    "length": rf"(?:at\s+a\s+distance\s+of|distance\s+of|is)\s+{_NUM}\s*m(?!/)\b(?=\s*(?:away|from|ahead|behind|in front|$|[.,;]))",
}
ROAD_USERS = frozenset((
    "sedan", "car", "cars", "truck", "suv", "van", "bus", "pickup", "trailer", "motorcycle", "motorbike", "bicycle", "bike", "cyclist", "rider", "pedestrian",
    "person", "people", "child", "animal", "dog", "scooter", "vehicle", "vehicles", "object",
))
COMPARING = ("faster", "slower", "greater", "larger", "smaller", "less", "more", "closer", "farther", "further", "nearer", "exceed", "exceeds", "higher", "lower", "behind", "than")
RECKONING = ("difference", "sum", "minus", "plus")
TOLERANCE = {"ego_pos": 3.0, "ego_speed": 1.0, "agent_pos": 5.0, "agent_speed": 1.5, "distance": 5.0, "future_pos": 5.0}
#: A claim's mentions in order, each with how many characters may lie before it and which may not.
CHAINS = {
    "future_pos": (("forecast", 0, ""), ("moment", 40, ";"), ("pair", 40, "(;")),
    "ego_pos": (("ego", 0, ""), ("position", 40, ";")),
    "ego_speed": (("ego", 0, ""), ("motion", 60, ";"), ("pace", 15, ";")),
    "agent_pos": (("position", 0, ""),),
    "agent_speed": (("pace_of", 0, ""),),
    "distance": (("length", 0, ""),),
}
#: How far before a distance a position may not stand, and the words for one.
POSITION_REACH, POSITION_WORDS = 40, ("position", "coordinate", "pos=")

#: For any text, and for lower-cased ASCII text (searched much faster).
_MENTIONS, _LOWER = ({k: re.compile(p, flags) for k, p in MENTIONS.items()} for flags in (re.I, 0))
#: What lower-cased ASCII text must hold for each mention: without it, it isn't searched.
_POSSIBLE = {
    "ego": lambda s: "ego" in s, "forecast": lambda s: "predicted" in s or "projected" in s or "will be" in s or "expected" in s, "moment": lambda s: "=" in s, "pair": lambda s: "(" in s,
    "position": lambda s: "(" in s and "pos" in s, "motion": lambda s: "speed" in s or "velocity" in s or "ing at" in s, "pace": lambda s: "m/s" in s,
    "pace_of": lambda s: "m/s" in s and ("speed" in s or "velocity" in s), "length": lambda s: "is" in s,
}
_FRAME, _BREAK, _WORDS = re.compile(r"[Ff]rames?\s+(\d+)"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\w+")

#: How many texts a task remembers, and the size of these and their claims above which it takes up no more.
MAX_TEXTS, MAX_BYTES = 50_000, 64_000_000

_CLAIM = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("horizon_s", T.DoubleType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("value", T.DoubleType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("sentence", T.StringType()),
])
_ARROW = pa.schema([
    ("kind", pa.string()), ("frame", pa.int32()), ("horizon_s", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("value", pa.float64()),
    ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("sentence", pa.string()),
])


class Mentions(dict):
    """The matches of each kind of mention, searched when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.lower = text.lower() if text.isascii() else None

    def __missing__(self, kind: str) -> list[re.Match]:
        if self.lower is None:
            found = list(_MENTIONS[kind].finditer(self.text))
        else:
            found = list(_LOWER[kind].finditer(self.lower)) if _POSSIBLE[kind](self.lower) else []
        self[kind] = found
        return found


class Sentence:
    """A sentence, its place in the text, and what it mentions."""

    def __init__(self, text: str, start: int):
        self.text, self.start = text, start
        self.mentions = Mentions(text)

    def chained(self, steps: tuple[tuple[str, int, str], ...], at: int = 0) -> Iterator[list[re.Match]]:
        """The chains of mentions, each from where the one before ended; of several the nearest mentions."""
        for first in self.mentions[steps[0][0]]:
            if first.start() >= at and (chain := self._completed([first], steps[1:])):
                yield chain
                at = chain[-1].end()

    def _completed(self, chain: list[re.Match], steps: tuple[tuple[str, int, str], ...]) -> list[re.Match] | None:
        if not steps:
            return chain
        (kind, reach, barred), end = steps[0], chain[-1].end()
        for m in self.mentions[kind]:
            gap = self.text[end : m.start()]
            if m.start() >= end and (len(gap) > reach or any(c in gap for c in barred)):
                return None
            if m.start() >= end and (whole := self._completed([*chain, m], steps[1:])):
                return whole
        return None

    def others_between(self, a: int, b: int) -> bool:
        """Whether some road user other than the ego is named between two places."""
        return not ROAD_USERS.isdisjoint(w.lower() for w in _WORDS.findall(_MENTIONS["ego"].sub(" ", self.text[a:b])))

    def claims(self) -> Iterator[tuple[str, list[re.Match]]]:
        """(kind, chain) of all claims: kinds in the order of CHAINS, each in the order of the text."""
        chains = {k: list(self.chained(steps)) for k, steps in CHAINS.items() if self.mentions[steps[0][0]]}
        forecasts = [(c[0].start(), c[-1].end()) for c in chains.get("future_pos", ())]
        owner = {c[-1].start(1): "ego" for c in chains.get("ego_pos", ())}
        owner |= {m.start(1): "forecast" for m in self.mentions["position"] if any(a <= m.start(1) < b for a, b in forecasts)}
        for kind, found in chains.items():
            for chain in found:
                value = chain[-1].start(1)
                if kind in ("ego_pos", "ego_speed") and self.others_between(chain[0].end(), value):
                    continue
                if kind == "ego_pos" and owner[value] != "ego" or kind == "agent_pos" and value in owner:
                    continue
                if kind == "agent_speed" and self.mentions["ego"]:
                    continue
                before = self.text[max(0, chain[0].start() - POSITION_REACH) : chain[0].start()].lower()
                if kind == "distance" and any(w in before for w in POSITION_WORDS):
                    continue
                yield kind, chain


def sentences_of(text: str) -> Iterator[Sentence]:
    start = 0
    for gap in _BREAK.finditer(text):
        yield Sentence(text[start : gap.start()], start)
        start = gap.end()
    yield Sentence(text[start:], start)


def extract(text: str | None) -> list[dict]:
    """The claims of a text in the order of sentences and kinds; offsets are places in the text.

    A frame number holds for the sentences after it. Values inside a prediction belong to it alone; an ego
    claim may have no other road user between the ego and its value; positions that are neither belong to
    some other road user; speeds of others are read only in sentences without the ego; a distance isn't read
    right after a position.
    """
    out: list[dict] = []
    frame = None
    for sentence in sentences_of(text or ""):
        if named := _FRAME.search(sentence.text):
            frame = int(named[1])
        for kind, chain in sentence.claims():
            last = chain[-1]
            places = [last.span(g) for g in ((1, 2) if kind.endswith("_pos") else (1,))]
            values = [float(sentence.text[a:b]) for a, b in places]
            x, y, value = (*values, None) if len(values) == 2 else (None, None, *values)
            out.append({
                "kind": kind, "frame": frame, "horizon_s": float(chain[1][1]) if kind == "future_pos" else None, "x": x, "y": y, "value": value,
                "starts": [sentence.start + a for a, _ in places], "ends": [sentence.start + b for _, b in places], "sentence": sentence.text,
            })
    return out


def _columns(texts: list[str | None]) -> pa.Array:
    """extract() of each text as one Arrow array, built by columns."""
    every = [extract(t) for t in texts]
    flat = [c for found in every for c in found]

    def lists(values: list[list], kind: pa.DataType | None = None) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array([v for vs in values for v in vs], kind))

    column = lambda f: lists([c[f.name] for c in flat], pa.int32()) if pa.types.is_list(f.type) else pa.array([c[f.name] for c in flat], f.type)
    structs = pa.StructArray.from_arrays([column(f) for f in _ARROW], fields=list(_ARROW))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)], dtype=np.int32)), structs)


class Remembered:
    """The claims of texts seen before in one Arrow array, from which rows are taken; it starts anew when full."""

    def __init__(self, texts: int = MAX_TEXTS, size: int = MAX_BYTES):
        self.limits = texts, size
        self.clear()

    def clear(self) -> None:
        self.places: dict[str | None, int] = {}
        self.chars, self.claims = 0, _columns([])

    def of(self, texts: pa.Array) -> pa.Array:
        """The claims of each text."""
        coded = texts.dictionary_encode(null_encoding="encode")
        distinct = coded.dictionary.to_pylist()
        new = [t for t in distinct if t not in self.places]
        if new and (len(self.places) + len(new) > self.limits[0] or self.chars + self.claims.nbytes > self.limits[1]):
            self.clear()
            new = distinct
        if new:
            self.places |= {t: i for i, t in enumerate(new, len(self.places))}
            self.chars += sum(len(t or "") for t in new)
            self.claims = pa.concat_arrays([self.claims, _columns(new)])
        places = np.array([self.places[t] for t in distinct], np.int32)
        return self.claims.take(pa.array(places[coded.indices.to_numpy()]))


def claims(df: DataFrame, text: str, out: str = "claims") -> DataFrame:
    """df with an array of the text's claims; a task reads a text that many rows have once, as far as it remembers it."""

    @F.arrow_udf(T.ArrayType(_CLAIM))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Remembered()
        for texts in batches:
            yield known.of(texts)

    # otherwise the filter that Catalyst infers from an explode of the claims reads every text a second time
    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def evaluate(found: DataFrame, ego: DataFrame, objects: DataFrame, window: float = 0.6, last_frame: int = 19) -> DataFrame:
    """Claims (clip_id, claim_id, kind, frame, horizon_s, x, y, value) with ``error`` and ``computed``; null where nothing is labelled.

    ego: clip_id, t, x, y, speed. objects: clip_id, track_id, t, wx, wy, speed, rng. Frame N is second N - 1.
    """
    at = (F.coalesce("frame", F.lit(last_frame)) - 1).cast("double") + F.coalesce("horizon_s", F.lit(0.0))
    timed = found.withColumn("t", at)
    timed = TE.nearest_join(timed, ego, ["clip_id"], "t", ["x", "y", "speed"]).withColumnRenamed("near", "ego")
    pairs = TE.band_join(timed.select("clip_id", "claim_id", "t", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("value").alias("cv")), objects.withColumnRenamed("t", "ot"), ["clip_id"], "t", window, "ot")
    pairs = TE.nearest_per_track(pairs, ["clip_id", "claim_id"], "track_id", "t", "ot")
    apart, slower, nearer = F.hypot(F.col("wx") - F.col("cx"), F.col("wy") - F.col("cy")), F.abs(F.col("speed") - F.col("cv")), F.abs(F.col("rng") - F.col("cv"))
    best = pairs.groupBy("clip_id", "claim_id").agg(
        F.min(apart).alias("d_pos"), F.min_by(F.struct("wx", "wy"), F.struct(apart, "track_id")).alias("o_pos"),
        F.min(slower).alias("d_speed"), F.min_by("speed", F.struct(slower, "track_id")).alias("o_speed"),
        F.min(nearer).alias("d_rng"), F.min_by("rng", F.struct(nearer, "track_id")).alias("o_rng"),
    )
    rows = timed.join(best, ["clip_id", "claim_id"], "left")
    kind = F.col("kind")
    own = F.hypot(F.col("ego.x") - F.col("x"), F.col("ego.y") - F.col("y"))
    error = (
        F.when(kind == "ego_pos", own).when(kind == "ego_speed", F.abs(F.col("ego.speed") - F.col("value"))).when(kind == "agent_pos", F.col("d_pos"))
        .when(kind == "agent_speed", F.col("d_speed")).when(kind == "distance", F.col("d_rng")).when(kind == "future_pos", F.least(own, F.col("d_pos")))
    )
    mine, other = F.array("ego.x", "ego.y"), F.array("o_pos.wx", "o_pos.wy")
    computed = (
        F.when(kind == "ego_pos", mine).when(kind == "ego_speed", F.array("ego.speed")).when(kind == "agent_pos", other)
        .when(kind == "agent_speed", F.array("o_speed")).when(kind == "distance", F.array("o_rng")).when(kind == "future_pos", F.when(F.coalesce(own <= F.col("d_pos"), F.lit(True)), mine).otherwise(other))
    )
    rows = rows.withColumn("error", error).withColumn("computed", F.when(F.col("error").isNotNull(), computed))
    limit = F.create_map(*[F.lit(v) for kv in TOLERANCE.items() for v in kv])[kind]
    return rows.withColumn("ok", F.col("error") <= limit).drop("ego", "t", "d_pos", "o_pos", "d_speed", "o_speed", "d_rng", "o_rng")


def status(checked: DataFrame, by: list[str]) -> DataFrame:
    """Per item: n_checks, n_pass, and unchecked, agrees or disagrees; an item without a checkable claim is unchecked."""
    out = checked.groupBy(*by).agg(F.count("error").alias("n_checks"), F.count_if("ok").alias("n_pass"))
    return out.withColumn("status", F.when(F.col("n_checks") == 0, "unchecked").when(F.col("n_pass") == F.col("n_checks"), "agrees").otherwise("disagrees"))


def quality_report(checked: DataFrame) -> DataFrame:
    """Per kind: checked claims, pass rate, median and 90th percentile of the error."""
    seen = checked.where("error IS NOT NULL")
    return seen.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("rate"), F.median("error").alias("median_error"), F.percentile("error", 0.9).alias("p90_error"))


def verdict(stated: Column, sentence: Column, question: Column, options: Column) -> Column:
    """Why a wrong claim may or may not be rewritten; the first that holds."""
    asked = F.concat_ws(" ", question, F.array_join(F.map_values(options), " "))
    said = F.regexp_extract_all(F.lower(sentence), F.lit(r"(?U)\w+"), F.lit(0))
    names = lambda words: F.arrays_overlap(said, F.array(*[F.lit(w) for w in words]))
    reasons = {
        "answer_dependent": F.array_contains(F.regexp_extract_all(F.coalesce(asked, F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), stated),
        "range": sentence.rlike(r"\d(?:\.\d+)?\s*(?:-|–|to)\s*\d"),
        "arithmetic": names(RECKONING) | sentence.contains("=") | sentence.rlike(r"\s[-+]\s"),
        "comparative": names(COMPARING) | sentence.rlike(r"(?iU)\bahead of\b") | (F.translate(sentence, "<>", "") != sentence),
    }
    return F.coalesce(*[F.when(holds, F.lit(reason)) for reason, holds in reasons.items()], F.lit("safe"))


def like(original: Column, value: Column) -> Column:
    """The value with as many decimals as the original text has."""
    decimals = F.length(F.regexp_extract(original, r"\.(\d+)$", 1))
    out = F.format_string("%.0f", F.bround(value, 0))
    for d in range(1, 7):
        out = F.when(decimals >= d, F.format_string(f"%.{d}f", F.bround(value, d))).otherwise(out)
    return out


def substitute(text: Column, edits: Column) -> Column:
    """The text with edits (start, end, text) applied from the right, so that earlier places stay valid."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["text"], F.substring(t, e["end"] + 1, F.length(t))))


def bad_id(item_id: Column, chunk: Column, clip: Column) -> Column:
    """What is wrong with an item's id, or ok."""
    number = F.format_string("%04d", chunk)
    form = r"^chunk_(\d{4})_(.+)\.mp4_Q\d+$"
    return (
        F.when(F.coalesce(item_id, F.lit("")) == "", "missing").when(~item_id.rlike(r"_Q\d+$"), "no_question_suffix")
        .when(~item_id.rlike(form), F.when(F.length(item_id) - F.length(F.replace(item_id, number, F.lit(""))) > 4, "duplicated_chunk").otherwise("malformed"))
        .when(F.regexp_extract(item_id, form, 2) != clip, "wrong_clip_id").when(F.regexp_extract(item_id, form, 1) != number, "wrong_chunk").otherwise("ok")
    )


def expected_id(chunk: Column, clip: Column, index: Column) -> Column:
    return F.format_string("chunk_%04d_%s.mp4_Q%d", chunk, clip, index)


def pad_options(options: Column, fillers: list[str]) -> Column:
    """Options with the first missing letter of A to E filled by the first filler that no option says already."""
    letters = F.array(*[F.lit(c) for c in "ABCDE"])
    used = F.transform(F.map_values(options), lambda v: F.lower(F.trim(v)))
    letter = F.get(F.array_except(letters, F.map_keys(options)), F.lit(0))
    filler = F.get(F.filter(F.array(*[F.lit(f) for f in fillers]), lambda f: ~F.array_contains(used, F.lower(F.trim(f)))), F.lit(0))
    return F.when((F.size(options) < 5) & filler.isNotNull(), F.map_concat(options, F.map_from_arrays(F.array(letter), F.array(filler)))).otherwise(options)


def drop_unsafe(docs: DataFrame, verdicts: list[str]) -> DataFrame:
    """docs (clip_id, chunk, qa) without items that have an unsafe verdict; the rest are numbered anew and keep original_id; empty documents go."""
    unsafe = F.array(*[F.lit(v) for v in verdicts])
    kept = F.filter("qa", lambda q: ~F.coalesce(F.arrays_overlap(F.transform(q["corrections"], lambda c: c["verdict"]), unsafe), F.lit(False)))
    docs = docs.withColumn("qa", kept).where(F.size("qa") > 0)
    again = F.transform("qa", lambda q, i: q.withField("original_id", q["id"]).withField("id", expected_id(F.col("chunk"), F.col("clip_id"), i + 1)))
    return docs.withColumn("qa", again).withColumn("n_qa", F.size("qa"))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "claim_id") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
