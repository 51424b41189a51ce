"""Parsing and writing of answer texts, as column expressions.

One pattern with alternatives scans an answer from the left, so objects need no separator; each of its groups
is one ``regexp_extract_all``, and the aligned arrays are zipped into structs. No Python is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in which answers state objects, horizons, choices and claims.
_N = r"[+-]?\d+(?:\.\d+)?"
_U = r"\d+(?:\.\d+)?"
_BOX = r"\s*\[\s*(\d+)(?:px)?\s*,\s*(\d+)(?:px)?\s*,\s*(\d+)(?:px)?\s*,\s*(\d+)(?:px)?\s*\]"
_POINT = rf"\s*\(\s*({_N})m?\s*,\s*({_N})m?\s*,\s*({_N})m?\s*\)"
_EXTENT = rf"(?:\s+(?:size\s+)?({_U})m?\s*x\s*({_U})m?\s*x\s*({_U})(?:\s*m)?)?"
_TURN = rf"(?:\s+yaw\s+({_N})(?:\s*deg)?)?(?:\s+heading\s+(\d+))?"
_MOTION = rf"(?:\s+vel\s+({_N})m/s\s+({_N})m/s)?(?:\s+(stopped|standing|with_rider))?"
_POLAR = rf"\s+(-?{_U})\s*m\b(?!/)(?:\s*az\s*({_N})\s*deg)?"
OBJECT = rf"(?:#(\d+)\s+)?([a-z_]+)(?:{_BOX}|{_POINT}{_EXTENT}{_TURN}{_MOTION}|{_POLAR})(\s+moving|\s+stationary)?"
WAYPOINT = rf"\+(\d)s\s*\(\s*({_N})m?\s*,\s*({_N})m?\s*\)"
HORIZON = rf"\+(\d)s\s+(-?{_U})\s*m\s*az\s*({_N})"
HORIZON_BOX = rf"\+(\d)s{_BOX}"
LEAVES = "leaves the forward sector"
CONTROL = rf"\+(\d)s\s+(-?{_U})\s*m/s\s*,\s*yaw\s*({_N})\s*deg/s"
NUMBER = rf"-?{_U}"
CHOICE = r"(?<![A-Za-z])([A-E])(?![A-Za-z])"
RATIONALE = r'(?s)"rationale"\s*:\s*"(.*?)"\s*,\s*"answer"\s*:\s*"(.*?)"\s*\}'
CLAIM_WORDS = ["accelerating", "braking", "steady", "turning", "left", "right", "moving", "stationary", "closing", "receding", "none", "all", "some", "camera", "radar", "car", "cars", "truck", "trucks", "person", "people", "bus", "rider"]
ANTONYMS = [("all", "none"), ("moving", "stationary"), ("closing", "receding"), ("accelerating", "braking"), ("left", "right")]

_FIELDS = ["tid", "cls", "moving", "x", "y", "z", "l", "w", "h", "yaw", "sector", "vx", "vy", "attr", "rng", "az", "x1", "y1", "x2", "y2"]


def found(text: Column, pattern: str, groups: int) -> Column:
    """An array with a struct g1, g2, ... of the groups of every match; groups without a part are null."""
    parts = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i + 1)).alias(f"g{i + 1}") for i in range(groups)]
    return F.arrays_zip(*parts)


def _number(c: Column) -> Column:
    return F.when(c != "", c).cast("double")


def objects(text: Column) -> Column:
    """Every object of an answer: an array of structs in the order of the text.

    One replacement passes over the text and leaves the groups of each match, which hold neither commas nor semicolons:
    a record for each object and an empty one for the rest of the text.
    """
    from .numbers import let

    groups = ["tid", "cls", "x1", "y1", "x2", "y2", "x", "y", "z", "l", "w", "h", "yaw", "sector", "vx", "vy", "attr", "rng", "az", "motion"]
    records = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(rf"(?s:.*?)(?:{OBJECT}|\z)"), F.lit(",".join(f"${i}" for i in range(1, len(groups) + 1)) + ";"))

    def one(parts: Column) -> Column:
        given = {k: F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i, k in enumerate(groups)}
        given |= {k: c.cast("double") for k, c in given.items() if k not in ("tid", "cls", "attr", "motion")}
        given |= {"tid": given["tid"].cast("int"), "moving": F.coalesce(given["motion"].contains("moving"), F.lit(False))}
        return let(built, *[given[k] for k in _FIELDS])

    def built(*values: Column) -> Column:
        v = dict(zip(_FIELDS, values, strict=True))
        sector = F.pmod(v["sector"] * 30.0 + 180.0, F.lit(360.0)) - 180.0
        return F.struct(
            v["tid"].alias("tid"), v["cls"].alias("cls"),
            F.when(v["x"].isNotNull(), F.hypot(v["x"], v["y"])).otherwise(v["rng"]).alias("rng"),
            F.when(v["x"].isNotNull(), F.degrees(F.atan2(v["y"], v["x"]))).when(v["rng"].isNotNull(), F.coalesce(v["az"], F.lit(0.0))).alias("az"),
            v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"),
            F.when(v["x1"].isNotNull(), F.array(*[v[k] for k in ("x1", "y1", "x2", "y2")])).alias("bbox"),
            F.when(v["l"].isNotNull(), F.array(v["l"], v["w"], v["h"])).alias("size"),
            F.coalesce(v["yaw"], sector).alias("yaw"),
            F.when(v["vx"].isNotNull(), F.array(v["vx"], v["vy"])).alias("vel"),
            F.coalesce(v["attr"], F.when(v["moving"], F.lit("moving"))).alias("attr"),
            v["moving"].alias("moving"),
            (v["x"].isNotNull() | v["az"].isNotNull()).alias("has_az"),
        )

    # without the empty records, which stand last, and the empty fields at the end of the last object
    filled = F.array_remove(F.split(F.rtrim(records, F.lit(",;")), ";"), "")
    return F.transform(F.transform(filled, lambda m: F.split(m, ",")), one)


def split_objects(text: Column) -> Column:
    """The older reading: parts between semicolons, each a polar object."""
    part = r"(?:#(\d+)\s+)?([a-z_]+)\s+(-?\d+(?:\.\d+)?)\s*m(?:\s*az\s*([+-]?\d+(?:\.\d+)?)\s*deg)?(\s+moving)?"

    def one(p: Column) -> Column:
        g = [F.regexp_extract(p, part, i) for i in range(1, 6)]
        return F.struct(F.when(g[0] != "", g[0]).cast("int").alias("tid"), F.when(g[1] != "", g[1]).alias("cls"), _number(g[2]).alias("rng"), _number(g[3]).alias("az"), (g[4] != "").alias("moving"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), one), lambda o: o["cls"].isNotNull())


def waypoints(text: Column) -> Column:
    """A map horizon -> [x, y]; of a repeated horizon the last."""
    return F.map_from_entries(F.transform(found(text, WAYPOINT, 3), lambda m: F.struct(m["g1"].cast("int"), F.array(_number(m["g2"]), _number(m["g3"])))))


def controls(text: Column) -> Column:
    """A map horizon -> [speed, yaw rate]."""
    return F.map_from_entries(F.transform(found(text, CONTROL, 3), lambda m: F.struct(m["g1"].cast("int"), F.array(_number(m["g2"]), _number(m["g3"])))))


def horizons(text: Column) -> Column:
    """A map horizon -> struct(kind, values): polar, xy, bbox or gone."""
    kind = "struct<kind:string,values:array<double>>"
    entry = lambda h, k, *v: F.struct(h.cast("int"), F.struct(F.lit(k).alias("kind"), (F.array(*v) if v else F.array().cast("array<double>")).alias("values")).cast(kind))
    polar = F.transform(found(text, HORIZON, 3), lambda m: entry(m["g1"], "polar", _number(m["g2"]), _number(m["g3"])))
    xy = F.transform(found(text, WAYPOINT, 3), lambda m: entry(m["g1"], "xy", _number(m["g2"]), _number(m["g3"])))
    box = F.transform(found(text, HORIZON_BOX, 5), lambda m: entry(m["g1"], "bbox", *[_number(m[f"g{i}"]) for i in range(2, 6)]))
    gone = F.transform(found(text, rf"\+(\d)s\s+{LEAVES}", 1), lambda m: entry(m["g1"], "gone"))
    return F.map_from_entries(F.concat(polar, xy, box, gone))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def first_number(text: Column) -> Column:
    return _number(F.regexp_extract(F.coalesce(text, F.lit("")), NUMBER, 0))


def choice(text: Column) -> Column:
    """The first letter A to E that stands alone."""
    letter = F.regexp_extract(F.coalesce(text, F.lit("")), CHOICE, 1)
    return F.when(letter != "", letter)


def tags(text: Column) -> Column:
    """The distinct parts between semicolons, trimmed and lower-cased."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ";"), lambda t: F.trim(t)), lambda t: t != ""))


def claim_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_intersect(F.array(*[F.lit(w) for w in CLAIM_WORDS]), words)


def contradictions(a: Column, b: Column) -> Column:
    has = F.array_contains
    hit = [(has(a, x) & has(b, y)) | (has(a, y) & has(b, x)) for x, y in ANTONYMS]
    return sum((h.cast("int") for h in hit), F.lit(0))


def rationale(text: Column) -> tuple[Column, Column]:
    """The rationale (null without the format) and the answer (else the whole text)."""
    fits = text.rlike(RATIONALE)
    return F.when(fits, F.regexp_extract(text, RATIONALE, 1)), F.when(fits, F.regexp_extract(text, RATIONALE, 2)).otherwise(text)


def question_form(asked: Column, phrases: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The form of the first phrase, in their order, that the question contains."""
    out = F.lit(other)
    for phrase, form in reversed(phrases):
        out = F.when(F.lower(asked).contains(phrase), F.lit(form)).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """An array of structs (sentence, start) with the start's place in the text, by one running sum."""
    text, gap = F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"
    parts = F.zip_with(F.split(text, gap), F.regexp_extract_all(text, F.lit(gap), F.lit(0)), lambda s, g: F.struct(s.alias("s"), (F.length(s) + F.coalesce(F.length(g), F.lit(0))).alias("n")))
    kind = "struct<at:int,out:array<struct<sentence:string,start:int>>>"
    none = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)
    step = lambda a, p: F.struct((a["at"] + p["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(p["s"].alias("sentence"), a["at"].alias("start")))).alias("out")).cast(kind)
    return F.aggregate(parts, none, step, lambda a: a["out"])


def frame_reference(text: Column, last: int = 19) -> Column:
    """The first ``Frame N`` of a text, clipped to the frames there are; the last without one."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)frames?\s+(\d{1,6})", 1)
    return F.when(n == "", F.lit(last)).otherwise(F.least(F.greatest(n.try_cast("int"), F.lit(0)), F.lit(last)))


def pick(options: Sequence[str], *key: Column) -> Column:
    """One of the options, chosen by the MD5 of the key."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") % len(options)
    return F.element_at(F.array(*[F.lit(o) for o in options]), (place + 1).cast("int"))


def rotate_by_sha1(key: Column, n: int) -> Column:
    """A place 0 to n-1 by the SHA-1 of the key."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % n).cast("int")


def split_unit(text: Column) -> tuple[Column, Column]:
    """``37m`` as 37.0 and ``m``."""
    p = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z/%°]*)\s*$"
    unit = F.regexp_extract(text, p, 2)
    return _number(F.regexp_extract(text, p, 1)), F.when(unit != "", unit)


def path_parts(path: Column) -> tuple[Column, Column]:
    """The number after ``chunk_`` and the file name without its extension."""
    n = F.regexp_extract(path, r"chunk_(\d+)", 1)
    return F.when(n != "", n).cast("int"), F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def squeeze(text: Column, placeholder: str = r"<[a-z_]+>") -> Column:
    """Placeholders out, runs of blank lines to one break."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, placeholder, ""), r"\n\s*\n+", "\n"))


def elide(text: Column, head: int, tail: int) -> Column:
    """The first and last words of a long text."""
    words = F.split(text, " ")
    n = F.size(words)
    return F.when(n <= head + tail, text).otherwise(F.concat_ws(" ", F.slice(words, 1, head), F.lit("..."), F.slice(words, -tail, tail)))


def options_text(options: Column) -> Column:
    """``K. V`` lines of an options map in the order of their letters."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def token_values(text: Column, axis: str) -> Column:
    """The bins of an axis's tokens such as ``<x_512>``."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"<{axis}_(\d+)>"), F.lit(1)), lambda v: v.cast("int"))


def token_text(codes: Column) -> Column:
    """Bin pairs as tokens ``<x_i><y_j>``."""
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<x_"), c[0].cast("string"), F.lit("><y_"), c[1].cast("string"), F.lit(">"))), "")


def double_numbers(text: Column) -> Column:
    """Every number doubled: a negative control for scorers."""
    t = F.coalesce(text, F.lit(""))
    between = F.split(t, NUMBER)
    values = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))

    def twice(v: Column) -> Column:
        whole = (v.cast("double") * 2).cast("decimal(30,6)").cast("string")
        return F.regexp_replace(F.regexp_replace(whole, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(twice(F.try_element_at(values, i + 1)), F.lit("")))), "")


# ---------------------------------------------------------------- writing


def describe_polar(cls: Column, rng: Column, az: Column, moving: Column | None = None, tid: Column | None = None) -> Column:
    from .numbers import fixed

    head = F.concat(F.lit("#"), tid.cast("string"), F.lit(" "), cls) if tid is not None else cls
    tail = F.when(moving, F.lit(" moving")).otherwise(F.lit("")) if moving is not None else F.lit("")
    return F.concat(head, F.lit(" "), fixed(rng), F.lit("m az"), fixed(az, 0, plus=True), F.lit("deg"), tail)


def describe_point(cls: Column, x: Column, y: Column, z: Column, size: tuple[Column, Column, Column] | None = None, sector: Column | None = None) -> Column:
    from .numbers import fixed

    out = F.concat(cls, F.lit(" ("), fixed(x, 1), F.lit("m, "), fixed(y, 1), F.lit("m, "), fixed(z, 1), F.lit("m)"))
    if size is not None:
        out = F.concat(out, F.lit(" size "), fixed(size[0], 1), F.lit("mx"), fixed(size[1], 1), F.lit("mx"), fixed(size[2], 1), F.lit("m"))
    return F.concat(out, F.lit(" heading "), sector.cast("string")) if sector is not None else out


def listed(items: Column, empty: str) -> Column:
    """Items joined by semicolons; the phrase for an empty list."""
    return F.when(F.size(items) == 0, F.lit(empty)).otherwise(F.array_join(items, "; "))


def reasoned(rationale_text: Column, answer: Column) -> Column:
    """A JSON object of a rationale and an answer, with a space after colons and commas."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.concat(F.lit('{"rationale": '), quoted(rationale_text), F.lit(', "answer": '), quoted(answer), F.lit("}"))


def mean_abs_azimuth(text: Column) -> Column:
    """The mean size of the azimuths that a text states; null without any."""
    stated = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"az\s*({_N})"), F.lit(1)), lambda v: F.abs(v.cast("double")))
    return F.try_divide(F.aggregate(stated, F.lit(0.0), lambda s, v: s + v), F.size(stated))
