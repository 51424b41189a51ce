"""Mixing sources to target weights by hierarchical budgeting.

Documents hang as leaves' contents in a tree of levels (domain, language, source). A leaf can supply its
tokens times ``max_epochs``; a node can supply what its children can. From the root down, each node's budget
goes to its children by weight; what a child can't take goes to its siblings, by weight again, and since a
node never gets more than it can supply, only what no sibling can take has gone to the parent's siblings.
This water-filling has a closed form: children in order of capacity per weight, the saturated ones first.
Budgets are whole tokens; at each node less than one token per child stays unspent.

A leaf's budget is a prefix of its token stream: whole passes over the leaf, then a pass in the order of a
hash seeded with the number of the pass, up to the budget: the document in which it ends gives only its
first tokens, so the tokens taken are the leaf's budget exactly. The stream is cut into ranges of that hash, 256
or as many more as the leaf has documents for, whose sums show in which range the prefix ends; only this one range
is ordered. So no task holds a leaf, and the result of a leaf is a number of passes and one hash to compare with.

Defined results: a null level counts as ``unknown``; a null or empty text has no tokens and is taken only
within a prefix or a whole pass; weights that aren't given are 1, weight 0 takes nothing; rows with equal ids
are ordered by their tokens, then by their text's hash; of equal rows as many are taken as the budget has room
for; rows without an id are ordered by their text; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, rekey, store

#: A token here is a word: a run of characters other than space, tab, line breaks and the like.
WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _text_hash(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _key(turn: Column, name: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), turn.cast("string"), name))


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent's columns, name, capacity, weight, given) with ``budget``: each one's part of ``given``."""
    big = "decimal(38,0)"
    order = [F.col("weight") == 0, F.col("capacity") / F.greatest("weight", F.lit(1)), F.col(name)]
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumn("_spent", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(big)).withColumn("_weights", F.sum("weight").over(after).cast(big))
    full = F.col("capacity").cast(big) * F.col("_weights") <= F.col("weight").cast(big) * (F.col("given").cast(big) - F.col("_spent"))
    nodes = nodes.withColumn("_full", full & (F.col("weight") > 0))
    nodes = nodes.withColumn("_left", F.col("given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0)))
    nodes = nodes.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), F.lit(0)))
    share = F.expr("coalesce(case when _open > 0 then cast((cast(weight as decimal(19,0)) * cast(_left as decimal(19,0))) div cast(_open as decimal(19,0)) as bigint) end, 0)")
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least("capacity", share))).drop("_spent", "_weights", "_full", "_left", "_open")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level) or {}
    if not given:
        return F.lit(1).cast("long")
    return F.coalesce(F.create_map(*[F.lit(x) for k, w in given.items() for x in (k, int(w))])[F.col(level)], F.lit(1)).cast("long")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """leaves (the LEVELS, n_tokens) with ``budget``."""
    a, b, c = LEVELS
    leaves = leaves.withColumn("capacity", F.col("n_tokens") * max_epochs)
    middle = leaves.groupBy(a, b).agg(F.sum("capacity").alias("capacity"), F.sum("n_tokens").alias("n_tokens"))
    top = middle.groupBy(a).agg(F.sum("capacity").alias("capacity"), F.sum("n_tokens").alias("n_tokens"))
    whole = Window.partitionBy(F.lit(0))
    top = top.withColumn("_all", F.sum("n_tokens").over(whole)).withColumn("given", F.least(F.expr(f"_all * {int(percent)} div 100"), F.sum("capacity").over(whole)))
    top = water_fill(top.withColumn("weight", _weight(a, weights)), [], a).select(F.col(a).alias("_a"), F.col("budget").alias("given"))
    middle = middle.join(top, middle[a] == top["_a"]).drop("_a")
    middle = water_fill(middle.withColumn("weight", _weight(b, weights)), [a], b).select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("budget").alias("given"))
    leaves = leaves.join(middle, (leaves[a] == middle["_a"]) & (leaves[b] == middle["_b"])).drop("_a", "_b")
    return water_fill(leaves.withColumn("weight", _weight(c, weights)), [a, b], c).select(*LEVELS, "n_tokens", "budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int = 50, max_epochs: int = 2, seed: int = 19, text: str = "text", rows_per_range: int = 50_000) -> DataFrame:
    """docs with ``_mix``: a struct of the levels, n_tokens, copies (how often the whole document is taken) and
    prefix_tokens (how many first tokens are taken once more, where the leaf's budget ends in the document).

    The total budget is ``percent`` hundredths of all tokens.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    level = F.struct(name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), tokens(text).alias("n_tokens"))
    rows = docs.withColumn("_mix", level).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), _text_hash(F.col(text)))))
    leaf = lambda s: F.to_json(F.struct(*[F.col(f"{s}{x}").alias(x) for x in LEVELS]))
    narrow = store(rows.select(F.col("_id").alias("id"), "_mix.*").withColumn("leaf", leaf("")))
    leaves = store(narrow.groupBy(*LEVELS, "leaf").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")))
    found = budgets(leaves.drop("leaf", "n_docs"), weights, percent, max_epochs)
    found = found.withColumn("leaf", leaf("")).withColumn("passes", F.expr("case when n_tokens > 0 then least(budget div n_tokens, 9223372036854775807) else 0 end"))
    found = found.select("leaf", "passes", (F.col("budget") - F.col("passes") * F.col("n_tokens")).alias("rest"))
    # hexadecimal digits of the hash that tell a leaf's ranges apart
    digits = F.least(F.lit(15), F.greatest(F.lit(2), F.ceil(F.log(16.0, F.col("n_docs") / rows_per_range)))).cast("int")
    found = store(found.join(leaves.select(F.col("leaf").alias("of"), digits.alias("digits")), F.col("leaf") == F.col("of")).drop("leaf"))
    # where the last, partial pass of each leaf ends
    part = narrow.select("id", "leaf", "n_tokens").join(found.where("rest > 0"), F.col("leaf") == F.col("of"))
    part = part.withColumn("key", _key(F.col("passes"), F.col("id"), seed)).withColumn("range", F.expr("substring(key, 1, digits)"))
    sums = part.groupBy("leaf", "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    up_to = Window.partitionBy("leaf").orderBy("range")
    sums = sums.withColumn("before", F.sum("n").over(up_to) - F.col("n"))
    last = sums.where("before < rest AND before + n >= rest").select(F.col("leaf").alias("l"), rekey(F.col("range"), "string").alias("r"), "before")
    inside = part.join(last, (F.col("leaf") == F.col("l")) & (F.col("range") == F.col("r")))
    run = Window.partitionBy("leaf").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    inside = inside.where("start < rest").withColumn("taken", F.expr("least(n_tokens, rest - start)"))
    # rows of one key and size are alike here: so many of the last are taken whole, and of one more the first tokens
    alike = inside.groupBy("leaf", "key", "n_tokens").agg(F.sum(F.expr("cast(taken = n_tokens as long)")).alias("whole"), F.sum(F.expr("case when taken < n_tokens then taken else 0 end")).alias("taken"))
    ends = alike.groupBy("leaf").agg(F.max(F.struct("key", "n_tokens", "whole", "taken")).alias("end"))
    found = found.join(ends.select(F.col("leaf").alias("l"), "end"), F.col("of") == F.col("l"), "left").drop("l")
    found = store(found.select(rekey(F.col("of"), "string").alias("_of"), F.col("passes").alias("_passes"), F.col("end").alias("_stop")))
    rows = rows.withColumn("_leaf", leaf("_mix."))
    rows = rows.join(found, rows["_leaf"] == found["_of"], "left")
    stop, mine = F.col("_stop"), F.struct(_key(F.col("_passes"), F.col("_id"), seed).alias("key"), F.col("_mix.n_tokens").alias("n_tokens"))
    rows = rows.withColumn("_mine", mine).withColumn("_last", F.struct(stop["key"].alias("key"), stop["n_tokens"].alias("n_tokens")))
    at_end = stop.isNotNull() & (F.col("_mine") == F.col("_last"))
    # a single row at the end is the first of its kind; only several need numbers
    several = store(found.select("_of", "_passes", stop["key"].alias("key"), stop["n_tokens"].alias("size")).join(narrow, (F.col("_of") == F.col("leaf")) & (F.col("size") == F.col("n_tokens")) & (_key(F.col("_passes"), F.col("id"), seed) == F.col("key"))).groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"))
    drop(narrow, leaves)
    if several.isEmpty():
        rows = rows.withColumn("_place", F.lit(1))
    else:
        order = Window.partitionBy("_leaf").orderBy(_text_hash(F.col(text)))
        rows = rows.where(~at_end).withColumn("_place", F.lit(1)).unionByName(rows.where(at_end).withColumn("_place", F.row_number().over(order)))
    drop(several)
    whole = stop.isNotNull() & ((F.col("_mine") < F.col("_last")) | (at_end & (F.col("_place") <= stop["whole"])))
    part = F.when(at_end & (F.col("_place") == stop["whole"] + 1), stop["taken"])
    copies = F.coalesce(F.col("_passes"), F.lit(0)) + F.coalesce(whole, F.lit(False)).cast("long")
    rows = rows.withColumn("_mix", F.col("_mix").withField("copies", copies).withField("prefix_tokens", F.coalesce(part, F.lit(0)).cast("long")))
    return rows.drop("_id", "_leaf", "_of", "_passes", "_stop", "_mine", "_last", "_place")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n.cast("int")), "")


def number_domain(source: str = "source") -> Column:
    """A domain for sources named by a number: its remainder by three picks web, books or code; null for null."""
    number = F.regexp_extract(F.col(source), r"([0-9]{1,9})$", 1)
    return F.when(F.col(source).isNull(), F.lit(None).cast("string")).when(number == "", F.lit("other")).otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (F.when(number == "", "0").otherwise(number).cast("int") % 3 + 1).cast("int")))


#: The weights of the query and of the pipeline.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
