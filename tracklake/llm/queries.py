"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neardup, pieces, quality, secretscan, sharding, topk, urls, warc
from .shared import table

#: The public vocabulary that op7 and the pipeline use; other models by parameter.
PIECES = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("url")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.find(docs, secretscan.train(docs))
    return found.select("doc_id", *[c.alias(k) for k, c in secretscan.digest().items()])


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, pieces.load(PIECES))
    ids = F.concat_ws(",", F.col("pieces.ids").cast("array<string>"))
    return found.select("doc_id", F.size("pieces.ids").cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), "pieces.round_trip")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, mixing.number_domain(), mixing.WEIGHTS).select("doc_id", "_mix.*")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    docs = quality.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "m")
    return docs.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", quality.base_failed(m).alias("base_failed"), quality.kept(m).alias("kept"))


QUERIES = {"op1_langid": op1_langid, "op2_urls": op2_urls, "op3_secrets": op3_secrets, "op4_neardup": op4_neardup, "op5_topk": op5_topk, "op6_warc": op6_warc, "op7_pieces": op7_pieces, "op10_mixing": op10_mixing, "op8_sharding": op8_sharding, "op9_quality": op9_quality}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op9_sql() -> str:
    """Windows of n words are joined from leading words; a window that occurs twice marks all its words."""
    pieces, grams, marks, covers, sums, limits = [], [], [], [], [], []
    for i in range(1, 10):
        pieces.append(f"lead(w, {i}) OVER d AS w{i}")
    for n, limit in quality.NGRAM_LIMITS.items():
        grams.append("CASE WHEN w" + str(n - 1) + " IS NOT NULL THEN concat_ws(' ', w, " + ", ".join(f"w{i}" for i in range(1, n)) + f") END AS g{n}")
        marks.append(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 THEN 1 ELSE 0 END AS d{n}")
        covers.append(f"max(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}")
        sums.append(f"sum(length(w) * c{n}) AS s{n}")
        limits.append(f"coalesce(s{n}, 0) <= {limit} * coalesce(word_chars, 0)")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l0 AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM t),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l0),
q AS (SELECT doc_id, i, w, {", ".join(pieces)} FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, w, {", ".join(grams)} FROM q),
m AS (SELECT doc_id, i, w, {", ".join(marks)} FROM g),
c AS (SELECT doc_id, w, {", ".join(covers)} FROM m),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c5) AS n_repeat_words, {", ".join(sums)} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, line, unnest(range(1, count(*) + 1)) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
d AS (SELECT doc_id, count(*) AS n_lines, sum((k > 1)::int) AS n_dup_lines, sum((k > 1)::int * length(line)) AS dup_line_chars FROM l GROUP BY doc_id),
j AS (SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
 coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"s{n}" for n in quality.NGRAM_LIMITS)} FROM t LEFT JOIN s USING (doc_id) LEFT JOIN d USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND dup_line_chars <= {quality.LINE_CHAR_LIMIT} * word_chars AND n_dup_lines <= {quality.LINE_LIMIT} * n_lines AND {" AND ".join(limits)} AS kept FROM b"""


def _op2_sql() -> str:
    """Rules, then the verdicts of all that a page's links reach, by recursion over both directions of the links."""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: low(f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://([^/?#]*)', 1)")
    path = lambda x: f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    scheme = lambda x: f"regexp_extract({x}, '(?s)^(.*?)://', 1)"
    node = lambda x: f"CASE WHEN contains({x}, '://') THEN {low(scheme(x))} || '://' || {host(x)} || regexp_extract({x}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
    attribute = lambda n: rf"""trim(regexp_replace(regexp_extract(tag, '(?is)[\s"'']{n}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g'))"""
    fits = lambda h, p, rule: f"({h} = '{rule.partition('/')[0]}' OR ends_with({h}, '.{rule.partition('/')[0]}')) AND starts_with({p}, '/{rule.partition('/')[2]}')"
    longest = sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda h, p, at: "CASE " + " ".join(f"WHEN {fits(h, p, r[0])} THEN '{r[at]}'" for r in longest) + " END"
    return rf"""
WITH RECURSIVE tags AS (SELECT DISTINCT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*(?:>|\z)')) AS tag FROM pages),
t1 AS (SELECT url, {attribute("rel")} AS rel, {attribute("href")} AS href, {attribute("http-equiv")} AS equiv, {attribute("content")} AS content FROM tags WHERE ends_with(tag, '>') AND regexp_matches(lower(tag), 'canonical|refresh')),
t2 AS (SELECT url, replace(CASE WHEN list_contains(regexp_split_to_array({low("rel")}, '\s+'), 'canonical') THEN href WHEN {low("equiv")} = 'refresh' THEN trim(regexp_extract(content, '(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)) END, '&amp;', '&') AS target, {scheme("url")} AS scheme, {host("url")} AS host, {path("url")} AS path FROM t1),
t3 AS (SELECT url, CASE WHEN target = '' THEN NULL WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target WHEN starts_with(target, '/') THEN scheme || '://' || host || target
 WHEN starts_with(target, '?') THEN scheme || '://' || host || path || target WHEN regexp_matches(target, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || target END AS dest FROM t2),
edges AS (SELECT DISTINCT {node("url")} AS a, {node("dest")} AS b FROM t3),
sym AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
passed AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS verdict FROM (SELECT a, {pick(host("b"), path("b"), 1)} AS v FROM reach) GROUP BY a),
own AS (SELECT page_id, {host("url")} AS host, {path("url")} AS path, {node("url")} AS node FROM pages),
ruled AS (SELECT *, {pick("host", "path", 0)} AS rule, {pick("host", "path", 1)} AS said FROM own)
SELECT page_id, host, path, rule, coalesce(said, verdict, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by FROM ruled LEFT JOIN passed ON a = node"""


_OP4_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM t),
q AS (SELECT doc_id, n, i, w, lead(w, 1) OVER d AS b, lead(w, 2) OVER d AS c, lead(w, 3) OVER d AS e FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', w, b, c, e) AS sh FROM q WHERE i <= greatest(n - 3, 1)),
k AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM j JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE 100 * common >= 80 * (ka.size + kb.size - common)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(size, 0)::bigint AS n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(low, t.doc_id)) AS kept
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.a = t.doc_id"""

_OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i]))::bigint AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

_OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, 5 * k::int + 1, 5))::bigint) AS parts FROM f)
SELECT page_id, strlen(html)::bigint AS payload_bytes, array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v // 1024) % 32)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v // 32) % 32)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v % 32)::int + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


def _fill_sql(name: str, rows: str, parent: str, child: str, weight: str) -> str:
    """Water-filling of ``given`` among the children (capacity) of each parent, as common table expressions."""
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY weight = 0, capacity / greatest(weight, 1), {child}"
    return f"""{name}0 AS (SELECT *, ({weight})::bigint AS weight FROM ({rows})),
{name}1 AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}0),
{name}2 AS (SELECT *, capacity::hugeint * ws <= weight::hugeint * (given - spent) AND weight > 0 AS filled FROM {name}1),
{name}3 AS (SELECT *, given - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({part}), 0) AS remaining, coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER ({part}), 0) AS open FROM {name}2),
{name} AS (SELECT *, (CASE WHEN filled THEN capacity ELSE least(capacity, CASE WHEN open > 0 THEN (weight::hugeint * remaining::hugeint) // open::hugeint ELSE 0 END) END)::bigint AS budget FROM {name}3)"""


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in mixing.WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if mixing.WEIGHTS.get(level) else "1"


_OP10_SQL = rf"""
WITH d AS (SELECT doc_id, text, CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE ['web', 'books', 'code'][(regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 3) + 1] END AS domain,
 coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::bigint AS n_tokens, (2 * sum(n_tokens))::bigint AS capacity FROM d GROUP BY ALL),
{_fill_sql("a", "SELECT domain, sum(capacity) AS capacity, least((SELECT sum(n_tokens) * 50 // 100 FROM leaf), (SELECT sum(capacity) FROM leaf)) AS given FROM leaf GROUP BY domain", "", "domain", _weight_sql("domain"))},
{_fill_sql("b", "SELECT leaf.domain, lang, sum(leaf.capacity) AS capacity, any_value(a.budget) AS given FROM leaf JOIN a USING (domain) GROUP BY leaf.domain, lang", "domain", "lang", _weight_sql("lang"))},
{_fill_sql("c", "SELECT leaf.domain, leaf.lang, source, n_tokens, leaf.capacity, b.budget AS given FROM leaf JOIN b ON b.domain = leaf.domain AND b.lang = leaf.lang", "domain, lang", "source", "1")},
e AS (SELECT d.*, CASE WHEN c.n_tokens > 0 THEN budget // c.n_tokens ELSE 0 END AS passes, budget - CASE WHEN c.n_tokens > 0 THEN budget // c.n_tokens ELSE 0 END * c.n_tokens AS rest FROM d JOIN c ON d.domain = c.domain AND d.lang = c.lang AND d.source = c.source),
f AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('19|' || passes || '|' || coalesce(doc_id::varchar, 'null ' || md5(coalesce(text, '')))), n_tokens, md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
g AS (SELECT *, rest > 0 AND before < rest AS reached, least(n_tokens, rest - before) AS taken FROM f)
SELECT doc_id, domain, lang, source, n_tokens, (passes + (reached AND taken = n_tokens)::int)::bigint AS copies, CASE WHEN reached AND taken < n_tokens THEN taken ELSE 0 END::bigint AS prefix_tokens FROM g"""

ORACLES = {"op2_urls": _op2_sql(), "op4_neardup": _OP4_SQL, "op5_topk": _OP5_SQL, "op6_warc": _OP6_SQL, "op9_quality": _op9_sql(), "op10_mixing": _OP10_SQL}
