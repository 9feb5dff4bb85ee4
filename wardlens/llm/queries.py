"""Registered queries of the ``llm`` operators over the given tables, and the SQL that states the same results."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import chat, decontam, html_text, licenses, line_dedup, minhash, negatives, packing, runs, token_counts, topk, toxicity, url_lists
from wardlens.llm.common import read

OP5_WORDS, OP5_PERCENT = 3, 85


@functools.cache
def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), least_words=line_dedup.EVERY_LINE)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_clauses")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(read(spark, sf_dir, "documents"), OP5_WORDS, OP5_PERCENT)
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("detections")


def _hash(column, first: int) -> F.Column:
    """A number from 0 to 255 from two hex digits of an md5."""
    return F.conv(F.substring(F.md5(column), first, 2), 16, 10).cast("int")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures; the tables have no fetch date, so one is derived from the page id."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries for the hosts, parent domains and paths of the pages: listed, removed and listed again by a rule on their hash."""
    pages = read(spark, sf_dir, "pages").select(url_lists.url_host(F.col("url")).alias("host"), url_lists.url_path(F.col("url")).alias("path")).where("host <> ''")
    hosts = pages.select("host").distinct()
    parent = F.array_join(F.slice(F.split("host", r"\."), 2, 100), ".")
    named = hosts.where(_hash("host", 1) < 96).select(F.concat(F.lit("host:"), "host").alias("pattern"), F.lit("spam").alias("category"))
    named = named.union(hosts.where((_hash("host", 3) < 40) & (parent != "")).select(F.concat(F.lit("host:"), parent), F.lit("adult")).distinct())
    paths = pages.select(F.concat("host", F.lit("/"), F.split("path", "/")[1]).alias("p")).distinct().where(_hash("p", 5) < 64)
    named = named.union(paths.select(F.concat(F.lit("path:"), "p"), F.lit("phishing")))
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(a).alias("a")) for d, a in ((0, True), (45, False), (110, True), (115, True), (230, False))])
    dated = named.select("pattern", "category", _hash("pattern", 7).alias("day"), F.explode(steps).alias("s"))
    return dated.select("pattern", "category", F.date_add(F.lit("2023-12-01").cast("date"), F.col("day") + F.col("s.d")).alias("listed_on"), F.col("s.a").alias("active"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.filter_urls(captures(spark, sf_dir), list_entries(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return runs.run_digest(runs.periodic_runs(docs.select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"), html_text.fit(spark))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_decontaminate, op3_line_dedup, op4_toxicity, op5_near_duplicates, op6_token_counts, op7_top_k, op8_license_scan, op9_url_filter, op10_packing, op11_periodic_runs, op12_hard_negatives, op13_html_text)}

# Lower-cases A-Z only, and takes the words.
_W = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_T = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op1_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, CAST(floor(turn / 1024) AS BIGINT) AS segment, turn, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS k, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ) OVER w AS said
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
c AS (SELECT conv_id, max(k) AS n_turns, arg_max(said, k) AS said FROM p GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, count(*) AS n_equal, n_turns, said FROM c GROUP BY n_turns, said),
longer AS (SELECT DISTINCT k, p.said FROM p JOIN c USING (conv_id) WHERE k < n_turns),
kept AS (SELECT conv_id, n_turns, n_equal FROM one WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.k = one.n_turns AND longer.said = one.said))
SELECT conv_id, segment, n_turns, n_equal, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, segment, n_turns, n_equal""",
    "op2_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W.format('text')} AS w FROM benchmark),
cuts AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n FROM cuts),
docs AS (SELECT doc_id, {_W.format('text')} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs),
hits AS (SELECT doc_id, i, pos_n.n, item FROM (SELECT doc_id, i, lens.n, array_to_string(w[i:i + lens.n - 1], ' ') AS s FROM pos, lens WHERE i + lens.n - 1 <= len(w)) pos_n JOIN wins USING (s, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op5_near_duplicates": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_T.format('text')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END AS l FROM docs WHERE len(w) > 0), unnest(l) AS u(s)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a AS d, b AS r FROM links UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(r, doc_id)) AS kept
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = doc_id""",
    "op7_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, v.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.x, v.x, true), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.r <> v.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s QUALIFY "rank" <= 10""",
    "op9_url_filter": r"""
WITH pg AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched_on,
  regexp_replace(regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '') AS host,
  coalesce(nullif(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM pg WHERE host <> ''),
named AS (SELECT 'host:' || host AS pattern, 'spam' AS category FROM hosts WHERE CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) < 96
  UNION ALL SELECT DISTINCT 'host:' || array_to_string(string_split(host, '.')[2:], '.'), 'adult' FROM hosts WHERE CAST('0x' || substr(md5(host), 3, 2) AS INTEGER) < 40 AND contains(host, '.')
  UNION ALL SELECT 'path:' || p, 'phishing' FROM (SELECT DISTINCT host || '/' || string_split(path, '/')[2] AS p FROM pg WHERE host <> '') WHERE CAST('0x' || substr(md5(p), 5, 2) AS INTEGER) < 64),
ent AS (SELECT pattern, category, DATE '2023-12-01' + CAST('0x' || substr(md5(pattern), 7, 2) AS INTEGER) + d AS listed_on, a AS active FROM named, (VALUES (0, true), (45, false), (110, true), (115, true), (230, false)) s(d, a)),
keys AS (SELECT page_id, fetched_on, 'host:' || array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM pg, unnest(generate_series(1, len(string_split(host, '.')))) u(i) WHERE host <> ''
  UNION ALL SELECT page_id, fetched_on, 'path:' || host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM pg) , unnest(generate_series(1, len(parts))) u(i) WHERE host <> ''),
asof_ AS (SELECT page_id, pattern, category, bool_or(active) AS active FROM (SELECT k.page_id, k.pattern, e.category, e.active, rank() OVER (PARTITION BY k.page_id, k.pattern, e.category ORDER BY e.listed_on DESC) AS r
  FROM keys k JOIN ent e ON e.pattern = k.pattern AND e.listed_on <= k.fetched_on) WHERE r = 1 GROUP BY ALL),
m AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c FROM asof_ WHERE active GROUP BY page_id)
SELECT page_id, url, fetched_on, host, coalesce(n, 0) AS n_entries, coalesce(c, '') AS categories, n IS NOT NULL AS blocked FROM pg LEFT JOIN m USING (page_id)""",
    "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, coalesce(CAST(list_sum(list_transform(list_zip(a.x, b.x, true), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS "rank", n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY "rank" <= 3""",
}
