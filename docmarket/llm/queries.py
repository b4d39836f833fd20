"""One query for each operator over the given tables, and the SQL that must agree where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from docmarket.llm import decontamination, fim, importance, inner_product, jaccard_join, mixing, pii, quality_rules, secret_scan, sharding, token_counts, token_files, vector_codes
from docmarket.session import new_folder

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, folder))


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")
    out = decontamination.find_leaks(docs, items)
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", decontamination.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules.apply_rules(documents(spark, folder).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, folder)).drop("copies")


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    out = importance.classify(docs, importance.train_classifier(docs, labels))
    return out.select("doc_id", F.col("__low").alias("low_weight"), F.col("__toxic").alias("toxic_weight"), F.col("__kept").alias("kept"))


@query
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, folder), out, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_report(spark, out)


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, folder).select("doc_id", "text"))
    spans, base = F.col("secrets"), F.filter("secrets", lambda s: s["kind"] != "entropy")
    counts = [secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits in every document, at a quarter, half and three quarters of its length: 5, 10 and 15 characters give way to a mark with its id."""
    docs, size = documents(spark, folder), F.coalesce(F.length("text"), F.lit(0))
    at = lambda k: F.floor(size * k / 4).cast("long")
    edits = F.array(*[F.struct(at(k).alias("start"), (at(k) + 5 * k).alias("end"), F.concat(F.lit(" [edit "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f".{k}] ")).alias("text")) for k in (3, 2, 1)])
    return token_counts.count_edited(docs.select("doc_id", "text", edits.alias("edits")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, folder).select("doc_id", "text"))
    base, spans = F.col("base"), F.concat("base", "added")
    counts = [secret_scan.count_of(base, k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


@query
def op10_shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder))


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fim.fill_in_middle(documents(spark, folder))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


@query
def op12_inner_product_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = embeddings(spark, folder)
    return inner_product.top_inner_products(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(embeddings(spark, folder))
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = vector_codes.label_errors(coded.withColumn("code", digits))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

SQL["op3_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
windows AS (SELECT rid, i, w[i : i + 4] AS win FROM places JOIN d USING (rid)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, w, l, array_to_string(w, '') AS joined, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN covered c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * len(l) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR length(regexp_replace(joined, '[^A-Z]', '', 'g')) > length(regexp_replace(joined, '[^a-z]', '', 'g')) OR 100 * length(regexp_replace(joined, '[^!]', '', 'g')) > 50 * n_words
    OR (n_words >= 50 AND 10 * len(list_distinct(w)) < n_words)
    OR 100 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 30 * n_words) AS kept
FROM b"""

SQL["op4_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
k AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 9))::BIGINT AS key FROM d),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM t),
l AS (SELECT *, (sum(source_size) OVER ()::BIGINT * 3 / 2 - coalesce(sum(cap) OVER o, 0)::BIGINT) / (sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT) AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS base FROM aims),
u AS (SELECT source, key, sum(size) AS unit FROM k GROUP BY source, key),
c AS (SELECT u.source, key, 2 * sum(unit) OVER (PARTITION BY u.source ORDER BY key) - unit <= 2 * (target - base * source_size) AS more
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT k.doc_id, k.size, b.source_size, b.target, k.size * least(b.base + c.more::INT, 2) AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key"""


SQL["op2_decontaminate"] = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, w[k : k + 9] AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT rid, k, p.n, item FROM places p JOIN d USING (rid) JOIN windows x ON x.n = p.n AND x.win = d.w[k : k + p.n - 1]),
words AS (SELECT rid, count(DISTINCT k + o) AS n_hit FROM (SELECT DISTINCT rid, k, n FROM hits), range(10) AS r(o) WHERE o < n GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


SQL["op1_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i : i + 2] AS t FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, c.r FROM c JOIN e ON e.x = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM c WHERE c.doc_id = d.doc_id) AS component_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)"""


SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS hs FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, hs[1] % (len(units) + 1) AS x, hs[2] % (len(units) + 1) AS y FROM u),
p AS (SELECT *, array_to_string(units[1 : least(x, y)], '') AS prefix, array_to_string(units[least(x, y) + 1 : greatest(x, y)], '') AS middle, array_to_string(units[greatest(x, y) + 1 : n], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""

_VECTORS = """SELECT *, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

SQL["op12_inner_product_search"] = f"""
WITH v AS ({_VECTORS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

_NEAREST = "SELECT rid, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT t.rid, t.p, b.e, list_dot_product(t.x, t.x) - 2 * list_dot_product(t.x, b.x) + list_dot_product(b.x, b.x) AS d FROM parts t JOIN b{i} b ON t.p = b.p) GROUP BY rid, p"
_ROUND = """
a{i} AS MATERIALIZED ({nearest}),
m{i} AS (SELECT p, e, k, floor(sum(x[k]) / count(*)) AS y FROM a{i} JOIN parts USING (rid, p), range(1, 17) AS r(k) GROUP BY p, e, k),
b{j} AS MATERIALIZED (SELECT p, e, coalesce(n.x, o.x) AS x FROM b{i} o LEFT JOIN (SELECT p, e, list(y ORDER BY k) AS x FROM m{i} GROUP BY p, e) n USING (p, e)),"""

SQL["op13_vector_codes"] = f"""
WITH v AS ({_VECTORS}),
w AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id) AS rid FROM v),
parts AS MATERIALIZED (SELECT rid, p, v[16 * p + 1 : 16 * p + 16] AS x FROM w, range(4) AS r(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= 256),
{"".join(_ROUND.format(i=i, j=i + 1, nearest=_NEAREST.format(i=i)) for i in range(4))}
last AS MATERIALIZED ({_NEAREST.format(i=4)}),
rows AS (SELECT rid, string_agg(lower(printf('%02x', e::BIGINT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS s FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM w JOIN rows USING (rid), books"""
