"""Listing table jobs (feeds, look-ups, upsert) and duplicate handling on the Parquet tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket.catalog import sql as S
from docmarket.catalog.text import sql_clip, sql_strip_html, sql_token_set
from docmarket.functions import text as T
from docmarket.operators import dedupe as D
from docmarket.operators.ranking import top_per_group
from docmarket.registry import query
from docmarket.sources import feeds, listings as L
from docmarket.sources.tables import table

# --- feeds ---------------------------------------------------------------------

# Three landed feeds of different shape: pages, documents, conversation turns.
PAGE_FEED = feeds.Feed(("page_id",), url=("url",), title=("headline",), description=("html",), category="site", remote=("title", "location"))
DOC_FEED = feeds.Feed(("doc_id",), company=("owner.name",), location=("lang",), description=("text",), tags=("topics",), posted=("created",),
                      remote=("flag:away",), extras=("n_chars",))
TURN_FEED = feeds.Feed(("missing", "turn_key"), title=("missing",), description=("text",), remote=("never",), default_location="Unknown", default_url="https://example.com")

UNIFY_SQL = f"""
WITH pages_f AS (
  SELECT 'pages' AS source, CAST(page_id AS VARCHAR) AS external_id, 'Unknown Role' AS title, 'Unknown Company' AS company, 'Remote' AS location,
         url, {sql_strip_html('html')} AS body, split_part(url, '/', 3) AS tags, '' AS posted, true AS remote, '' AS extra FROM pages),
docs_f AS (
  SELECT 'docs', CAST(doc_id AS VARCHAR), 'Unknown Role', source, lang, '', {sql_strip_html('text')}, source || '|' || lang,
         CASE WHEN doc_id % 2 = 0 THEN '2024-02-03 04:05:06' ELSE '1970-01-02 00:00:00' END, doc_id % 3 = 0, CAST(n_chars AS VARCHAR) FROM documents),
turns_f AS (
  SELECT 'turns', conv_id || '-' || turn, 'Unknown Role', 'Unknown Company', 'Unknown', 'https://example.com', {sql_strip_html('text')}, 'listing', '', false, ''
  FROM conversations),
u AS (SELECT * FROM pages_f UNION ALL SELECT * FROM docs_f UNION ALL SELECT * FROM turns_f)
SELECT source, external_id, title, company, location, remote, url, body AS description, tags, posted, extra FROM u
"""


@query("A1_unify_listings", UNIFY_SQL)
def a1(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html", F.split_part("url", F.lit("/"), F.lit(3)).alias("site"))
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", "lang", "n_chars", F.struct(F.col("source").alias("name")).alias("owner"), F.array("source", "lang").alias("topics"),
        (F.col("doc_id") % 3 == 0).alias("away"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("2024-02-03T04:05:06Z")).otherwise(F.lit("86400")).alias("created"),
    )
    turns = table(spark, sf, "conversations").select("text", F.concat_ws("-", "conv_id", "turn").alias("turn_key"))
    out = feeds.unify_listings({"pages": pages, "docs": docs, "turns": turns}, {"pages": PAGE_FEED, "docs": DOC_FEED, "turns": TURN_FEED})
    return out.select(
        "source", "external_id", "title", "company", "location", "remote", "url", "description", F.array_join("tags", "|").alias("tags"),
        F.coalesce(F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("posted"),
        F.coalesce(F.try_element_at("extras", F.lit("n_chars")), F.lit("")).alias("extra"),
    )


@query(
    "A2_parse_timestamp_any",
    "WITH t AS (SELECT event_id, epoch(date_trunc('second', ts)) AS e FROM events) SELECT event_id, CASE event_id % 4 WHEN 3 THEN -1 ELSE CAST(e AS BIGINT) END AS seconds FROM t",
)
def a2(spark, sf):
    key, sec = F.col("event_id"), F.date_trunc("second", F.col("ts"))
    epoch = F.unix_timestamp(sec.cast("timestamp"))
    text = (
        F.when(key % 4 == 0, F.concat(F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(key % 4 == 1, epoch.cast("string"))
        .when(key % 4 == 2, (epoch * 1000).cast("string"))
        .otherwise(F.lit("soon"))
    )
    parsed = feeds.parse_timestamp_any(text)
    return table(spark, sf, "events").select("event_id", F.coalesce(F.unix_timestamp(parsed), F.lit(-1)).alias("seconds"))


@query(
    "A3_split_category_tags",
    "WITH t AS (SELECT page_id, list_filter(list_transform(string_split_regex(url, '[/>]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages) "
    "SELECT page_id, unnest(CASE WHEN len(parts) > 0 THEN parts ELSE ['none'] END) AS tag FROM t "
    "UNION ALL SELECT -1 - p_partkey, unnest([p_type, p_brand]) FROM part",
)
def a3(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("label"))
    parts = table(spark, sf, "part").select((-1 - F.col("p_partkey")).alias("page_id"), F.concat_ws(" > ", "p_type", "p_brand").alias("label"))
    return pages.unionAll(parts).select("page_id", F.explode(feeds.split_category_tags(F.col("label"), F.lit("none"))).alias("tag"))


@query(
    "A4_prepare_listing_text",
    f"WITH t AS (SELECT page_id, {sql_strip_html('html')} AS x FROM pages) SELECT page_id, {sql_clip('x', 4000)} AS description, {sql_clip('x', 260)} AS preview FROM t",
)
def a4(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.col("html").alias("description"))
    return feeds.prepare_listing_text(rows, limit=4000).select("page_id", "description", "preview")


# --- listing table: events are sightings of listings ----------------------------

NOW = "2024-01-15 12:00:00"
SIGHT_SQL = """sightings AS (
  SELECT event_id, event_type AS source, regexp_extract(props, '([0-9]+)', 1) AS external_id, ts AS last_seen_at,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + to_hours(CAST(event_id % 300 AS INTEGER)) END AS cached_until,
         'role' || (user_id % 10) AS normalized_role, 'loc' || (event_id % 3) AS location_query FROM events),
queries AS (SELECT DISTINCT user_id AS query_id, 'role' || (user_id % 10) AS normalized_role, 'loc' || (user_id % 3) AS location_query, 3 + user_id % 5 AS lim FROM events)
"""


def sightings(spark, sf):
    key = F.col("event_id")
    until = F.when(key % 7 != 0, F.col("ts") + F.make_dt_interval(hours=(key % 300).cast("int")))
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("source"), F.get_json_object("props", "$.k").alias("external_id"), F.col("ts").alias("last_seen_at"),
        until.alias("cached_until"), F.concat(F.lit("role"), F.col("user_id") % 10).alias("normalized_role"),
        F.concat(F.lit("loc"), key % 3).alias("location_query"),
    )


def sighting_queries(spark, sf):
    user = F.col("user_id")
    return table(spark, sf, "events").select(user.alias("query_id")).distinct().select(
        "query_id", F.concat(F.lit("role"), F.col("query_id") % 10).alias("normalized_role"),
        F.concat(F.lit("loc"), F.col("query_id") % 3).alias("location_query"), (F.col("query_id") % 5 + 3).cast("int").alias("limit"),
    )


def now_col():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "A5_lookup_live",
    f"WITH {SIGHT_SQL} SELECT query_id, event_id, rank FROM (SELECT query_id, event_id, lim, row_number() OVER (PARTITION BY query_id ORDER BY last_seen_at DESC, event_id) AS rank "
    f"FROM sightings JOIN queries USING (normalized_role, location_query) WHERE cached_until IS NULL OR cached_until > TIMESTAMP '{NOW}') WHERE rank <= lim",
)
def a5(spark, sf):
    return L.lookup_live(sightings(spark, sf), sighting_queries(spark, sf), now_col(), tie="event_id").select("query_id", "event_id", "rank")


@query(
    "A6_lookup_live_any_location",
    f"WITH {SIGHT_SQL} SELECT query_id, event_id, rank FROM (SELECT query_id, event_id, lim, row_number() OVER (PARTITION BY query_id ORDER BY last_seen_at DESC, event_id) AS rank "
    f"FROM sightings s JOIN queries q USING (normalized_role) WHERE cached_until IS NULL OR cached_until > TIMESTAMP '{NOW}') WHERE rank <= greatest(6 * lim, 140)",
)
def a6(spark, sf):
    hits = L.lookup_live_any_location(sightings(spark, sf), sighting_queries(spark, sf), now_col(), tie="event_id")
    return hits.select("query_id", "event_id", "rank")


@query(
    "A7_upsert_listings",
    f"""WITH {SIGHT_SQL},
    batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY event_id) AS rn FROM sightings WHERE event_id % 10 = 3) WHERE rn = 1),
    target AS (SELECT * FROM sightings WHERE event_id % 10 <> 3),
    keys AS (SELECT source, external_id FROM target UNION SELECT source, external_id FROM batch),
    old AS (SELECT source, external_id, arg_max(normalized_role, last_seen_at) AS role, max(last_seen_at) AS seen, arg_max(coalesce(cached_until, TIMESTAMP '1900-01-01'), last_seen_at) AS until,
            min(last_seen_at) AS created FROM target GROUP BY ALL)
    SELECT k.source, k.external_id, CASE WHEN b.source IS NOT NULL THEN b.normalized_role ELSE o.role END AS role,
      strftime(CASE WHEN b.source IS NOT NULL THEN TIMESTAMP '2024-02-10 00:00:00' ELSE o.seen END, '%Y-%m-%d %H:%M:%S') AS seen,
      strftime(CASE WHEN b.source IS NOT NULL THEN TIMESTAMP '2024-02-10 06:00:00' ELSE o.until END, '%Y-%m-%d %H:%M:%S') AS until,
      strftime(coalesce(o.created, TIMESTAMP '2024-02-10 00:00:00'), '%Y-%m-%d %H:%M:%S') AS created
    FROM keys k LEFT JOIN batch b USING (source, external_id) LEFT JOIN old o USING (source, external_id)""",
)
def a7(spark, sf):
    rows = sightings(spark, sf)
    target = rows.filter(F.col("event_id") % 10 != 3).drop("event_id").withColumn("created_at", F.col("last_seen_at"))
    batch = rows.filter(F.col("event_id") % 10 == 3).withColumnRenamed("event_id", "arrival")
    out = L.upsert_listings(target, batch, F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"), ["source", "external_id"])
    stamp = lambda c, d="1900-01-01 00:00:00": F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(d))
    return out.select(
        "source", "external_id", F.col("normalized_role").alias("role"), stamp("last_seen_at").alias("seen"), stamp("cached_until").alias("until"), stamp("created_at").alias("created")
    )


@query(
    "A8_expire_and_cap",
    "SELECT event_id FROM events WHERE TIMESTAMP '2024-01-20 00:00:00' - ts < INTERVAL 7200 MINUTE ORDER BY ts DESC, event_id LIMIT 500",
)
def a8(spark, sf):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return L.expire_and_cap(table(spark, sf, "events"), now, "ts", 7200, 500, "event_id").select("event_id")


@query(
    "A9_needs_profile_refresh",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R' AND "
    "(l_linenumber < 6 OR l_quantity < 10 OR l_tax = 0 OR l_linestatus = 'F')",
)
def a9(spark, sf):
    some = F.array(F.lit("x"))
    none = F.slice(some, 1, 0)
    pick = lambda bad: F.when(bad, none).otherwise(some)
    stale = L.needs_profile_refresh(
        F.col("l_linenumber"), pick(F.col("l_quantity") < 10), pick(F.col("l_tax") == 0), some,
        F.when(F.col("l_linestatus") == "F", F.lit("pattern")).otherwise(F.lit("hybrid")),
        F.when(F.col("l_returnflag") == "R", F.lit("role-baseline")).otherwise(F.lit("feed")),
    )
    return table(spark, sf, "lineitem").filter(stale).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "A10_delete_cascade",
    """WITH runs AS (SELECT o_orderkey AS run_id, o_custkey AS user_id, o_orderkey AS doc_id, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS gone FROM orders),
    leavers AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0),
    kept AS (SELECT * FROM runs WHERE NOT gone AND user_id NOT IN (SELECT user_id FROM leavers))
    SELECT 'run' AS kind, run_id AS id FROM kept
    UNION ALL SELECT 'doc', doc_id FROM runs WHERE run_id IN (SELECT run_id FROM kept)
    UNION ALL SELECT 'user', c_custkey FROM customer WHERE c_acctbal >= 0""",
)
def a10(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("doc_id"))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"))
    drop_runs = orders.filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"))
    leavers = customers.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    kept, docs, users = L.delete_cascade(runs, docs, customers.select(F.col("c_custkey").alias("user_id")), drop_runs, leavers)
    tag = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("id"))
    return tag(kept, "run", "run_id").unionAll(tag(docs, "doc", "doc_id")).unionAll(tag(users, "user", "user_id"))


@query(
    "A11_nest_report",
    """WITH d AS (SELECT l_orderkey AS run_id, l_returnflag AS kind, p_name AS term, max(l_extendedprice) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY share DESC, term) AS pos FROM d)
    SELECT o_orderkey AS run_id, coalesce(string_agg(term, '|' ORDER BY pos) FILTER (kind = 'R' AND pos <= 3), '') AS r_terms,
      coalesce(string_agg(term, '|' ORDER BY pos) FILTER (kind = 'A' AND pos <= 3), '') AS a_terms FROM orders LEFT JOIN r ON run_id = o_orderkey GROUP BY 1""",
)
def a11(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    details = lines.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("kind"), F.col("p_name").alias("term")).agg(F.max("l_extendedprice").alias("share"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    out = L.nest_report(runs, details, ["R", "A"], 3)
    flat = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["term"]), "|"), F.lit(""))
    return out.select("run_id", flat("R_terms").alias("r_terms"), flat("A_terms").alias("a_terms"))


# --- duplicates -----------------------------------------------------------------


@query(
    "I1_dedupe_listings",
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '::' || regexp_extract(props, '([0-9]+)', 1) "
    "WHEN event_id % 3 = 1 THEN event_type || '::http://u/' || user_id ELSE event_type || '::role ' || (user_id % 9) || '::co ' || (user_id % 4) END AS k FROM events) "
    "SELECT k AS dedupe_key, min(event_id) AS event_id FROM t GROUP BY k",
)
def i1(spark, sf):
    key, user = F.col("event_id"), F.col("user_id")
    k = D.dedupe_key(
        F.upper("event_type"), F.when(key % 3 == 0, F.get_json_object("props", "$.k")), F.when(key % 3 == 1, F.concat(F.lit(" HTTP://u/"), user)),
        F.concat(F.lit("role "), user % 9), F.concat(F.lit("Co   "), user % 4),
    )
    return D.dedupe_listings(table(spark, sf, "events").select("event_id", k.alias("dedupe_key")), "dedupe_key", "event_id")


NEAR_SQL = (
    f"{S.clean_label('source')} || '::' || {S.clean_label('lang')} || '::' || array_to_string(list_filter(string_split({S.clean_words('text')}, ' '), "
    f"lambda t: length(t) > 3 AND t NOT IN {S.in_list(T.ROLE_STOPWORDS + T.ROLE_GENERIC_TOKENS)})[1:10], ' ')"
)


@query(
    "I2_near_duplicates",
    f"WITH t AS (SELECT doc_id, {NEAR_SQL} AS sig, doc_id % 11 = 0 AS exempt FROM documents) "
    "SELECT doc_id, sig AS signature FROM t WHERE exempt OR doc_id IN (SELECT min(doc_id) FROM t WHERE NOT exempt GROUP BY sig)",
)
def i2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", D.near_signature(F.col("source"), F.col("lang"), F.col("text")).alias("signature"))
    return D.near_duplicates(docs, "signature", "doc_id", F.col("doc_id") % 11 == 0)


SIGNATURE_SQL = (
    f"concat_ws('|', 'feed', lower(lang), lower(lang), array_to_string({S.words(S.ws(chr(10).join(['regexp_replace(regexp_replace(lower(' + S.ws('text') + '), ' + S.q(T.URL) + ', ' + S.q('') + ', ' + S.q('g') + '), ' + S.q('[^a-z0-9\\s]') + ', ' + S.q(' ') + ', ' + S.q('g') + ')'])))}[1:36], ' '))"
)


@query(
    "I3_dup_divisor",
    f"WITH t AS (SELECT doc_id, {SIGNATURE_SQL} AS sig FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY sig) AS dup_divisor FROM t",
)
def i3(spark, sf):
    sig = D.listing_signature(F.lit("feed"), F.col("lang"), F.col("lang"), F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", sig.alias("signature"))
    return D.with_dup_divisor(docs, "signature").select("doc_id", "dup_divisor")


PICKS_SQL = """picks AS (SELECT * FROM (SELECT l_suppkey AS query_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS origin, 'k' || (l_partkey % 13) AS key, 's' || (l_orderkey % 11) AS signature,
   row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 15)"""


@query(
    "I4_merge_ranked",
    f"""WITH RECURSIVE {PICKS_SQL}, items AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank) AS n FROM picks),
    scan AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ks, CAST([] AS VARCHAR[]) AS ss, false AS taken FROM items
      UNION ALL
      SELECT s.query_id, i.n, CASE WHEN ok THEN list_append(ks, i.key) ELSE ks END, CASE WHEN ok THEN list_append(ss, i.signature) ELSE ss END, ok
      FROM (SELECT scan.*, i.key, i.signature, i.n AS nn, NOT list_contains(ks, i.key) AND NOT list_contains(ss, i.signature) AND len(ks) < 10 AS ok
            FROM scan JOIN items i ON i.query_id = scan.query_id AND i.n = scan.n + 1) s JOIN items i ON i.query_id = s.query_id AND i.n = s.nn)
    SELECT i.query_id, i.origin, i.rank, i.key, i.signature, row_number() OVER (PARTITION BY i.query_id ORDER BY i.n) AS position FROM scan JOIN items i USING (query_id, n) WHERE taken""",
)
def i4(spark, sf):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_linenumber")]
    picks = top_per_group(table(spark, sf, "lineitem"), ["l_suppkey", "l_linestatus"], order, 15, "rank")
    cols = [F.col("l_suppkey").alias("query_id"), "rank", F.concat(F.lit("k"), F.col("l_partkey") % 13).alias("key"), F.concat(F.lit("s"), F.col("l_orderkey") % 11).alias("signature")]
    return D.merge_ranked(picks.filter("l_linestatus = 'O'").select(cols), picks.filter("l_linestatus = 'F'").select(cols), 10)


@query(
    "I5_blend_with_cache",
    """WITH rows AS (SELECT l_orderkey AS query_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS origin, l_partkey AS key, min(l_linenumber * 1000000 + l_partkey) AS rank FROM lineitem GROUP BY ALL),
    live AS (SELECT query_id, count(*) AS n FROM rows WHERE origin = 0 GROUP BY 1),
    thin AS (SELECT o_orderkey AS query_id, coalesce(n, 0) AS n_live FROM orders LEFT JOIN live ON query_id = o_orderkey WHERE coalesce(n, 0) < 3),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY origin, rank) AS rn FROM rows WHERE query_id IN (SELECT query_id FROM thin)) WHERE rn = 1),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank) AS pos FROM pool) WHERE pos <= 5),
    grown AS (SELECT query_id FROM chosen JOIN thin USING (query_id) GROUP BY query_id HAVING count(*) > max(n_live))
    SELECT query_id, key, rank, origin FROM rows WHERE origin = 0 AND query_id NOT IN (SELECT query_id FROM grown)
    UNION ALL SELECT query_id, key, rank, origin FROM chosen WHERE query_id IN (SELECT query_id FROM grown)""",
)
def i5(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), "l_linestatus", F.col("l_partkey").alias("key")).agg(
        F.min(F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rank")
    )
    side = lambda s: rows.filter(F.col("l_linestatus") == s).select("query_id", "key", "rank")
    floors = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(3).alias("floor"))
    choose = lambda pool: top_per_group(pool, ["query_id"], [F.asc("origin"), F.asc("rank")], 5)
    return D.blend_with_cache(side("O"), side("F"), floors, choose)


@query(
    "I6_cache_fallback",
    """WITH t AS (SELECT l_orderkey AS query_id, l_partkey AS listing_id, 1 + l_linenumber % 4 AS b, l_quantity > 25 AS safe FROM lineitem),
    u AS (SELECT * FROM t WHERE b <= 3 AND (b < 3 OR safe)) SELECT query_id, listing_id, b AS bucket_rank FROM u WHERE b = (SELECT min(b) FROM u v WHERE v.query_id = u.query_id)""",
)
def i6(spark, sf):
    bucket = F.element_at(T.lit_array([*D.CACHE_BUCKETS, "none"]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("listing_id"), bucket.alias("cache_bucket"), (F.col("l_quantity") > 25).alias("safe"))
    return D.cache_fallback(rows, F.col("safe")).select("query_id", "listing_id", "bucket_rank")


@query(
    "I7_overlap_join",
    f"""WITH l AS (SELECT doc_id, unnest({sql_token_set('text')}) AS token FROM documents), r AS (SELECT item_id, unnest({sql_token_set('text')}) AS token FROM benchmark),
    n AS (SELECT item_id, count(*) AS n_right FROM r GROUP BY 1),
    p AS (SELECT doc_id, item_id, count(*) AS shared FROM l JOIN r USING (token) GROUP BY ALL),
    s AS (SELECT doc_id, item_id, shared, n_right, shared / n_right AS share FROM p JOIN n USING (item_id) WHERE shared >= 0.5 * n_right)
    SELECT doc_id, item_id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, item_id) AS rank FROM s) WHERE rank <= 3""",
)
def i7(spark, sf):
    out = D.overlap_join(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id", "text", 0.5, 3)
    return out.select("doc_id", "item_id", "shared", "rank")


# --- runs: orders are saved analysis runs ----------------------------------------

RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS user_id, lower(o_orderpriority) AS role, o_orderdate AS created_at, CAST(o_orderkey * 7919 % 10000 AS DOUBLE) / 100 AS overall_score,
  CAST(o_orderkey * 31 % 1000 AS DOUBLE) / 10 AS skill_match, CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 10 AS semantic_match, CAST(o_orderkey * 41 % 1000 AS DOUBLE) / 10 AS experience_match,
  CAST(o_orderkey * 43 % 1000 AS DOUBLE) / 10 AS market_demand, CAST(o_orderkey * 47 % 1000 AS DOUBLE) / 10 AS resume_quality, CAST(o_orderkey * 53 % 1000 AS DOUBLE) / 10 AS ats_compliance FROM orders)"""


def runs_frame(spark, sf):
    key = F.col("o_orderkey")
    scores = {"skill_match": 31, "semantic_match": 37, "experience_match": 41, "market_demand": 43, "resume_quality": 47, "ats_compliance": 53}
    return table(spark, sf, "orders").select(
        key.alias("run_id"), F.col("o_custkey").alias("user_id"),
        F.when(key % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("role_query"),
        F.col("o_orderdate").alias("created_at"), ((key * 7919 % 10000).cast("double") / 100).alias("overall_score"),
        *[((key * m % 1000).cast("double") / 10).alias(n) for n, m in scores.items()],
    )


@query(
    "I8_compare_runs",
    f"""WITH {RUNS_SQL},
    pairs AS (SELECT c.run_id, p AS prev, p.created_at <= c.created_at AS older FROM runs c JOIN runs p ON p.user_id = c.user_id AND p.role = c.role AND p.run_id <> c.run_id),
    base AS (SELECT run_id, coalesce(max(struct_pack(t := prev.created_at, id := prev.run_id)) FILTER (older), max(struct_pack(t := prev.created_at, id := prev.run_id))) AS b FROM pairs GROUP BY run_id),
    j AS (SELECT c.*, p.run_id AS prev_id, p.overall_score AS po, {", ".join(f"coalesce(p.{c}, 0) AS p_{c}" for c in D.COMPONENTS)} FROM runs c LEFT JOIN base USING (run_id) LEFT JOIN runs p ON p.run_id = b.id)
    SELECT run_id, user_id, coalesce(prev_id, -1) AS previous_run_id, {S.rnd('overall_score - coalesce(po, 0)')} AS score_delta,
      {", ".join(f"{S.rnd(f'{c} - p_{c}')} AS {c}_delta" for c in D.COMPONENTS)},
      CASE WHEN prev_id IS NULL THEN 'baseline' WHEN overall_score > po THEN 'increased' WHEN overall_score < po THEN 'decreased' ELSE 'stayed the same' END AS direction FROM j""",
)
def i8(spark, sf):
    return D.compare_runs(runs_frame(spark, sf)).withColumn("previous_run_id", F.coalesce("previous_run_id", F.lit(-1)))


@query(
    "I9_run_history",
    f"WITH {RUNS_SQL} SELECT * FROM (SELECT user_id, run_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id) AS position FROM runs) WHERE position <= 10",
)
def i9(spark, sf):
    return D.run_history(runs_frame(spark, sf), 10).select("user_id", "run_id", "position")
