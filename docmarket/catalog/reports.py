"""Report tables on the stand-in signals, and the batch twins and runs of the stream jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket import lexicons as X
from docmarket.catalog import sql as S
from docmarket.catalog.market import ATTEMPTS_SQL, attempts_frame, attempts_of
from docmarket.catalog.quality import SIGNALS_SQL, signals
from docmarket.operators import report as N
from docmarket.registry import query
from docmarket.session import new_folder
from docmarket.sources.tables import table
from docmarket.streaming import jobs as O

# Extra columns of a run, in SQL both engines read.
EXTRA = {
    "ats_compliance": "CAST(o_orderkey * 53 % 100 AS DOUBLE)", "resume_quality": "CAST(o_orderkey * 47 % 100 AS DOUBLE)", "experience_match": "CAST(o_orderkey * 41 % 100 AS DOUBLE)", "semantic_match": "CAST(o_orderkey * 37 % 100 AS DOUBLE)",
    "quantified_line_count": "o_orderkey * 29 % 4", "has_role_model": "o_orderkey % 2 = 0", "n_matched": "o_orderkey % 8", "n_missing": "o_orderkey % 3", "used_role_baseline": "o_orderkey % 4 = 0",
    "market_source": "CASE o_orderkey % 4 WHEN 0 THEN 'role-baseline' WHEN 1 THEN 'blended-market' ELSE 'live-jobs' END", "baseline_confidence": "CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END",
}
RUNS_SQL = f"{SIGNALS_SQL}, runs AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in EXTRA.items())} FROM signals)"
SOURCES = "CASE l_linenumber % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'weak-resume-proof' WHEN 2 THEN 'live-support' ELSE 'role-family' END"
# A term's gap is its first line of the order: by line number, then part, then the smaller quantity.
FIRST_LINE = "(l_linenumber, l_partkey, l_quantity)"
GAPS_SQL = f"""gp AS (SELECT l_orderkey AS o_orderkey, p_name AS term, min({FIRST_LINE}) AS position, arg_min({SOURCES}, {FIRST_LINE}) AS signal_source, arg_min(l_quantity / 4, {FIRST_LINE}) AS share
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY ALL)"""


def runs(spark, sf):
    return signals(spark, sf).selectExpr("*", *[f"{e} AS {n}" for n, e in EXTRA.items()])


def _ruled(rules):
    return " UNION ALL ".join(f"SELECT o_orderkey, {100 + i} AS no, {S.q(t)} AS title, {S.q(im)} AS impact FROM runs WHERE {c}" for i, (c, t, im) in enumerate(rules))


@query(
    "N1_recommendations",
    f"""WITH {RUNS_SQL}, {GAPS_SQL}, md AS (SELECT l_orderkey AS o_orderkey, p_name AS term, min(l_linenumber) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A' GROUP BY ALL),
    g2 AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY position, term) AS no FROM gp),
    lead AS (SELECT o_orderkey, no, CASE WHEN signal_source IN ('weak-resume-proof', 'live-support') THEN 'Build stronger proof for ' || term WHEN signal_source = 'role-family' THEN 'Consider adding or learning ' || term ELSE 'Add or learn ' || term END AS title,
      CASE signal_source WHEN 'weak-resume-proof' THEN CASE WHEN share >= 8 THEN 'High' ELSE 'Medium' END WHEN 'live' THEN 'High' ELSE 'Medium' END AS impact FROM g2 WHERE no <= 2),
    lt AS (SELECT o_orderkey, count(*) AS n, string_agg(lower(title), '|') AS titles FROM lead GROUP BY 1),
    sp AS (SELECT md.o_orderkey, md.term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY md.o_orderkey ORDER BY md.pos, md.term) AS r FROM md LEFT JOIN lt USING (o_orderkey) WHERE titles IS NULL OR NOT contains(titles, md.term)),
    al AS (SELECT * FROM lead UNION ALL SELECT o_orderkey, r + 10, 'Build stronger proof for ' || term, 'Medium' FROM sp WHERE r <= 3 - n UNION ALL {_ruled(N.RULES)}),
    o1 AS (SELECT o_orderkey, title, min(no) AS no, arg_min(impact, no) AS impact FROM al GROUP BY ALL)
    SELECT o_orderkey, title, impact, position FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY no) AS position FROM o1) WHERE position <= 6""",
)
def n1(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    at = F.struct("l_linenumber", "l_partkey", "l_quantity")
    gaps = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("p_name").alias("term")).agg(
        F.min(at).alias("position"), F.min_by(F.expr(SOURCES), at).alias("signal_source"), F.min_by(F.col("l_quantity") / 4, at).alias("share")
    )
    modelled = lines.filter("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("p_name").alias("term")).agg(F.min("l_linenumber").alias("pos"))
    # gaps of lines whose order is in the orders table
    orders = table(spark, sf, "orders").select("o_orderkey")
    keep = lambda df: df.join(orders, ["o_orderkey"], "left_semi")
    return N.recommendations(runs(spark, sf), "o_orderkey", keep(gaps), keep(modelled))


_FB = {}
for _c, _cond, _m in N.FEEDBACK:
    _FB.setdefault(_c, []).append((_cond, _m))


@query(
    "N2_component_feedback",
    f"WITH {RUNS_SQL} SELECT o_orderkey, " + ", ".join(
        f"coalesce(array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {S.q(m)} END' for c, m in items)}], lambda x: x IS NOT NULL), '|'), '') AS {name}" for name, items in _FB.items()
    ) + " FROM runs",
)
def n2(spark, sf):
    return runs(spark, sf).select("o_orderkey", *[F.array_join(c, "|").alias(n) for n, c in N.component_feedback().items()])


@query(
    "N3_rule_summary",
    f"""WITH {RUNS_SQL}, {GAPS_SQL}, m AS (SELECT o_orderkey, list(term || ' carries ' || share || '% of demand' ORDER BY position, term)[1:3] AS w FROM gp GROUP BY 1)
    SELECT r.o_orderkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN n_matched >= 5 THEN 'strong market alignment' END, CASE WHEN experience_years >= 2 THEN 'credible experience' WHEN experience_years >= 0.25 THEN 'early-career evidence' END,
        CASE WHEN has_projects THEN 'practical projects' END], lambda x: x IS NOT NULL), '|'), ''), 'usable base') AS strengths,
      CASE WHEN used_role_baseline THEN 'baseline market|' ELSE '' END || coalesce(array_to_string(w, '|'), 'add role-specific evidence') AS weaknesses FROM runs r LEFT JOIN m USING (o_orderkey)""",
)
def n3(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    at = F.struct("l_linenumber", "l_partkey", "l_quantity")
    gaps = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("p_name").alias("term")).agg(F.min(at).alias("position"), F.min_by(F.col("l_quantity") / 4, at).alias("share"))
    first = N.top_per_group(gaps, ["o_orderkey"], [F.asc("position"), F.asc("term")], 3)
    listed = first.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "term", "share"))), lambda x: F.struct(x["term"].alias("term"), x["share"].alias("share"))).alias("missing_terms"))
    wide = runs(spark, sf).join(listed, ["o_orderkey"], "left").withColumn("missing_terms", F.coalesce("missing_terms", F.array().cast("array<struct<term:string,share:double>>")))
    return wide.select("o_orderkey", *[F.array_join(c, "|").alias(n) for n, c in N.rule_summary().items() if n != "next_steps"])


# --- stream jobs: batch twins ---------------------------------------------------------

TRUST = "CASE lower(source) " + " ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in X.DEMAND_TRUST.items()) + f" ELSE {X.DEMAND_TRUST_OTHER} END"
FEED = "CASE user_id % 4 WHEN 0 THEN 'jobicy' WHEN 1 THEN 'adzuna' WHEN 2 THEN 'remoteok' ELSE 'other' END"


def sightings(df):
    return df.select("event_id", "ts", F.col("event_type").alias("term"), F.expr(FEED).alias("source"), "value")


@query(
    "O3_demand_over_time",
    f"""WITH t AS (SELECT ts, event_type AS term, {FEED} AS source, value FROM events), w AS (SELECT floor(epoch(ts) / 21600) * 21600 AS s, * FROM t)
    SELECT strftime(make_timestamp(CAST(s AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, term, count(*) AS mentions, {S.rnd(f'sum(CAST({TRUST} AS DOUBLE) * value)', 4)} AS weighted FROM w GROUP BY ALL""",
)
def o3(spark, sf):
    out = O.demand_over_time(sightings(table(spark, sf, "events")), "ts", "term", F.col("source"), F.col("value"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "O4_attempt_rollup_windows",
    f"""WITH {ATTEMPTS_SQL}, w AS (SELECT a.*, floor(epoch(ts) / 21600) * 21600 AS s FROM attempts a JOIN events USING (event_id))
    SELECT strftime(make_timestamp(CAST(s AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, source, count(*) AS requests, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (error <> '') AS errors,
      count(*) FILTER (contains(lower(error), 'timeout')) AS timeouts, CAST(sum(result_count) AS BIGINT) AS raw_returned, {S.rnd('coalesce(max(elapsed_ms) FILTER (elapsed_ms > 0), 0)', 4)} AS max_elapsed_ms FROM w GROUP BY ALL""",
)
def o4(spark, sf):
    out = O.attempt_rollup_stream(attempts_frame(spark, sf)).drop("queries", "query_sketch")
    return out.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "max_elapsed_ms": F.round(F.coalesce("max_elapsed_ms", F.lit(0.0)), 4)})


LANDED_FILES = 8


def _events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # The file source reads folders; a glob of one file keeps the other tables out.
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


SEEN_SQL = "SELECT event_id, ts, event_type AS source, props->>'$.k' AS external_id, value FROM events"


@query(
    "O1_ingest_listings_stream",
    f"""WITH s AS ({SEEN_SQL}) SELECT source, external_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM s GROUP BY source, external_id""",
)
def o1(spark, sf):
    """All events, landed in files, as a stream of listing sightings merged into a table over several batches."""
    from docmarket.sources import listings as L

    folder = new_folder(spark, "listings")
    seen = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("source"), F.get_json_object("props", "$.k").alias("external_id"), "value")
    seen.repartitionByRange(LANDED_FILES, "ts").write.option("maxRecordsPerFile", 5_000_000).parquet(f"{folder}/landed")
    stream = O.read_landed(spark, f"{folder}/landed", seen.schema, files_per_batch=2)

    def merge(before, batch):
        # Every sighting is its own row of the batch and is dated by itself, so no split into batches changes the table.
        fresh = batch.withColumn("arrival", F.col("event_id"))
        return L.upsert_listings(before, fresh, F.col("ts"), ["event_id"], key=key).select(*schema.names)

    key = ["source", "external_id"]
    schema = L.upsert_listings(seen.limit(0), seen.limit(0).withColumn("arrival", F.col("event_id")), F.col("ts"), ["event_id"], key=key).schema
    O.ingest_listings_stream(stream, f"{folder}/table", f"{folder}/checkpoint", schema, merge, key).awaitTermination()
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = spark.read.schema(schema).parquet(f"{folder}/table")
    return out.select("source", "external_id", "event_id", "value", day("created_at").alias("first_seen"), day("last_seen_at").alias("last_seen"))


def _drain(spark, df, mode="append"):
    """Run a stream over everything that has landed into Parquet and read it back."""
    folder = new_folder(spark, "stream")
    job = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("O2_dedupe_stream")
def o2(spark, sf):
    stream = _events_stream(spark, sf).select(F.concat_ws("::", "event_type", F.get_json_object("props", "$.k")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _drain(spark, O.dedupe_stream(stream, "key", "ts"))


@query(
    "O3_demand_stream",
    f"""WITH t AS (SELECT ts, event_type AS term, {FEED} AS source, value FROM events), w AS (SELECT floor(epoch(ts) / 21600) * 21600 AS s, * FROM t)
    SELECT strftime(make_timestamp(CAST(s AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, term, count(*) AS mentions, {S.rnd(f'sum(CAST({TRUST} AS DOUBLE) * value)', 4)} AS weighted
    FROM w WHERE s + 21600 <= (SELECT max(epoch(ts)) FROM events) - 21600 GROUP BY ALL""",
)
def o3_stream(spark, sf):
    """Windows that the watermark, six hours behind the newest event, has closed."""
    rows = sightings(_events_stream(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, O.demand_over_time(rows, "ts", "term", F.col("source"), F.col("value")))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("O4_attempt_stream")
def o4_stream(spark, sf):
    """The roll-up as a stream, its closed windows merged into totals per source."""
    attempts = attempts_of(_events_stream(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    return O.attempt_totals(_drain(spark, O.attempt_rollup_stream(attempts))).drop("query_sketch")
