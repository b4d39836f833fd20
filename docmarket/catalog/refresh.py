"""Tables kept up to date over refreshes: demand sums and requirement profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docmarket.catalog import sql as S
from docmarket.catalog.market import FEED_NAMES, GENERIC, HINTS, MARKET_SQL, by_listing, demand_sql, market_rows, pick
from docmarket.catalog.terms import LEX_SQL, hits_sql, lexicon
from docmarket.operators import demand_state as D, profile_table as P, requirements as Q, terms as E
from docmarket.registry import query
from docmarket.session import cut_lineage, new_folder
from docmarket.sources.listings import PROFILE_VERSION
from docmarket.sources.tables import table, values_frame

# The market after two refreshes: orders ending in 0 and 1 have gone, 7 to 9 have come, those ending in 2 have a new company.
REFRESHED_SQL = MARKET_SQL.replace(
    "'Co ' || (o_custkey % 40) END AS company", "'Co ' || (o_custkey % 40) || CASE WHEN o_orderkey % 10 = 2 THEN ' new' ELSE '' END END AS company"
).replace("1 + o_orderkey % 3 AS dup_divisor FROM orders", "count(*) OVER (PARTITION BY o_orderkey % 6, o_custkey % 50) AS dup_divisor FROM orders WHERE o_orderkey % 10 >= 2")


@query("K1_demand_after_refreshes", f"WITH {REFRESHED_SQL}, {demand_sql()} SELECT query_id, term, count, live_count, company_count, source_count, share FROM demand")
def k1_refreshes(spark, sf):
    listings, terms, n = market_rows(spark, sf, F.concat_ws(":", F.col("o_orderkey") % 6, F.col("o_custkey") % 50).alias("signature"))
    terms, hints = cut_lineage(terms), values_frame(spark, ["query_id", "term", "kind"], HINTS)  # several changes read the terms
    renamed = listings.withColumn("company", F.when(F.col("company") != "", F.concat("company", F.lit(" new"))).otherwise(""))

    end = F.col("listing_id") % 10

    def rows(*change):
        """One pass over what comes (sign 1) and goes (-1), by the last digit of the listing."""
        parts = [some.filter(end.isin(*ends)).withColumn("sign", F.lit(sign)) for some, ends, sign in change]
        named = terms.filter(end.isin(*sorted({e for _, ends, _ in change for e in ends})))
        # How rows lie is not kept with a checkpoint, so the terms of a change are dealt as they are read, and its listings likewise.
        changed = by_listing(reduce(lambda a, b: a.unionByName(b), parts), n)
        return D.demand_rows(changed, by_listing(named, n), hints, F.col("sign"), buckets=16, generic=GENERIC)

    folder = new_folder(spark, "demand")
    D.create_state(rows((listings, range(7), 1)), folder)
    D.refresh_state(spark, folder, rows((listings, (7, 8), 1), (listings, (0, 2), -1), (renamed, (2,), 1)))
    D.refresh_state(spark, folder, rows((listings, (9,), 1), (listings, (1,), -1)))
    return D.demand_of(D.read_state(spark, folder)).select("query_id", "term", "count", "live_count", "company_count", "source_count", "share")


def count_builder(spark):
    """Profiles from the number of times a term occurs."""

    def build(texts):
        hits = cut_lineage(E.match_terms(texts, ["content_hash"], "description", lexicon(spark)))  # for the weights and for the evidence
        con = hits.select("content_hash", "term", (F.lit(0.36) + F.least("n_hits", F.lit(5)) * 0.04).alias("weight"), F.col("n_hits").alias("n"), F.lit(True).alias("extracted"))
        shown = hits.select("content_hash", "term", F.concat("term", F.lit(" x"), F.col("n_hits").cast("string")).alias("snippet"))
        return Q.assemble_profile(Q.requirement_profile(con, texts, "content_hash", "title"), "content_hash", shown)

    return build


PROFILE_SCHEMA = "content_hash string, terms array<string>, weights map<string,double>, evidence array<struct<term:string,snippet:string>>, quality double, mode string, version int"


@query(
    "A9_refresh_profiles",
    f"""WITH {LEX_SQL}, {hits_sql('documents', 'doc_id', 'text')}, h AS (SELECT doc_id, term, count(*) AS n FROM hits GROUP BY ALL),
    w AS (SELECT doc_id, term, n, {S.rnd('least(1, 0.36 + 0.04 * least(n, 5) + least(0.12, (n - 1) * 0.06))', 2)} AS weight FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS pos FROM w),
    p AS (SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS terms, {S.rnd('avg(weight) FILTER (pos <= 6) * 100', 1)} AS quality, string_agg(term || ' x' || n, '|' ORDER BY term) AS evidence FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'own' ELSE coalesce(terms, '') END AS terms, CASE WHEN doc_id % 5 = 4 THEN 1.0 ELSE coalesce(quality, 0.0) END::DOUBLE AS quality,
      CASE WHEN doc_id % 5 = 4 THEN 'own x1' ELSE coalesce(evidence, '') END AS evidence, CASE WHEN doc_id % 5 = 4 THEN 1 ELSE {PROFILE_VERSION} END AS version, CASE WHEN doc_id % 5 = 4 THEN 'salary,skills' ELSE 'salary' END AS extras
    FROM documents LEFT JOIN p USING (doc_id)""",
)
def a9_refresh(spark, sf):
    """A third of the texts have a current profile, a third an old one, a third none; every fifth listing is a baseline with its own."""
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    profile = F.struct(
        F.array(F.lit("own")).alias("terms"), F.create_map(F.lit("own"), F.lit(0.5)).alias("weights"), F.array(F.struct(F.lit("own").alias("term"), F.lit("own x1").alias("snippet"))).alias("evidence"),
        F.lit(1.0).alias("quality"), F.lit("hybrid").alias("mode"), F.lit(1).alias("version"),
    )
    listings = docs.select(
        "doc_id", pick(FEED_NAMES, key % 5).alias("source"), F.col("lang").alias("title"), F.col("text").alias("description"), F.array("source").alias("tags"),
        F.create_map(F.lit("salary"), F.col("n_chars").cast("string"), F.lit("skills"), F.lit("old")).alias("extras"), profile.alias("profile"),
    )
    build = count_builder(spark)
    none = spark.createDataFrame([], PROFILE_SCHEMA)
    known = P.refresh_profiles(listings.filter(key % 3 == 0), none, build)
    hashed = P.content_hash(F.col("title"), F.col("description"), F.col("tags")).alias("content_hash")
    old = listings.filter(key % 3 == 1).select(hashed, "profile.*")
    profiles = cut_lineage(known.unionByName(old.select("content_hash", *P.PARTS)))
    out = P.with_profiles(listings, P.refresh_profiles(listings, profiles, build))
    return out.select(
        "doc_id", F.array_join("profile.terms", "|").alias("terms"), "profile.quality", F.array_join(F.transform("profile.evidence", lambda e: e["snippet"]), "|").alias("evidence"),
        "profile.version", F.array_join(F.array_sort(F.map_keys("extras")), ",").alias("extras"),
    )
