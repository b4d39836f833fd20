"""Dated experience: date ranges in text, interval merging, years of experience."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmarket.functions import text as T
from docmarket.operators.structure import DATE_RANGE, EDUCATION_WORDS, WORK_WORDS

# --- fixed values -------------------------------------------------------------
PROJECT_WORDS = r"\b(project|capstone|case study|prototype|portfolio|thesis|implementation|dashboard|analysis|model|build)\b"
WORK_SECTIONS = ("experience", "teaching", "research")
CONTEXT, CONTEXT_BEFORE = 120, 90
PROJECT_WEIGHT, PROJECT_CAP = 0.55, 12.0
# ------------------------------------------------------------------------------


def plain_dashes(c: Column) -> Column:
    return F.translate(T.normalize_ws(c), "–—", "--")


def extract_date_ranges(sections: DataFrame, keys: Sequence[str], text: str, as_of: Column, pattern: str = DATE_RANGE) -> DataFrame:
    """All ``start - end`` ranges of a text with the text around and before each.

    The position of a match is the length of everything before it; both the pieces
    between matches and the matches are taken in one pass each.
    """

    def find(body: Column) -> Column:
        def place(hits: Column, gaps: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                before_len = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(
                    F.slice(hits, F.lit(1), i), F.lit(0), lambda a, h: a + F.length(h)
                )
                return F.struct(hit.alias("hit"), before_len.alias("at"))

            spots = F.transform(hits, one)
            return F.transform(
                spots,
                lambda s: F.struct(
                    s["hit"].alias("hit"), s["at"].alias("at"),
                    F.substring(body, F.greatest(s["at"] - CONTEXT, F.lit(0)) + 1, F.least(s["at"], F.lit(CONTEXT)) + F.length(s["hit"]) + CONTEXT).alias("context"),
                    F.substring(body, F.greatest(s["at"] - CONTEXT_BEFORE, F.lit(0)) + 1, F.least(s["at"], F.lit(CONTEXT_BEFORE))).alias("before"),
                ),
            )

        hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        return T.let(hits, lambda h: F.when(F.size(h) > 0, T.let(F.split(body, pattern), lambda g: place(h, g))))

    found = T.explode_once(sections, keys, T.let(plain_dashes(F.col(text)), find), "r").select(*keys, "r.*")
    start, end = F.regexp_extract("hit", pattern, 1), F.regexp_extract("hit", pattern, 2)
    return found.withColumns({"start_date": T.parse_partial_date(start, as_of), "end_date": T.parse_partial_date(end, as_of)})


def classify_range(ranges: DataFrame, work: str = WORK_WORDS, project: str = PROJECT_WORDS, education: str = EDUCATION_WORDS) -> DataFrame:
    """Keep ranges with a work or project sign and put them in the bucket ``primary`` or ``project``."""
    sec = F.col("section")
    has = lambda c, words: F.col(c).rlike("(?iU)" + words)
    marked = ranges.withColumns(
        {"__work": sec.isin(*WORK_SECTIONS) | has("context", work), "__proj": (sec == "projects") | has("context", project),
         "__edu": has("context", education), "__edu_before": has("before", education)}
    )
    keep = (F.col("__work") | F.col("__proj")) & ~(F.col("__edu_before") & (sec != "projects"))
    keep = keep & ~(F.col("__edu") & ~sec.isin("projects", "summary") & ~F.col("__work"))
    bucket = F.when((sec == "projects") | ((sec == "summary") & ~F.col("__work")), F.lit("project")).otherwise(F.lit("primary"))
    valid = F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & (F.col("start_date") <= F.col("end_date"))
    return marked.filter(keep & valid).withColumn("bucket", bucket).drop("__work", "__proj", "__edu", "__edu_before")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of overlapping intervals per key (``start <= running end``; touching months stay apart).

    First the longest interval per start date, with partial aggregation. After that a
    key has at most one row per calendar day, so the window's group is bounded by the
    calendar however many intervals the key had.
    """
    day = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    order = Window.partitionBy(*keys).orderBy(start)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = day.withColumn("__new", F.when(F.col(start) <= before, 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def months_between_inclusive(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


def interval_years(intervals: DataFrame, key: str, bucket: str = "bucket", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Years per key from merged intervals; project months count 0.55 each, at most 12."""
    merged = merge_intervals(intervals, [key, bucket], start, end)
    months = months_between_inclusive(F.col(start), F.col(end))
    total = merged.groupBy(key).agg(
        F.sum(F.when(F.col(bucket) == "primary", months).otherwise(0)).alias("primary_months"),
        F.sum(F.when(F.col(bucket) == "project", months).otherwise(0)).alias("project_months"),
    )
    weighted = F.least(F.col("project_months") * F.lit(PROJECT_WEIGHT), F.lit(PROJECT_CAP))
    return total.withColumn("interval_years", F.round((F.col("primary_months") + weighted) / 12, 2))


def stated_years(text: Column) -> tuple[Column, Column]:
    """(years, months as years) of the first "N years" and "N months" in the text; null if not stated."""
    low = F.lower(plain_dashes(text))
    number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).cast("double")
    return number(T.REQUIRED_YEARS), F.round(number(T.STATED_MONTHS) / 12, 2)


# Reading order of the sections that may state a duration.
FOCUS_ORDER = ("summary", "experience", "projects", "research", "teaching", "unsectioned")


def experience_years(sections: DataFrame, doc_id: str, as_of: Column) -> DataFrame:
    """(doc_id, experience_years): the larger of dated intervals and the first stated duration.

    ``sections`` has (doc_id, section, text); documents without a focus section are
    expected as one row with section ``unsectioned``.
    """
    focus = sections.filter(F.col("section").isin(*FOCUS_ORDER))
    ranges = classify_range(extract_date_ranges(focus, [doc_id, "section"], "text", as_of))
    dated = interval_years(ranges, doc_id).select(doc_id, "interval_years")
    place = F.array_position(T.lit_array(FOCUS_ORDER), F.col("section"))
    years, months = stated_years(F.col("text"))
    said = focus.select(doc_id, place.alias("place"), years.alias("y"), months.alias("m")).groupBy(doc_id).agg(
        F.min_by("y", F.when(F.col("y").isNotNull(), F.col("place"))).alias("y"), F.min_by("m", F.when(F.col("m").isNotNull(), F.col("place"))).alias("m")
    )
    total = said.join(dated, [doc_id], "left")
    zero = F.lit(0.0)
    return total.select(doc_id, F.greatest(F.coalesce("y", zero), F.coalesce("m", zero), F.coalesce("interval_years", zero)).alias("experience_years"))
