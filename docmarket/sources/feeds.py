"""Landed feed records to the one listing schema."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as TY

from docmarket.functions.text import clip, strip_html

LISTING_SCHEMA = TY.StructType(
    [
        TY.StructField("source", TY.StringType(), False),
        TY.StructField("external_id", TY.StringType()),
        TY.StructField("title", TY.StringType()),
        TY.StructField("company", TY.StringType()),
        TY.StructField("location", TY.StringType()),
        TY.StructField("remote", TY.BooleanType()),
        TY.StructField("url", TY.StringType()),
        TY.StructField("description", TY.StringType()),
        TY.StructField("tags", TY.ArrayType(TY.StringType())),
        TY.StructField("posted_at", TY.TimestampType()),
        TY.StructField("extras", TY.MapType(TY.StringType(), TY.StringType())),
    ]
)


@dataclass(frozen=True)
class Feed:
    """How one feed fills the listing schema. Paths are tried in order, blanks skipped."""

    ids: tuple[str, ...]
    company: tuple[str, ...] = ()
    location: tuple[str, ...] = ()
    url: tuple[str, ...] = ()
    posted: tuple[str, ...] = ()
    title: tuple[str, ...] = ("title",)
    description: tuple[str, ...] = ("description",)
    tags: tuple[str, ...] = ()
    category: str | None = None
    extras: tuple[str, ...] = ()
    # where "remote" is read from: always, never, flag:<path>, or text in title/description/location
    remote: tuple[str, ...] = ("title", "description")
    default_company: str = "Unknown Company"
    default_location: str = "Remote"
    default_url: str = ""
    constants: Mapping[str, str] = field(default_factory=dict)


# --- fixed values: field names of the public feeds ----------------------------
FEEDS: dict[str, Feed] = {
    "adzuna": Feed(("id", "redirect_url", "title"), ("company.display_name",), ("location.display_name",), ("redirect_url",), ("created",),
                   category="category.label", extras=("salary_min", "salary_max"), default_location="India", default_url="https://www.adzuna.com"),
    "arbeitnow": Feed(("slug", "url", "title"), ("company_name", "company"), ("location",), ("url",), ("created_at", "published_at"),
                      tags=("tags",), extras=("job_types", "visa_sponsorship"), remote=("flag:remote", "location"),
                      default_url="https://www.arbeitnow.com"),
    "greenhouse": Feed(("id", "absolute_url"), ("company_name",), ("location.name",), ("absolute_url",), ("updated_at", "updatedAt"),
                       description=("content",), extras=("board_token",), remote=("location", "description"), default_location="Unknown"),
    "indianapi": Feed(("apply_link", "url", "link"), ("company",), ("location",), ("apply_link", "url", "link"), ("posted_at", "date", "published_at"),
                      extras=("salary",), remote=("location", "description")),
    "jobicy": Feed(("id", "jobSlug", "url", "title"), ("companyName",), ("jobGeo",), ("url",), ("pubDate",), title=("jobTitle",),
                   description=("jobDescription", "jobExcerpt"), tags=("jobIndustry", "jobType"), extras=("jobLevel",), remote=("always",),
                   default_url="https://jobicy.com"),
    "jooble": Feed(("link",), ("company",), ("location",), ("link",), ("updated",), description=("snippet",), tags=("type", "source"),
                   extras=("salary",)),
    "lever": Feed(("id", "hostedUrl"), ("company",), ("categories.location",), ("hostedUrl",), ("createdAt", "updatedAt"), title=("text",),
                  description=("descriptionPlain", "description"), remote=("location", "description"), default_location="Unknown"),
    "remoteok": Feed(("id", "slug", "url", "position"), ("company",), ("location",), ("url",), ("date", "epoch"), title=("position",),
                     tags=("tags",), extras=("salary_min", "salary_max", "benefits"), remote=("always",), default_url="https://remoteok.com"),
    "remotive": Feed(("id",), ("company_name",), ("candidate_required_location",), ("url",), ("publication_date",), tags=("tags",),
                     extras=("category", "salary"), remote=("always",), default_url="https://remotive.com"),
    "themuse": Feed(("id",), ("company.name",), ("locations.name",), ("refs.landing_page",), ("publication_date",), title=("name",),
                    description=("contents",), extras=("categories", "levels"), remote=("location",), default_url="https://www.themuse.com"),
    "usajobs": Feed(("PositionID",), ("OrganizationName",), ("PositionLocationDisplay",), ("PositionURI",), ("PublicationStartDate",),
                    title=("PositionTitle",), description=("UserArea.Details.JobSummary", "QualificationSummary"), remote=("never",),
                    default_company="USAJOBS"),
}
# ------------------------------------------------------------------------------


def _has(df: DataFrame, path: str) -> bool:
    node: TY.DataType = df.schema
    for part in path.split("."):
        if isinstance(node, TY.ArrayType):
            node = node.elementType
        if not isinstance(node, TY.StructType) or part not in node.names:
            return False
        node = node[part].dataType
    return True


def _text(df: DataFrame, path: str) -> Column:
    node: TY.DataType = df.schema
    for part in path.split("."):
        node = (node.elementType if isinstance(node, TY.ArrayType) else node)[part].dataType
    value = F.col(path)
    if isinstance(node, TY.ArrayType) or "." in path and isinstance(df.schema[path.split(".")[0]].dataType, TY.ArrayType):
        value = F.array_join(F.slice(value.cast("array<string>"), 1, 2), ", ")
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_of(df: DataFrame, paths: tuple[str, ...], default: str | None = None) -> Column:
    """First non-blank of the paths the feed has, else the default."""
    found = [_text(df, p) for p in paths if _has(df, p)]
    found.append(F.lit(default).cast("string"))
    return F.coalesce(*found)


def parse_timestamp_any(c: Column) -> Column:
    """ISO text (``Z`` allowed) or an epoch number in seconds or milliseconds; null otherwise."""
    number = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    return F.when(number.isNull(), F.try_to_timestamp(c)).when(F.abs(seconds) < 253402300800, F.timestamp_seconds(seconds))


def split_category_tags(label: Column, fallback: Column) -> Column:
    """Parts of a category label between ``/`` and ``>``; the fallback if there are none."""
    parts = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), "[/>]"), lambda x: F.trim(x)), lambda t: t != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce(F.nullif(F.trim(label), F.lit("")), fallback)))


def _tags(df: DataFrame, feed: Feed, fallback: Column) -> Column:
    if feed.category and _has(df, feed.category):
        return split_category_tags(_text(df, feed.category), fallback)
    parts = []
    for path in feed.tags:
        if _has(df, path):
            is_list = isinstance(df.schema[path.split(".")[0]].dataType, TY.ArrayType)
            parts.append(F.col(path).cast("array<string>") if is_list else F.array(F.col(path).cast("string")))
    if not parts:
        return F.array(fallback)
    flat = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    tags = F.filter(F.transform(flat, lambda x: F.trim(x)), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(fallback))


def _body(text: Column, limit: int | None) -> Column:
    """A text without markup, whole or clipped."""
    return strip_html(text) if limit is None else clip(strip_html(text), limit)


def to_listing(df: DataFrame, source: str, feed: Feed, query: Column | None = None, limit: int | None = None) -> DataFrame:
    """One feed's raw records in the listing schema; descriptions are whole or clipped to ``limit`` characters."""
    title = first_of(df, feed.title, "Unknown Role")
    description = _body(first_of(df, feed.description, ""), limit)
    location = first_of(df, feed.location, feed.default_location)
    places = {"title": title, "description": description, "location": location}
    tests = []
    for rule in feed.remote:
        if rule in ("always", "never"):
            tests.append(F.lit(rule == "always"))
        elif rule.startswith("flag:"):
            if _has(df, rule[5:]):
                tests.append(F.coalesce(F.col(rule[5:]).cast("boolean"), F.lit(False)))
        else:
            tests.append(F.contains(F.lower(places[rule]), F.lit("remote")))
    extras = [x for name in feed.extras if _has(df, name) for x in (F.lit(name), F.col(name).cast("string"))]
    out = df.select(
        F.lit(source).alias("source"),
        first_of(df, feed.ids, "").alias("external_id"),
        title.alias("title"),
        first_of(df, feed.company, feed.default_company).alias("company"),
        location.alias("location"),
        reduce(lambda a, b: a | b, tests).alias("remote"),
        first_of(df, feed.url, feed.default_url).alias("url"),
        description.alias("description"),
        _tags(df, feed, query if query is not None else F.lit("listing")).alias("tags"),
        parse_timestamp_any(first_of(df, feed.posted)).cast("timestamp").alias("posted_at"),
        (F.create_map(*extras) if extras else F.create_map()).cast("map<string,string>").alias("extras"),
    )
    return out


def unify_listings(raw_by_source: Mapping[str, DataFrame], feeds: Mapping[str, Feed] = FEEDS, limit: int | None = None) -> DataFrame:
    """Union of all feeds in the listing schema."""
    frames = [to_listing(df, source, feeds[source], limit=limit) for source, df in raw_by_source.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prepare_listing_text(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Markup out of description and preview; the preview is clipped, the description whole or clipped to ``limit``."""
    lead = F.coalesce(F.nullif(F.col("preview"), F.lit("")), F.col("description")) if "preview" in df.columns else F.col("description")
    return df.withColumns({"description": _body(F.col("description"), limit), "preview": clip(strip_html(lead), 260)})
