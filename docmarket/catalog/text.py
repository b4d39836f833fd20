"""Text functions over whole texts of documents, pages, conversations and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket.catalog import sql as S
from docmarket.functions import text as T
from docmarket.registry import query
from docmarket.sources.tables import table

def _sql_map(names) -> str:
    return f"MAP({S.str_list(names)}, {S.str_list(names.values())})"


def sql_unescape(expr: str) -> str:
    """Character references as browsers read them: numeric ones, every HTML name, the longest bare name without a semicolon."""
    bare = "|".join(sorted(T.BARE_NAMES, key=lambda n: (-len(n), n)))
    number, name, short = "regexp_extract(p, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?')", "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]{1,31});', 1)", f"regexp_extract(p, '^(?:{bare})')"
    digits, hexes = "regexp_extract(p, '^#0*([0-9]*)', 1)", "regexp_extract(p, '^#[xX]0*([0-9a-fA-F]*)', 1)"
    code = f"(CASE WHEN greatest(length({digits}), length({hexes})) > 7 THEN 1114112 WHEN regexp_matches(p, '^#[xX]') THEN CAST('0x0' || {hexes} AS INTEGER) ELSE CAST('0' || {digits} AS INTEGER) END)"
    character = (
        f"CASE WHEN {code} BETWEEN 128 AND 159 THEN substring({S.q(T.CONTROLS)}, {code} - 127, 1) WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) "
        f"WHEN {code} BETWEEN 1 AND 8 OR {code} = 11 OR {code} BETWEEN 14 AND 31 OR {code} = 127 OR {code} BETWEEN 64976 AND 65007 OR ({code} & 65534) = 65534 THEN '' ELSE chr({code}) END"
    )
    one = (
        f"CASE WHEN {number} <> '' THEN {character} || substring(p, length({number}) + 1) "
        f"WHEN {name} <> '' AND {name} IN {S.in_list(T.ENTITY_NAMES)} THEN {_sql_map(T.ENTITY_NAMES)}[{name}] || substring(p, length({name}) + 2) "
        f"WHEN {short} <> '' THEN {_sql_map(T.BARE_NAMES)}[{short}] || substring(p, length({short}) + 1) ELSE '&' || p END"
    )
    pieces = f"string_split({expr}, '&')"
    return f"CASE WHEN contains({expr}, '&') THEN {pieces}[1] || array_to_string(list_transform({pieces}[2:], lambda p: {one}), '') ELSE {expr} END"


def sql_strip_html(expr: str) -> str:
    expr = sql_unescape(f"coalesce({expr}, '')")
    expr = f"regexp_replace({expr}, '(?i)<script[\\s\\S]*?</script>', ' ', 'g')"
    expr = f"regexp_replace({expr}, '(?i)<style[\\s\\S]*?</style>', ' ', 'g')"
    return S.ws(f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')")


def sql_clip(text: str, n: int) -> str:
    """``text`` must be normalised and cheap to repeat (a column)."""
    head = f"substring({text}, 1, {n - 3})"
    sent = f"length(regexp_extract({head}, '(?s)^(.*)[.!?] ', 1))"
    blank = f"length(regexp_extract({head}, '(?s)^(.*) ', 1))"
    return (
        f"CASE WHEN length({text}) <= {n} THEN {text} ELSE regexp_replace(CASE "
        f"WHEN {sent} >= {max(32, int(n * 0.35))} THEN substring({head}, 1, {sent} + 1) "
        f"WHEN {blank} >= {max(24, int(n * 0.3))} THEN substring({head}, 1, {blank}) ELSE {head} END, "
        "'[ ,;:-]+$', '') || '...' END"
    )


@query("B1_strip_html", f"SELECT page_id, {sql_strip_html('html')} AS body FROM pages")
def b1(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("B2_normalize_ws", f"SELECT doc_id, {S.ws('text')} AS body FROM documents")
def b2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("body"))


@query(
    "B3_clip",
    f"WITH t AS (SELECT doc_id, {S.ws('text')} AS x FROM documents) "
    f"SELECT doc_id, {sql_clip('x', 260)} AS preview, {sql_clip('x', 4000)} AS description FROM t",
)
def b3(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.clip(text, 260).alias("preview"), T.clip(text, 4000).alias("description"))


@query("B4_clean_label", f"SELECT doc_id, {S.clean_label('text')} AS label FROM documents")
def b4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_label(F.col("text")).alias("label"))


@query("B5_compact", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9+]+', '', 'g') AS key FROM documents")
def b5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.compact(F.col("text")).alias("key"))


def sql_fold(expr: str) -> str:
    e = S.camel(S.ws(expr))
    # dotted acronyms of two to four letters; longer ones do not occur in the tables
    for k in (4, 3, 2):
        groups = "".join(r"([A-Za-z])\." for _ in range(k))
        keep = "".join(f"\\{i}" for i in range(2, k + 2))
        e = f"regexp_replace({e}, '(^|[^A-Za-z]){groups}([^A-Za-z.]|$)', '\\1{keep}\\{k + 2}', 'g')"
    e = f"replace(lower({e}), '&', ' and ')"
    e = f"regexp_replace({e}, '[_/|•·-]+', ' ', 'g')"
    e = f"regexp_replace({e}, '[^a-z0-9+#.]+', ' ', 'g')"
    return f"trim(regexp_replace(replace({e}, '.', ' '), ' +', ' ', 'g'))"


@query("B6_fold_term", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def b6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_term(F.col("text")).alias("folded"))


@query("B7_compact_term", f"SELECT doc_id, replace({sql_fold('text')}, ' ', '') AS key FROM documents")
def b7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.compact_term(F.col("text")).alias("key"))


PHRASES = ("the", "of the", "understand", "with", "ein", "la de", "retiontion")


def sql_contains_phrase(hay: str, needle: str) -> str:
    """``hay`` and ``needle`` cleaned; needles without plus signs."""
    tight = f"contains(replace({hay}, ' ', ''), replace({needle}, ' ', ''))"
    return (
        f"CASE WHEN {hay} = '' OR {needle} = '' THEN false WHEN contains({needle}, ' ') THEN contains({hay}, {needle}) OR {tight} "
        f"ELSE contains(' ' || replace({hay}, '+', ' ') || ' ', ' ' || {needle} || ' ') OR (length({needle}) >= 8 AND {tight}) END"
    )


@query(
    "B8_contains_phrase",
    f"WITH t AS (SELECT doc_id, {S.clean_words('text')} AS x FROM documents), p AS {S.values(['phrase'], [(p,) for p in PHRASES])} "
    f"SELECT doc_id, phrase FROM t CROSS JOIN p WHERE {sql_contains_phrase('x', 'phrase')}",
)
def b8(spark, sf):
    found = T.let(T.clean_words(F.col("text")), lambda hay: F.filter(T.lit_array(PHRASES), lambda p: T.contains_clean(hay, p)))
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("phrase"))


def sql_token_set(expr: str, min_len: int = 2) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({expr}), {S.q(S.SPACE + '+')}), lambda t: length(t) > {min_len}))"


@query("B9_token_set", f"SELECT item_id, unnest({sql_token_set('text')}) AS token FROM benchmark "
       f"UNION ALL SELECT -1 - doc_id, unnest({sql_token_set('text')}) FROM documents")
def b9(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", "text")
    docs = table(spark, sf, "documents").select((F.lit(-1) - F.col("doc_id")).alias("item_id"), "text")
    return items.unionAll(docs).select("item_id", F.explode(T.token_set(F.col("text"))).alias("token"))


@query(
    "B10_important_terms",
    "SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array(lower(" + S.ws("text") + "), '[^a-z0-9+#.]+'), "
    f"lambda t: length(t) >= 3 AND t NOT IN {S.in_list(T.IMPORTANT_STOPWORDS)}))) AS term FROM conversations",
)
def b10(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.important_terms(F.col("text"))).alias("term"))


@query(
    "B11_role_tokens",
    f"SELECT conv_id, turn, unnest(list_distinct(list_filter(string_split({S.clean_label('text')}, ' '), lambda t: length(t) > 2 AND t NOT IN "
    f"{S.in_list(T.ROLE_STOPWORDS + T.ROLE_GENERIC_TOKENS)}))) AS token FROM conversations",
)
def b11(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.role_tokens(F.col("text"))).alias("token"))


@query(
    "B12_dedupe_adjacent_words",
    f"WITH t AS (SELECT doc_id, {S.words('lower(text)')} AS w FROM documents) "
    "SELECT doc_id, coalesce(array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' '), '') AS body FROM t",
)
def b12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.dedupe_adjacent_words(F.lower(F.col("text"))).alias("body"))


@query(
    "B13_slugify",
    "SELECT page_id, CASE WHEN s = '' THEN 'role' ELSE s END AS slug FROM (SELECT page_id, "
    "regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)",
)
def b13(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query(
    "B14_extract_contact",
    f"SELECT doc_id, regexp_extract(text, {S.q(T.EMAIL)}, 0) AS email, regexp_extract(text, {S.q(T.PHONE)}, 0) AS phone FROM documents",
)
def b14(spark, sf):
    contact = T.extract_contact(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", contact["email"].alias("email"), contact["phone"].alias("phone"))


@query(
    "B15_extract_years",
    f"SELECT doc_id, y AS year FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, {S.q(T.YEAR)}), "
    "lambda v: CAST(v AS INTEGER)))) AS y FROM documents)",
)
def b15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.extract_years(F.col("text"))).alias("year"))


# Marker lexicons are arguments; the tables' prose is in an invented language, so
# its own frequent words stand in for the domain words.
TABLE_MARKERS = {"common": r"\b(the|and|of the|with)\b", "foreign": r"\b(ein|der|que|les)\b", **T.MARKERS}


@query(
    "B16_count_markers",
    f"WITH t AS (SELECT doc_id, {S.ascii_words('text')} AS x FROM documents) SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(x, {S.q('(?i)' + p)})) AS {n}_markers" for n, p in TABLE_MARKERS.items())
    + " FROM t",
)
def b16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *T.count_markers(F.col("text"), TABLE_MARKERS).values())


# Texts that state a duration: order numbers written out, one per order line.
@query(
    "B17_required_years",
    "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'asks for ' || (o_orderkey % 14) || '+ Years in ' || o_orderpriority "
    "WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 30) || ' years, or 2 years' ELSE o_orderpriority END AS x FROM orders) "
    f"SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract(lower(x), {S.q(T.REQUIRED_YEARS)}, 1), '') AS INTEGER), -1) AS years FROM t",
)
def b17(spark, sf):
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit("asks for "), key % 14, F.lit("+ Years in "), priority))
        .when(key % 3 == 1, F.concat(key % 30, F.lit(" years, or 2 years")))
        .otherwise(priority)
    )
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(T.required_years(text), F.lit(-1)).alias("years"))


@query(
    "B18_parse_partial_date",
    "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%B %Y') WHEN 1 THEN strftime(o_orderdate, '%m/%Y') "
    "WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'Present' ELSE (13 + o_orderkey % 40) || '/2001' END AS x, "
    "o_orderkey % 5 AS k, o_orderdate AS d FROM orders) "
    "SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-01') WHEN 1 THEN strftime(d, '%Y-%m-01') WHEN 2 THEN strftime(d, '%Y-01-01') "
    "WHEN 3 THEN '2024-05-01' ELSE '' END AS first_day FROM t",
)
def b18(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = (
        F.when(key % 5 == 0, F.date_format(day, "MMMM yyyy"))
        .when(key % 5 == 1, F.date_format(day, "MM/yyyy"))
        .when(key % 5 == 2, F.date_format(day, "yyyy"))
        .when(key % 5 == 3, F.lit("Present"))
        .otherwise(F.concat((key % 40 + 13), F.lit("/2001")))
    )
    parsed = T.parse_partial_date(text, F.lit("2024-05-17").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(parsed.cast("string"), F.lit("")).alias("first_day"))


# Texts with links: page addresses written next to each other.
LINKS_SQL = "concat('see ', url, ' and https://github.com/', page_id, ' or ', url, ' http://my.portfolio.example/SCIFIIT')"


def links_text():
    return F.concat(
        F.lit("see "), F.col("url"), F.lit(" and https://github.com/"), F.col("page_id"), F.lit(" or "), F.col("url"),
        F.lit(" http://my.portfolio.example/SCIFIIT"),
    )


@query(
    "B19_audit_urls",
    f"WITH t AS (SELECT page_id, list_distinct(regexp_extract_all({LINKS_SQL}, 'https?://\\S+')) AS u FROM pages) "
    "SELECT page_id, len(u) AS n_urls, len(list_filter(u, lambda x: NOT contains(lower(x), 'linkedin') AND NOT contains(lower(x), 'github'))) "
    "+ len(list_filter(u, lambda x: regexp_matches(lower(x), 'linfiedin|scifiit|sefihar'))) AS points FROM t",
)
def b19(spark, sf):
    text = links_text()
    return table(spark, sf, "pages").select("page_id", F.size(T.urls(text)).alias("n_urls"), T.audit_urls(text).alias("points"))


@query(
    "B20_suspicious_tokens",
    f"SELECT page_id, unnest(list_distinct(list_filter({S.words('html')}, lambda w: contains(w, '=') OR "
    "regexp_matches(lower(w), 'linfiedin|scifiit|sefihar')))) AS token FROM pages",
)
def b20(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.suspicious_tokens(F.col("html"))).alias("token"))


@query(
    "B21_profile_links",
    f"WITH t AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all({LINKS_SQL}, 'https?://\\S+'), lambda x: lower(x))) AS u FROM pages) "
    "SELECT page_id, len(list_filter(u, lambda x: regexp_matches(x, 'linkedin|github|portfolio|behance|dribbble'))) AS contact_links, "
    "len(list_filter(u, lambda x: regexp_matches(x, 'github|portfolio|behance|dribbble'))) AS portfolio_links FROM t",
)
def b21(spark, sf):
    found = T.urls(links_text())
    return table(spark, sf, "pages").select(
        "page_id", F.size(T.contact_links(found)).alias("contact_links"), F.size(T.portfolio_links(found)).alias("portfolio_links")
    )
