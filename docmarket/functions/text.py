"""Text functions as plain Spark columns (no Python UDF).

Regular expressions that use ``\\b`` or ``\\w`` carry ``(?U)`` so that accented
letters count as word characters on every JDK.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
# White space as Unicode-aware text splitting sees it.
SPACE = r"[\s\x0B\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Before SPACE: one look at the next character passes over printable ASCII, which the class would test range by range.
NO_MARK = "(?![!-~])"
# Letters and digits one by one: Java looks a class of single characters up in a table, but walks through one of ranges.
LOWER = "abcdefghijklmnopqrstuvwxyz0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+91|\+1)?[ -]?(?:\d[ -]?){10,12}"
YEAR = r"((?:19|20)\d{2})"
URL = r"https?://\S+"
REQUIRED_YEARS = r"(\d{1,2})\+?\s+years"
STATED_MONTHS = r"(\d{1,2})\+?\s+months?"
MONTH_NAME = (
    r"(?:jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august"
    r"|sep|sept|september|oct|october|nov|november|dec|december)"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
OPEN_END = ("present", "current", "now")
NOISE_MARKERS = ("linfiedin", "scifiit", "sefihar")
CONTACT_DOMAINS = ("linkedin", "github", "portfolio", "behance", "dribbble")
PORTFOLIO_DOMAINS = ("github", "portfolio", "behance", "dribbble")
IMPORTANT_STOPWORDS = ("and", "are", "for", "from", "job", "role", "the", "this", "that", "with", "your")
ROLE_STOPWORDS = ("and", "the", "for", "with", "role", "remote")
ROLE_GENERIC_TOKENS = (
    "engineer", "developer", "manager", "executive", "representative", "analyst", "specialist",
    "associate", "assistant", "consultant", "coordinator", "lead", "director", "architect",
    "technician", "officer", "administrator", "admin", "designer", "scientist", "owner",
    "recruiter", "accountant", "generalist", "intern",
)
MARKERS: dict[str, str] = {
    "academic": r"\b(publication|publications|journal|conference|research|thesis|dissertation|teaching assistant|faculty)\b",
    "teaching": r"\b(curriculum|lesson planning|classroom|pedagogy|lecturer|faculty|teacher|student engagement)\b",
    "executive": r"\b(director|vice president|vp|head of|strategy|p&l|stakeholder management|organizational)\b",
    "creative": r"\b(behance|dribbble|portfolio|branding|visual design|ux|ui|art direction|creative)\b",
    "technical": r"\b(github|portfolio|deployed|api|microservice|full stack|machine learning|dashboard|cloud)\b",
    "certification": r"\b(certification|certified|coursework|license|credential|training)\b",
    "objective": r"\bobjective\b",
    "first_person": r"\b(i|me|my|mine)\b",
}
# ----------------------------------------------------------------------------


def lit_array(values: Sequence) -> Column:
    """A literal array; an empty one keeps the string type."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lit_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def explode_once(df, keep: Sequence, array: Column, name: str, pos: str | None = None):
    """Rows of an array column, the array computed once.

    For a plain ``explode`` Spark infers a filter on the array's size and computes a
    long expression again for it; the outer form with a filter on the result does not.
    """
    made = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())


def words(c: Column) -> Column:
    """White-space tokens, empty ones left out."""
    return F.filter(F.split(c, f"{NO_MARK}{SPACE}+"), lambda w: w != "")


def alternation(phrases: Sequence[str]) -> str:
    """A longest-first alternation of literal phrases."""
    ordered = sorted(set(phrases), key=lambda p: (-len(p), p))
    return "|".join("".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in p) for p in ordered)


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """True if the text holds one of the literal phrases anywhere."""
    if not phrases or not all(phrases):
        return F.lit(bool(phrases))
    # One look at the first letter passes over most places without trying the phrases one after the other.
    first = alternation({p[0] for p in phrases}).replace("|", "")
    return c.rlike(f"(?=[{first}])(?:{alternation(phrases)})")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda Spark computes an outer expression anew for every element, and a
    column from an earlier ``select`` may be inlined there; binding it avoids that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def normalize_ws(c: Column) -> Column:
    """Runs of white space to one blank, trimmed; null becomes empty.

    Single blanks, by far the most common, are left alone by the pattern.
    """
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{NO_MARK}(?: {NO_MARK}{SPACE}+|(?! ){SPACE}+)", " "))


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


# Names in frequency order first: a map literal is searched front to back.
_COMMON_NAMES = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "middot", "ndash", "mdash", "rsquo", "bull")
# What a reference to a control of the C1 block stands for: the windows-1252 character of that byte, if there is one.
CONTROLS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _entity_names() -> dict[str, str]:
    """All names that end in a semicolon, from the HTML table: common ones, then Latin-1 and punctuation, then the rest."""
    table = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    rank = {name: i for i, name in enumerate(_COMMON_NAMES)}
    near = lambda text: len(text) == 1 and (ord(text) < 0x100 or 0x2010 <= ord(text) <= 0x2044 or text in "€™")
    return dict(sorted(table.items(), key=lambda x: (rank.get(x[0], len(rank)), not near(x[1]), x[0])))


ENTITY_NAMES = _entity_names()
#: Names that count without a semicolon too, even when more letters follow.
BARE_NAMES = {name: text for name, text in html5.items() if not name.endswith(";")}


def _packed_map(table: dict[str, str]) -> Column:
    """A map literal from one string, folded once by the optimizer."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))


def _numeric_character(code: Column) -> Column:
    """The character of a numeric reference as browsers read it; not a character: empty, not a code point: U+FFFD."""
    return (
        F.when(code.between(0x80, 0x9F), F.substring(F.lit(CONTROLS), (code - 0x7F).cast("int"), F.lit(1)))
        .when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
        .otherwise(_code_point(code))
    )


def unescape_html(c: Column) -> Column:
    """Character references to characters, once (``&amp;lt;`` becomes ``&lt;``).

    Covers numeric references and every name of the HTML table, those of two characters included. A
    name with a semicolon is looked up whole; otherwise the longest name that needs none is taken from
    the front and what follows stays. Unknown references stay as they are.
    """
    longest_first = "|".join(sorted(BARE_NAMES, key=lambda n: (-len(n), n)))
    after = lambda piece, used: F.substring(piece, used + F.lit(1), F.length(piece))

    def one(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits, hexes = F.regexp_extract(number, "^#0*([0-9]*)", 1), F.regexp_extract(number, "^#[xX]0*([0-9a-fA-F]*)", 1)
        code = F.when(F.greatest(F.length(digits), F.length(hexes)) > 7, F.lit(0x110000)).when(
            number.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), hexes), 16, 10).cast("bigint")
        ).otherwise(F.concat(F.lit("0"), digits).cast("bigint"))
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]{1,31});", 1)
        bare = F.regexp_extract(piece, f"^(?:{longest_first})", 0)
        return F.coalesce(
            F.when(number != "", F.concat(_numeric_character(code), after(piece, F.length(number)))),
            F.when(name != "", F.concat(F.try_element_at(_packed_map(ENTITY_NAMES), name), after(piece, F.length(name) + 1))),
            F.when(bare != "", F.concat(F.try_element_at(_packed_map(BARE_NAMES), bare), after(piece, F.length(bare)))),
            F.concat(F.lit("&"), piece),
        )

    pieces = F.split(c, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.concat(pieces[0], F.array_join(rest, "")))


def strip_html(c: Column) -> Column:
    """Unescape first, drop script and style blocks, tags to blanks, collapse."""
    text = unescape_html(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"(?i)<script[\s\S]*?</script>", " ")
    text = F.regexp_replace(text, r"(?i)<style[\s\S]*?</style>", " ")
    return normalize_ws(F.regexp_replace(text, r"<[^>]+>", " "))


def clip(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at a sentence end, else a blank, and mark the cut."""

    def cut(head: Column) -> Column:
        sentence = F.length(F.regexp_extract(head, r"(?s)^(.*)[.!?] ", 1))
        blank = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
        kept = (
            F.when(sentence >= max(32, int(limit * 0.35)), F.substring(head, F.lit(1), sentence + 1))
            .when(blank >= max(24, int(limit * 0.3)), F.substring(head, F.lit(1), blank))
            .otherwise(head)
        )
        return F.concat(F.regexp_replace(kept, r"[ ,;:-]+$", ""), F.lit("..."))

    return let(normalize_ws(c), lambda text: F.when(F.length(text) <= limit, text).otherwise(let(F.substring(text, 1, limit - 3), cut)))


def _split_camel(c: Column) -> Column:
    """A blank between ``aB``, ``1B`` and ``AB|Cd``, in one pass without back-tracking."""
    return F.regexp_replace(c, f"(?=[{UPPER}])(?:(?<=[{LOWER}])|(?<=[{UPPER}])(?=[A-Z][a-z]))", " ")


def clean_words(c: Column) -> Column:
    """Lower case, only ``[a-z0-9+ ]``, collapsed (no camel-case split)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{LOWER}+]+", " "))


def join_clean(*parts: Column) -> Column:
    """Of cleaned parts what :func:`clean_words` gives of the texts set side by side."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def clean_label(c: Column) -> Column:
    """As :func:`clean_words`, with camel case split first."""
    return clean_words(_split_camel(F.coalesce(c, F.lit(""))))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{LOWER}+]+", "")


# A dot inside or at the end of a dotted acronym such as "A.I.".
_ACRONYM_DOT = (
    r"(?<=(?<![A-Za-z])[A-Za-z])\.(?=(?:[A-Za-z]\.)+(?![A-Za-z]))"
    r"|(?<=(?<![A-Za-z])(?:[A-Za-z]\.){1,9}[A-Za-z])\.(?=(?:[A-Za-z]\.)*(?![A-Za-z]))"
)


def fold_term(c: Column) -> Column:
    """Fold a term or a text so that spelling variants of a term become equal."""

    def join_acronyms(text: Column) -> Column:
        # The look-behind is slow, so only texts that hold such an acronym pay for it.
        return F.when(text.rlike(r"[A-Za-z]\.[A-Za-z]\."), F.regexp_replace(text, _ACRONYM_DOT, "")).otherwise(text)

    text = let(_split_camel(F.coalesce(c, F.lit(""))), join_acronyms)
    text = F.replace(F.lower(text), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, f"[^{LOWER}+#]+", " "))


def compact_term(c: Column) -> Column:
    return F.regexp_replace(fold_term(c), r"[^a-z0-9+#]+", "")


def contains_clean(hay: Column, needle: Column) -> Column:
    """Phrase test on two sides that went through :func:`clean_words` already.

    Pass plain columns or lambda variables; the text is read more than once.
    """
    plus = F.concat(F.lit(r"(?U)\b"), F.replace(needle, F.lit("+"), F.lit(r"\+")), F.lit(r"\b"))
    as_word = F.when(F.instr(needle, "+") > 0, F.regexp_like(hay, plus)).otherwise(
        F.contains(F.concat(F.lit(" "), F.replace(hay, F.lit("+"), F.lit(" ")), F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))
    )
    tight_hay, tight_needle = F.replace(hay, F.lit(" "), F.lit("")), F.replace(needle, F.lit(" "), F.lit(""))
    multi = F.contains(hay, needle) | F.contains(tight_hay, tight_needle)
    single = as_word | ((F.length(needle) >= 8) & F.contains(tight_hay, needle))
    return F.when((hay == "") | (needle == ""), F.lit(False)).when(F.instr(needle, " ") > 0, multi).otherwise(single)


def contains_phrase(hay: Column, needle: Column) -> Column:
    """Cleaned phrase test: several words as text or glued, one word as a word or (8+ letters) glued."""
    return let(clean_words(hay), lambda h: let(clean_words(needle), lambda n: contains_clean(h, n)))


def token_set(c: Column, min_len: int = 2) -> Column:
    """Distinct lower-case tokens longer than ``min_len``."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), SPACE + "+"), lambda t: F.length(t) > min_len))


def important_terms(c: Column) -> Column:
    tokens = F.split(F.lower(normalize_ws(c)), f"[^{LOWER}+#.]+")
    return F.array_except(F.filter(tokens, lambda t: F.length(t) >= 3), lit_array(IMPORTANT_STOPWORDS))


def role_tokens(c: Column) -> Column:
    """Distinct words of a cleaned label that say something about the role."""
    tokens = F.filter(F.split(clean_label(c), " "), lambda t: F.length(t) > 2)
    return F.array_except(tokens, lit_array(ROLE_STOPWORDS + ROLE_GENERIC_TOKENS))


def dedupe_adjacent_words(c: Column) -> Column:
    def drop_repeats(arr: Column) -> Column:
        pairs = F.zip_with(arr, F.concat(F.array(F.lit("")), arr), lambda w, before: F.when(w != before, w))
        return F.array_join(F.array_compact(pairs), " ")

    return let(words(c), drop_repeats)


def slugify(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("role")).otherwise(slug)


def extract_contact(c: Column, links: Column | None = None) -> Column:
    """First e-mail, first phone, and at most four links that are not mail links."""
    cleaned = F.filter(F.transform(links, normalize_ws), lambda u: u != "") if links is not None else lit_array([])
    public = F.slice(F.filter(cleaned, lambda u: ~F.lower(u).startswith("mailto:")), 1, 4)
    # An address needs its sign; a number starts with a digit, behind a plus sign or one blank or hyphen if it has them.
    email = F.when(~F.contains(c, F.lit("@")), "").otherwise(F.regexp_extract(c, EMAIL, 0))
    return F.struct(
        email.alias("email"),
        F.regexp_extract(c, r"(?=[+0123456789]|[ \-][0123456789])" + PHONE, 0).alias("phone"),
        public.alias("links"),
    )


def extract_years(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))))


def after_first(pattern: str) -> str:
    """``pattern`` behind a look at the next character, if it is plain words between word boundaries: most places are passed at once."""
    words = pattern.removeprefix(r"\b").removesuffix(r"\b").removeprefix("(").removesuffix(")").split("|")
    if not all(re.fullmatch(r"[A-Za-z][A-Za-z &]*", w) for w in words):
        return pattern
    return f"(?=[{''.join(sorted({w[0] for w in words}))}]){pattern}"


def count_markers(c: Column, patterns: Mapping[str, str] = MARKERS) -> dict[str, Column]:
    """One count column per marker pattern."""
    return {name: F.regexp_count(c, F.lit("(?iU)" + after_first(pattern))).alias(f"{name}_markers") for name, pattern in patterns.items()}


def required_years(c: Column) -> Column:
    """First "N years" of a listing text; null if none is stated."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), REQUIRED_YEARS, 1), F.lit("")).cast("int")


def parse_partial_date(c: Column, as_of: Column) -> Column:
    """``Mon YYYY``, ``MM/YYYY``, ``YYYY`` or an open end to the first of that month."""
    token = F.lower(F.trim(c))
    month_name = F.regexp_extract(token, f"^({MONTH_NAME})" + r"\s+(\d{4})$", 1)
    month_year = F.regexp_extract(token, f"^({MONTH_NAME})" + r"\s+(\d{4})$", 2)
    month_no = F.array_position(lit_array(MONTHS), F.substring(month_name, 1, 3)).cast("int")
    num_month = F.regexp_extract(token, r"^(\d{1,2})/(\d{4})$", 1)
    num_year = F.regexp_extract(token, r"^(\d{1,2})/(\d{4})$", 2)

    def first_of(year: Column, month: Column) -> Column:
        # An impossible month or the year 0 gives null, not an error.
        return F.try_to_timestamp(F.format_string("%04d-%02d-01", year.cast("int"), month), F.lit("yyyy-MM-dd")).cast("date")

    return (
        F.when(token.isin(*OPEN_END), F.trunc(as_of, "month"))
        .when(month_name != "", first_of(month_year, month_no))
        .when((num_month != "") & num_month.cast("int").between(1, 12), first_of(num_year, num_month.cast("int")))
        .when(token.rlike(r"^(19|20)\d{2}$"), first_of(token, F.lit(1)))
    )


def urls(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(URL), F.lit(0)))


def audit_urls(c: Column) -> Column:
    """Points for unusual links: not a known profile site, and one more for export noise."""

    def points(u: Column) -> Column:
        unknown = ~F.contains(u, F.lit("linkedin")) & ~F.contains(u, F.lit("github"))
        return unknown.cast("int") + contains_any(u, NOISE_MARKERS).cast("int")

    return F.aggregate(F.transform(urls(c), F.lower), F.lit(0), lambda total, u: total + points(u))


def suspicious_tokens(c: Column) -> Column:
    """Distinct tokens with ``=`` or an export-noise marker."""
    return F.array_distinct(F.filter(words(c), lambda t: F.contains(t, F.lit("=")) | contains_any(F.lower(t), NOISE_MARKERS)))


def _links_of(all_urls: Column, domains: Sequence[str]) -> Column:
    return F.array_distinct(F.filter(F.transform(all_urls, F.lower), lambda u: contains_any(u, domains)))


def contact_links(all_urls: Column) -> Column:
    return _links_of(all_urls, CONTACT_DOMAINS)


def portfolio_links(all_urls: Column) -> Column:
    return _links_of(all_urls, PORTFOLIO_DOMAINS)


