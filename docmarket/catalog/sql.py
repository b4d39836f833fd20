"""SQL fragments shared by the DuckDB twins."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rnd(expr: str, places: int = 2) -> str:
    """Half-up rounding of the shortest decimal reading of a double, as Spark rounds."""
    return f"CAST(round(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), {places}) AS DOUBLE)"


def ws(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), {q(SPACE + '+')}, ' ', 'g'))"


def clean_words(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9+ ]+', ' ', 'g'), ' +', ' ', 'g'))"


def camel(expr: str) -> str:
    return (
        f"regexp_replace(regexp_replace(coalesce({expr}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    )


def clean_label(expr: str) -> str:
    return clean_words(camel(expr))


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(SPACE + '+')}), lambda w: w <> '')"


def ascii_words(expr: str) -> str:
    """Letters outside ASCII as ``x``: makes RE2 word boundaries agree with Unicode-aware ones."""
    return f"regexp_replace({expr}, '[^\\x00-\\x7f]', 'x', 'g')"


def unicode_words(expr: str) -> str:
    """As :func:`ascii_words`, for patterns that name single letters: outside ASCII a letter becomes ``_``, a digit ``0``, white space a blank, the rest ``~``.

    The Kelvin sign and the long s, which are a ``k`` and an ``s`` without case, become those letters.
    """
    steps = [(r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", " "), (r"\x{212a}", "k"), (r"\x{17f}", "s"), (r"[^\x00-\x7f\P{Nd}]", "0")]
    steps += [(rf"[^\x00-\x7f\P{{{kind}}}]", "_") for kind in ("L", "M", "Nl", "Pc")]
    steps += [(r"[\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}\x{200c}\x{200d}]", "_"), (r"[^\x00-\x7f]", "~")]
    for pattern, char in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(char)}, 'g')"
    return expr


def in_list(values) -> str:
    return "(" + ", ".join(q(str(v)) for v in values) + ")"


def str_list(values) -> str:
    return "[" + ", ".join(q(str(v)) for v in values) + "]"


def values(columns, rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else q(str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(columns)}))"
