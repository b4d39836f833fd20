"""Secret scans: fixed patterns, and sliding-window entropy per character class over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.llm.words import flat, slices, split

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NOTHING = re.compile(r"(?!)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")


def _not_in(characters: str) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(characters.encode())] = False
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_PLACEHOLDER = "(?:example|sample|dummy|placeholder)"
_RUNS = "|".join(run[:n] for run in (_LETTERS, _LETTERS.upper(), _DIGITS) for n in range(len(run), 9, -1))
#: Whole strings that look random and are none: those with a placeholder word grown into other letters or digits.
ALLOWED = (rf"(?i).*(?:(?<=[a-z0-9]){_PLACEHOLDER}|{_PLACEHOLDER}(?!s?(?![a-z0-9]))).*",)
#: Parts of strings that are none: UUIDs, runs of the alphabet or of digits, path segments with a placeholder as a word.
ALLOWED_PARTS = (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])", _RUNS, rf"(?i)[^/]*{_PLACEHOLDER}[^/]*")
_HEX = _not_in(_DIGITS + "abcdef")
_CANDIDATE = _not_in(_DIGITS + _LETTERS + _LETTERS.upper() + "+/_=-")
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS_LIST = _CLASS.tolist()


@dataclass(frozen=True)
class Entropy:
    """Window length, and the bits from which a window is suspect: of hex digits, and of at least two of a-z, A-Z, 0-9.

    Of the latter, windows of upper-case hex, of digits and letters of one case alone (base32, base36), and
    with a digit and three letters of each case (base62, base64) have bounds of their own; None is ``mixed_bits``.
    """

    window: int = 20
    hex_bits: float = 3.0
    mixed_bits: float = 4.0
    allowed: tuple[str, ...] = ALLOWED
    upper_hex_bits: float | None = None
    narrow_bits: float | None = None
    wide_bits: float | None = None
    allowed_parts: tuple[str, ...] = ALLOWED_PARTS


#: At most 1 % of random windows of 20 characters over 16, 32 and 62 symbols are below these bounds.
BY_CLASS = Entropy(upper_hex_bits=2.8, narrow_bits=3.25, wide_bits=3.6)


def suspect_windows(text: str, rule: Entropy) -> list[tuple[int, int]]:
    """Merged suspect windows of a candidate string. A step takes one character out of the counts and one in.

    Entropy is log2(w) - sum(c * log2(c)) / w over the counts c of a window of w characters.
    """
    w = rule.window
    data = text.encode("ascii")
    if len(data) < w:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    upper_hex, narrow, wide = (rule.mixed_bits if b is None else b for b in (rule.upper_hex_bits, rule.narrow_bits, rule.wide_bits))
    counts, classes, total, letters, capitals = [0] * 128, [0] * 4, 0.0, 0, 0
    found: list[list[int]] = []
    for i, c in enumerate(data):
        if i >= w:
            o = data[i - w]
            total += weight[counts[o] - 1] - weight[counts[o]]
            counts[o] -= 1
            classes[_CLASS_LIST[o]] -= 1
            letters -= 97 <= o <= 102
            capitals -= 65 <= o <= 70
        total += weight[counts[c] + 1] - weight[counts[c]]
        counts[c] += 1
        classes[_CLASS_LIST[c]] += 1
        letters += 97 <= c <= 102
        capitals += 65 <= c <= 70
        if i < w - 1:
            continue
        if classes[3] and letters and classes[3] + letters == w:
            least = rule.hex_bits
        elif classes[3] and capitals and classes[3] + capitals == w:
            least = upper_hex
        elif classes[3] and not classes[0] and (classes[1] > 0) != (classes[2] > 0):
            least = narrow
        elif classes[3] and classes[1] >= 3 and classes[2] >= 3:
            least = wide
        elif (classes[1] > 0) + (classes[2] > 0) + (classes[3] > 0) >= 2:
            least = rule.mixed_bits
        else:
            continue
        if math.log2(w) - total / w >= least - 1e-9:
            if found and i - w + 1 <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([i - w + 1, i + 1])
    return [(a, b) for a, b in found]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that any of the spans covers."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _has_new(start: int, end: int, known: list[tuple[int, int]], window: int) -> bool:
    """Whether some window of a run of suspect ones lies outside of the known spans for at least half its length."""
    if not known:
        return True
    free = np.ones(end - start, dtype=np.int64)
    for x, y in known:
        free[max(x - start, 0) : max(y - start, 0)] = 0
    sums = np.concatenate(([0], np.cumsum(free)))
    return bool((2 * (sums[window:] - sums[:-window]) >= window).any())


def scan_text(text: str, rule: Entropy, allowed: re.Pattern, parts: re.Pattern = NOTHING) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all secrets in a text."""
    out = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(2, *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    base = _merged(out)
    for m in CANDIDATE.finditer(text):
        if len(m[0]) >= rule.window and not allowed.fullmatch(m[0]):
            start, end = m.span()
            runs = [(a + start, b + start) for a, b in suspect_windows(m[0], rule)]
            if not runs:
                continue
            known = [(3, max(x, start), min(y, end)) for x, y in base if x < end and start < y]
            skipped = [(3, p.start() + start, p.end() + start) for p in parts.finditer(m[0]) if p.end() > p.start()]
            covered = _merged(known + skipped)
            if any(_has_new(a, b, covered, rule.window) for a, b in runs):
                edges = [start, *(e for span in covered for e in span), end]
                pieces = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                out += [(3, a, b) for a, b in pieces if not skipped or any(2 * (min(b, y) - max(a, x)) >= rule.window for x, y in runs)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _rows_to_scan(raw: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Rows that can hold a secret at all, by cheap signs: an assignment character, AKIA, a hex run, a mixed candidate."""
    at = [np.flatnonzero((raw == 58) | (raw == 61)), np.array([m.start() for m in re.finditer(b"AKIA", raw.tobytes())], dtype=np.int64)]
    starts, stops, _ = split(raw, ends, _HEX)
    at.append(starts[stops - starts >= 16])
    starts, stops, _ = split(raw, ends, _CANDIDATE)
    long = stops - starts >= window
    starts, stops = starts[long], stops[long]
    other = np.concatenate(([0], np.cumsum(_CLASS[raw] >= 2)))  # two classes are never both a-z
    at.append(starts[other[stops] > other[starts]])
    return np.unique(np.searchsorted(ends, np.concatenate(at), side="right") - 1)


def scan_secrets(docs: DataFrame, rule: Entropy = BY_CLASS, allowed: Sequence[str] = (), text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``secrets`` (kind, start, end in characters, end exclusive), by start and then kind, to every row.

    assign, access and hex are the fixed patterns, leftmost and not overlapping within a kind. entropy
    are whole candidate strings, less what a fixed pattern has found in them, with a window whose entropy is
    high for its character class and half of which is new: neither found by a fixed pattern nor allow-listed.
    The allow-list takes out whole strings (``rule.allowed`` patterns, ``allowed`` strings) and parts of strings
    (``rule.allowed_parts``): a key beside an allowed path segment is still found, without that segment.

    Nulls: a null text is an empty one and has no secrets. Long texts are read whole; work is linear in
    them. Repeated rows are scanned each; an empty table gives no rows. Other columns are passed on; one called
    ``secrets`` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != "secrets" and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    either = lambda patterns: [f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in patterns]
    listed = "|".join([*either(rule.allowed), *map(re.escape, allowed)]) or r"(?!)"
    listed_parts = "|".join(either(rule.allowed_parts)) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, parts = re.compile(listed), re.compile(listed_parts)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for a, b in slices(batch[text]):
                part = batch[text].slice(a, b - a)
                raw, ends = flat(part)
                for r in _rows_to_scan(raw, ends, rule.window).tolist():
                    found[a + r] = [{"kind": KINDS[k], "start": x, "end": y} for k, x, y in scan_text(part[r].as_py(), rule, pattern, parts)]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found, pa.list_(kind))], [*names, "secrets"])

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"secrets {SPANS}"]))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
