"""Fill-in-the-middle rewriting of whole texts, cut on UTF-8 bytes with a sparse index of multibyte characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.llm.columns import pick
from docmarket.llm.words import flat, slices

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
FIM = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class ExceptionIndex:
    """Places of the multibyte characters of a stretch of UTF-8 and the bytes they have beyond one.

    All other characters are one byte long, so a place in characters and a place in bytes differ by the
    excess bytes before it: one search in the short list of exceptions converts either into the other.
    """

    def __init__(self, raw: np.ndarray):
        self.bytes_at = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.bytes_at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(excess)))
        self.chars_at = self.bytes_at - self.before[:-1]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Characters before byte places, which are between characters."""
        return at - self.before[np.searchsorted(self.bytes_at, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before character places."""
        return at + self.before[np.searchsorted(self.chars_at, at)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuse sentinels that could be read in two ways: an end of one that begins another, or one within another."""
    for i, a in enumerate(sentinels):
        if not a:
            raise ValueError("a sentinel is empty")
        for k, b in enumerate(sentinels):
            inside = i != k and a in b
            if inside or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b) - (i == k)) + (i != k))):
                raise ValueError(f"sentinels {a} and {b} overlap")


def cut_slice(texts: pa.Array, hashes: np.ndarray, unit: str, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple:
    """Units, forms, characters of prefix and middle (-1 where plain), and rewritten texts of a slice of rows."""
    raw, ends = flat(texts)
    index = ExceptionIndex(raw)
    start, stop = ends[:-1], ends[1:]
    if unit == "line":
        breaks = np.flatnonzero(raw == 10)
        first = np.searchsorted(breaks, start)
        full = np.searchsorted(breaks, stop) - first
        last = raw[np.maximum(stop - 1, 0)] if len(raw) else np.zeros(len(start), np.uint8)
        n = full + ((stop > start) & (last != 10))
        # A cut after no unit is the start, after the last one the end, else just behind a line feed.
        place = lambda k: np.where(k <= 0, start, np.where(k > full, stop, np.append(breaks + 1, 0)[np.minimum(first + k - 1, len(breaks))]))
    else:
        base = index.to_chars(start)
        n = index.to_chars(stop) - base
        place = lambda k: index.to_bytes(base + k)
    one, two = hashes[0] % (n + 1), hashes[1] % (n + 1)
    a, b = place(np.minimum(one, two)), place(np.maximum(one, two))
    plain = (stop == start) | (hashes[2] % 100 >= rate)
    data = raw.tobytes()
    for found in re.finditer(b"|".join(re.escape(s.encode()) for s in sentinels), data):
        row = int(np.searchsorted(ends, found.start(), side="right")) - 1
        plain[row] |= found.end() <= ends[row + 1]
    spm = ~plain & (hashes[3] % 100 < spm_rate)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    chars_a = index.to_chars(a)
    prefix, middle = np.where(plain, -1, chars_a - index.to_chars(start)), np.where(plain, -1, index.to_chars(b) - chars_a)
    p, s, m = (x.encode() for x in sentinels)
    pieces = []
    for from_, x, y, to, kind in zip(start.tolist(), a.tolist(), b.tolist(), stop.tolist(), form.tolist()):
        if kind == "plain":
            pieces.append(data[from_:to])
        elif kind == "spm":
            pieces.append(b"".join((s, data[y:to], p, data[from_:x], m, data[x:y])))
        else:
            pieces.append(b"".join((p, data[from_:x], s, data[y:to], m, data[x:y])))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    output = pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(pieces))])
    return n, form, prefix, middle, output.cast(pa.string())


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every text cut in three at two places between units and put in prefix-suffix-middle or suffix-prefix-middle order.

    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain),
    output (the whole rewritten text), and ``kept``, a struct of the columns named in ``keep``. A unit is a
    ``line`` with its line feed or a ``char``. Cuts and form follow from the sha256 of seed and id alone, so
    reruns and repeated rows agree. ``rate`` and ``spm_rate`` are percentages. ``restored`` undoes it.

    Nulls: a null text is an empty one; a null id hashes like an empty string. An empty text, or one that
    holds a sentinel, stays as it is (plain). Very long texts are cut whole: work and memory are a few times
    the bytes of one text, or of 2 MB of shorter ones. Nothing is shuffled, so equal ids or texts do not
    meet. An empty table gives no rows. Columns are found by exact name (of repeated names the first);
    other columns, whatever their names, neither take part nor come back unless ``keep`` names them.
    """
    check_sentinels(sentinels)
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit {unit}")
    rows = pick(docs, doc_id=id, text=text, **{f"k{i}": name for i, name in enumerate(keep)})
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(4)]
    kept = [f"k{i}" for i in range(len(keep))]
    rows = rows.select("doc_id", *kept, "text", *hashes)
    whole = ["doc_id", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for from_, to in slices(batch["text"]):
                part = batch.slice(from_, to - from_)
                n, form, prefix, middle, output = cut_slice(part["text"], [np.asarray(part[f"h{i}"]) for i in range(4)], unit, rate, spm_rate, sentinels)
                numbers = [pa.array(x, pa.int64(), mask=x < 0) for x in (prefix, middle)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in whole], pa.array(n, pa.int64()), pa.array(form, pa.string()), *numbers, output], [*whole, "n", "form", "prefix_chars", "middle_chars", "output"])

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in whole)
    out = rows.mapInArrow(run, f"{fields}, {FIM}")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return out.select(*columns, *([F.struct(*[F.col(k).alias(name) for k, name in zip(kept, keep)]).alias("kept")] if keep else []))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` was given (empty for null), from its output and form alone."""
    # No sentinel occurs in a rewritten text and none can overlap another, so the three are found exactly once.
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
