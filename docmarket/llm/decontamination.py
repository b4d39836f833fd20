"""Benchmark decontamination: an FM-index per training shard, searched for the windows of test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.llm.fm_index import FmIndex
from docmarket.llm.words import NOT_ALNUM, flat, slices, split, word_hashes, window_hashes

BLOCK_BYTES = 16 << 20  # of benchmark text that go to the tasks at once
SHARD_BYTES = 2 << 20  # of document text under one index
STATE = "n_words bigint, spans array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"


class Phrases:
    """Windows of a block of test items as rows of symbols; a symbol is the rank of a word's hash."""

    def __init__(self, ids: list[str], texts: list[str | None], size: int):
        words, rows = word_hashes(pa.array(texts, pa.string()), NOT_ALNUM)
        self.ids = ids
        self.vocabulary = np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words) + 1
        hashes, out_rows = window_hashes(words, rows, size)
        row = np.repeat(np.arange(len(ids)), np.diff(out_rows))
        first = np.arange(len(hashes)) - out_rows[row] + rows[row]
        length = np.minimum(np.diff(rows)[row], size)
        self.groups = []  # patterns of one length, each with the items it comes from
        for n in np.unique(length).tolist():
            at = length == n
            patterns, inverse = np.unique(symbols[first[at][:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack((inverse.ravel(), row[at]), axis=1), axis=0)
            self.groups.append((n, patterns, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1))))
        self.shortest = self.groups[0][0] if self.groups else 0
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for those in no test item."""
        out = np.zeros(len(words), dtype=np.int64)
        maybe = np.flatnonzero(self.known[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), max(len(self.vocabulary) - 1, 0))
        hit = self.vocabulary[at] == words[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


def find(phrases: Phrases, words: np.ndarray, rows: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard: first word, length, item number.

    Words of no item can be in no window, so they are separators: the index holds only the stretches
    of item words within a row that are long enough for the shortest window.
    """
    none = np.zeros(0, dtype=np.int64)
    symbols = phrases.symbols(words)
    inside = symbols > 0
    cut = np.zeros(len(words) + 1, dtype=bool)
    cut[rows] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | cut[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | cut[1:])) + 1
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none
    sizes = ends - starts + 1  # with a separator after each stretch
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    origin = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    text = np.where(np.arange(offsets[-1]) + 1 == np.repeat(offsets[1:], sizes), 0, symbols[np.minimum(origin, len(words) - 1)])
    index = FmIndex(text, len(phrases.vocabulary), sample)
    found = []
    for n, patterns, items, item_rows in phrases.groups:
        low, high = index.search(patterns)
        hit = np.flatnonzero(low < high)
        times = high[hit] - low[hit]
        row = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
        first, pattern = origin[index.locate(row)], np.repeat(hit, times)
        per = item_rows[pattern + 1] - item_rows[pattern]
        item = items[np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(item_rows[pattern], per)]
        first = np.repeat(first, per)
        found.append((first, np.full(len(first), n), item))
    return tuple(np.concatenate(x) for x in zip(*found))


def search_batch(batch: pa.RecordBatch, phrases: Phrases, text: str, sample: int, first_block: bool = True) -> pa.RecordBatch:
    """One batch with n_words, spans and items, joined with those of earlier blocks after the first."""
    column, parts = batch[text], []
    earlier = None if first_block else batch["spans"].to_pylist()
    earlier_items = batch["items"].to_pylist() if earlier is not None else None
    counts, spans, items = [], [None] * len(batch), [None] * len(batch)
    for a, b in slices(column, SHARD_BYTES):
        part = column.slice(a, b - a)
        words, rows = word_hashes(part, NOT_ALNUM)
        counts.append(np.diff(rows))
        first, length, item = find(phrases, words, rows, sample)
        if not len(first):
            continue
        raw, ends = flat(part)
        lower = raw.copy()
        lower[(raw >= 65) & (raw <= 90)] += 32
        word_start, word_end, _ = split(lower, ends, NOT_ALNUM)
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        row = np.searchsorted(rows, first, side="right") - 1
        for r in np.unique(row).tolist():
            own = row == r
            edges = sorted(zip(first[own].tolist(), (first[own] + length[own]).tolist()))
            merged = [list(edges[0])]
            for x, y in edges[1:]:
                if x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            base, chars = int(rows[r]), int(points[ends[r]])
            spans[a + r] = [{"first": x - base, "last": y - base, "start": int(points[word_start[x]]) - chars, "end": int(points[word_end[y - 1]]) - chars} for x, y in merged]
            items[a + r] = sorted({phrases.ids[i] for i in np.unique(item[own]).tolist()})
    if earlier is not None:
        for i, old in enumerate(earlier):
            if old:
                spans[i], items[i] = merge_spans(old + (spans[i] or [])), sorted({*(earlier_items[i] or []), *(items[i] or [])})
    out = {name: batch[name] for name in batch.schema.names if name not in ("n_words", "spans", "items")}
    point = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    out["n_words"] = pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64())
    out["spans"] = pa.array([s or [] for s in spans], pa.list_(point))
    out["items"] = pa.array([x or [] for x in items], pa.list_(pa.string()))
    return pa.RecordBatch.from_pydict(out)


def merge_spans(spans: list[dict]) -> list[dict]:
    """Join spans that overlap or touch."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": s["last"], "end": s["end"]}
        else:
            out.append(dict(s))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, sample: int = 16, block_bytes: int = BLOCK_BYTES, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add n_words, spans and items to the rows of ``docs``: what of ``benchmark`` occurs in each whole text.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window.
    spans are merged removal spans (first and last word, start and end character, ends exclusive),
    items the ids of the items with an occurring window, as sorted strings.

    Every task indexes its documents in shards of bounded size and searches all windows in each, so
    nothing of the corpus is shuffled. Items go to the tasks in blocks of ``block_bytes``: a larger
    benchmark takes one more pass for each block.

    Nulls: a null text has no words; an item with a null text has no window; a null item id is written
    as an empty string. Items that share an id count once. Repeated rows are searched each. An empty
    table gives no rows, an empty benchmark no spans. Columns of ``docs`` called n_words, spans or items give
    way to the results; all others are passed on.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        phrases = Phrases([r["id"] for r in rows], [r["text"] for r in rows], window)
        kept = [f for f in out.schema.fields if f.name not in ("n_words", "spans", "items")]
        last = block == blocks - 1
        names = [f.name for f in kept if keep_text or not last or f.name != text]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name in names] + [STATE])

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, names=names, first_block=block == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield search_batch(batch, phrases, text, sample, first_block).select([*names, "n_words", "spans", "items"])

        out = out.mapInArrow(run, schema)
    return out


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def cut_spans(text: str = "text") -> Column:
    """The text without its removal spans."""
    state = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    step = lambda s, x: F.struct(F.concat(s["kept"], F.substring(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("kept"), x["end"].alias("at"))
    rest = lambda s: F.concat(s["kept"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size("spans") == 0, F.col(text)).otherwise(F.aggregate("spans", state, step, rest))
