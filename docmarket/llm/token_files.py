"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docmarket.llm.words import LOWER, WHITESPACE, flat, slices, span_hashes, split

KNOWN = 150_000  # words a worker remembers at most; beyond it the ones not seen for longest go
_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b".,;:!?")] = True
# Bytes of the letters a-z, A-Z and U+00C0 to U+017F, which are composed and lower-cased one by one; the signs among these are taken out by pairs.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
_NO_LETTERS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]  # multiplication and division sign; I with a dot, which becomes two characters
# A byte-level model names a byte by its own character where that is printable, else by the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
FILE = "doc_id bigint, shard int, at bigint, ids array<int>"


class WordEncoder:
    """Encodes whole texts by their distinct white-space words.

    For a tokenizer that drops white space and never looks across it, a text's ids are those of its
    words in order. A piece of a word is encoded once and then found by its hash. A word of Latin letters without
    combining marks, with or without punctuation at its end, is one piece for the tokenizer's model and
    that punctuation another, so such words go straight to the model, as the characters that stand for
    their bytes. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.used, self.slice = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0  # sorted; slice in which a word was last seen
        self.starts, self.lengths, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids_of(self, pieces: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their numbers."""
        ids, rest, model = [], [], self.tokenizer.model
        for piece, letters in zip(pieces, plain):
            if letters:
                ids.append([t.id for t in model.tokenize(piece if piece.isascii() else piece.lower().encode().decode("latin-1").translate(BYTE_CHARS))])
            else:
                rest.append(len(ids))
                ids.append([])
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False)):
                ids[k] = e.ids
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), lengths

    def learn(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep words; if there are too many, half the room stays for those seen last."""
        starts = len(self.ids) + np.cumsum(lengths, dtype=np.int32) - lengths
        columns = [np.concatenate(x) for x in ((self.hashes, hashes), (self.used, np.full(len(hashes), self.slice, np.int32)), (self.starts, starts), (self.lengths, lengths))]
        self.ids = np.concatenate((self.ids, ids))
        if len(columns[0]) > KNOWN:
            keep = np.argsort(-columns[1], kind="stable")[: KNOWN // 2]
            columns = [c[keep] for c in columns]
            self.ids = self.ids[spread(columns[2], columns[3])]
            columns[2] = np.cumsum(columns[3], dtype=np.int32) - columns[3]
        order = np.argsort(columns[0])
        self.hashes, self.used, self.starts, self.lengths = (c[order] for c in columns)

    def encode(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and for every row how many come before it (rows + 1 numbers)."""
        raw, starts, stops, plain, rows = cut_pieces(*flat(column))
        code, distinct = pd.factorize(span_hashes(raw, starts, stops))
        self.slice += 1
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), dtype=bool)
        self.used[at[known]] = self.slice
        from_, lengths, ids = np.zeros(len(distinct), np.int32), np.zeros(len(distinct), np.int32), self.ids
        from_[known], lengths[known] = self.starts[at[known]], self.lengths[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.empty(len(distinct), dtype=np.int32)
            first[code[::-1]] = np.arange(len(code), dtype=np.int32)[::-1]
            data, first = raw.tobytes(), first[new]
            own, sizes = self.ids_of([data[a:b].decode() for a, b in zip(starts[first].tolist(), stops[first].tolist())], plain[first].tolist())
            from_[new], lengths[new] = len(ids) + np.cumsum(sizes, dtype=np.int32) - sizes, sizes
            ids = np.concatenate((ids, own))
            self.learn(distinct[new], own, sizes)
        lengths = lengths[code]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        ids, bounds = ids[spread(from_[code], lengths)], before[rows]
        if end is not None:
            ids, bounds = np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
        return ids, bounds


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches that start at ``starts``, one after the other."""
    before = np.cumsum(lengths, dtype=np.int32) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int32)


def cut_pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with plain words' ASCII letters in lower case, starts and ends of pieces, which are plain, and pieces before each row.

    A plain word is Latin letters and perhaps punctuation at its end, which is a piece of its own.
    """
    starts, stops, rows = split(raw, ends, WHITESPACE)
    last = np.maximum.accumulate(np.where(_TAIL[raw], -1, np.arange(len(raw))))
    cores = np.maximum(last[stops - 1] + 1, starts)
    odd = ~_LATIN[raw]
    for lead, follow in _NO_LETTERS:
        odd[1:] |= (raw[1:] == follow) & (raw[:-1] == lead)
    odds = np.concatenate(([0], np.cumsum(odd)))
    plain = (cores > starts) & (odds[cores] == odds[starts])
    cores = np.where(plain, cores, stops)
    change = np.zeros(len(raw) + 1, dtype=np.int8)
    change[starts[plain]] += 1
    change[cores[plain]] -= 1
    raw = np.where(np.cumsum(change[:-1], dtype=np.int8).astype(bool), LOWER[raw], raw)
    tailed = cores < stops
    before = np.concatenate(([0], np.cumsum(tailed)))
    number = np.arange(len(starts)) + before[:-1]
    size = len(starts) + int(before[-1])
    from_, to, letters = np.empty(size, np.int64), np.empty(size, np.int64), np.zeros(size, dtype=bool)
    from_[number], to[number], letters[number] = starts, cores, plain
    after = number[tailed] + 1
    from_[after], to[after] = cores[tailed], stops[tailed]
    return raw, from_, to, letters, rows + before[rows]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One per worker; what it remembers serves the worker's later tasks too."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, shards: int | None = None, stripe_bytes: int = 16 << 20, id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write ids as ORC in ascending order of ``id``: doc_id, shard, at, ids.

    Shards are ranges of ids, one file each; ``at`` counts the ids of a shard's earlier documents, so a
    document's place in the whole is its shard's start plus ``at``. Ids are written by integer run-length
    encoding in stripes with row indexes; doc_id has a Bloom filter, so that readers skip by metadata.

    Nulls: a null text is an empty one and gets the end id alone; a null id is the smallest. Rows with one
    id are in order of their text's hash, whole repeats in any order. An empty table gives no rows.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for a, b in slices(batch["text"]):
                ids, bounds = encoder(tokenizer).encode(batch["text"].slice(a, b - a), end)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["shard"].slice(a, b - a), pa.array(at + bounds[:-1], pa.int64()), lists], ["doc_id", "shard", "at", "ids"])
                at += int(bounds[-1])

    kind = docs.schema[id].dataType.simpleString()
    out = rows.withColumn("shard", F.spark_partition_id()).mapInArrow(run, FILE.replace("doc_id bigint", f"doc_id {kind}"))
    out.write.mode("overwrite").options(**{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000", "compression": "zstd"}).orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list | None = None) -> DataFrame:
    """Rows of the files, stripe by stripe in parallel; with ``doc_ids`` only stripes and row groups that may hold them are read."""
    rows = spark.read.orc(folder)
    return rows.filter(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else rows


def token_report(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    rows = read_tokens(spark, folder)
    sizes = rows.groupBy("shard").agg(F.max(F.col("at") + F.size("ids")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", before.alias("before"))  # one row per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            ids = np.asarray(lists.values).astype("<u4")
            bounds = np.asarray(lists.offsets)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["shard"], batch["at"], pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return out.join(starts, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
