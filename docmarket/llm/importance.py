"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.llm.mixing import STEP, thresholds
from docmarket.llm.words import LOWER, NOT_ALNUM, WHITESPACE, flat, mix, slices, span_hashes, split
from docmarket.session import cut_lineage

WORD_BITS, SHAPE_BITS = 18, 14
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
NO_FAMILY = np.uint64(2**64 - 1)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: hash of every word, its bucket pair (word; bigram of word shapes), and the words before each row.

    A word is cut after its last letter or digit and compared without case. Its shape is its case, the
    first sign after that cut, how many signs follow, and whether it repeats the word before it.
    """
    raw, ends = flat(column)
    starts, stops, rows = split(raw, ends, WHITESPACE)
    low = LOWER[raw]
    last = np.maximum.accumulate(np.where(NOT_ALNUM[low], -1, np.arange(len(raw))))
    cores = np.maximum(last[stops - 1] + 1, starts)
    words = span_hashes(low, starts, cores)
    upper, lower = (np.concatenate(([0], np.cumsum((raw >= a) & (raw <= a + 25)))) for a in (65, 97))
    n_upper, n_lower = upper[stops] - upper[starts], lower[stops] - lower[starts]
    case = np.where(n_upper == 0, 0, np.where(n_lower > 0, 1, np.where(n_upper > 1, 3, 2)))
    sign = np.where(cores < stops, raw[np.minimum(cores, max(len(raw) - 1, 0))], 0) if len(raw) else cores
    first = rows[:-1][rows[:-1] < len(words)]
    same = np.concatenate(([False], words[1:] == words[:-1])) if len(words) else np.zeros(0, bool)
    same[first] = False
    shape = (case + 4 * np.minimum(stops - cores, 4) + 32 * sign + 8192 * same).astype(np.uint64)
    before = np.concatenate(([0], shape[:-1])).astype(np.uint64) if len(shape) else shape
    before[first] = 1 << 20
    pair = mix(shape * np.uint64(2654435761) + before * np.uint64(0x9E3779B97F4A7C15))
    buckets = np.stack(((words >> np.uint64(64 - WORD_BITS)).astype(np.int64), (pair >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)), axis=1)
    return words, buckets, rows


@dataclass(frozen=True)
class Model:
    """log p(n-gram | low quality) - log p(n-gram | raw) by bucket, and the same for the words that mark toxic text."""

    low: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    toxic_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def weigh(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Both log weights of every row: sums over all its n-grams."""
        words, buckets, rows = ngrams(column)
        sums = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[rows])
        return sums(self.low[buckets].sum(axis=1)), sums(self.lookup(words))

    def lookup(self, words: np.ndarray) -> np.ndarray:
        if not len(self.toxic_words):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.toxic_words, words), len(self.toxic_words) - 1)
        return np.where(self.toxic_words[at] == words, self.toxic[at], 0.0)


def label_sample(labels: DataFrame, most: int, id: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids, by hash: id, low, toxic. Of several labels the worse one counts."""
    rows = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("__id")).agg((F.min("quality") == 0).alias("__low"), (F.max("toxic") == 1).alias("__toxic"))
    rows = rows.select("__id", F.coalesce("__low", F.lit(False)).alias("__low"), F.coalesce("__toxic", F.lit(False)).alias("__toxic"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(most)


def toxic_words(labelled: DataFrame, least: float, pure: float, most: int = 4096) -> DataFrame:
    """Words that mark toxic text in the labelled sample.

    Copies must not count as evidence, so a word is counted once per family of texts: texts with one
    smallest word hash. evidence is how much likelier a of b toxic families are than by chance, in nats;
    it must be at least ``least``, and the toxic share a / b at least ``pure``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                words, _, rows = ngrams(batch["text"].slice(a, b - a))
                toxic = np.asarray(batch["__toxic"].slice(a, b - a))
                for r in np.flatnonzero(np.diff(rows)).tolist():
                    own = np.unique(words[rows[r] : rows[r + 1]])
                    family = int(mix(own ^ np.uint64(0x5bd1e995)).min().astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(np.full(len(own), family)), pa.array(np.full(len(own), toxic[r]))], ["word", "family", "toxic"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += len(batch)
            if n >= 100_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    pairs = labelled.select("text", "__toxic").mapInArrow(joined, "word bigint, family bigint, toxic boolean")
    pairs = pairs.groupBy("word", "family").agg(F.max("toxic").alias("toxic"))
    counts = pairs.groupBy("word").agg(F.count_if("toxic").alias("a"), F.count(F.lit(1)).alias("b"))
    families = pairs.groupBy("family").agg(F.max("toxic").alias("toxic")).agg(F.avg(F.col("toxic").cast("double")).alias("p"))
    share = F.col("a") / F.col("b")
    tail = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) * F.log((1 - share) / (1 - F.col("p")))).otherwise(0.0)
    scored = counts.filter("a >= 3").join(F.broadcast(families), F.lit(True)).withColumn("evidence", F.col("a") * F.log(share / F.col("p")) + tail)  # families: one row
    return scored.filter((share >= pure) & (share > F.col("p")) & (F.col("evidence") >= least)).orderBy(F.desc("evidence"), "word").limit(most).select("word")


def count_ngrams(docs: DataFrame, words: np.ndarray, text: str) -> DataFrame:
    """Counts over all of ``docs`` (text, __low, __toxic): bucket, n, low, toxic. Buckets from BUCKETS on are ``words``.

    A task counts in arrays of fixed size and gives its buckets with a count once, at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BUCKETS + len(words)
        counts = np.zeros((3, size), dtype=np.int64)
        for batch in batches:
            for a, b in slices(batch[text]):
                hashes, buckets, rows = ngrams(batch[text].slice(a, b - a))
                kinds = [np.asarray(batch[c].slice(a, b - a).fill_null(False)) for c in ("__low", "__toxic")]
                row = np.repeat(np.arange(b - a), np.diff(rows))
                at = np.searchsorted(words, hashes)
                known = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == hashes) if len(words) else np.zeros(0, np.int64)
                for k, mask in enumerate((None, *kinds)):
                    own = buckets if mask is None else buckets[mask[row]]
                    counts[k] += np.bincount(own.ravel(), minlength=size)
                    some = known if mask is None else known[mask[row[known]]]
                    counts[k] += np.bincount(at[some] + BUCKETS, minlength=size)
        there = np.flatnonzero(counts[0])
        for k in range(0, len(there), 65536):
            some = there[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c[some], pa.int64()) for c in counts)], ["bucket", "n", "low", "toxic"])

    parts = docs.select(text, "__low", "__toxic").mapInArrow(run, "bucket int, n bigint, low bigint, toxic bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, smoothing: float = 4.0, evidence: float = 16.0, pure: float = 0.9, id: str = "doc_id", text: str = "text") -> Model:
    """Both models. Raw counts cover every text; the targets are the labelled documents of ``label_sample``.

    An n-gram's weight is log((c + s) / (e + s)): c its count in the target, e what the raw share of
    the n-gram gives for a target of that length. The sample (at most ``sample`` small rows) is broadcast;
    the model that comes back has a fixed number of buckets.
    """
    few = F.broadcast(label_sample(labels, sample, "doc_id"))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    labelled = rows.join(few, F.col("id") == F.col("__id")).select("text", "__toxic")
    words = np.sort(np.array([r["word"] for r in toxic_words(labelled, evidence, pure).collect()], dtype=np.int64).astype(np.uint64))
    counted = count_ngrams(rows.join(few, F.col("id") == F.col("__id"), "left"), words, "text").toArrow()  # at most BUCKETS + 4096 rows
    size = BUCKETS + len(words)
    n, low, toxic = (np.zeros(size) for _ in range(3))
    at = np.asarray(counted["bucket"])
    for out, name in ((n, "n"), (low, "low"), (toxic, "toxic")):
        out[at] = np.asarray(counted[name])
    share = low[:BUCKETS].sum() / max(n[:BUCKETS].sum(), 1.0)
    weights = np.log((low[:BUCKETS] + smoothing) / (n[:BUCKETS] * share + smoothing)) if share else np.zeros(BUCKETS)
    share = toxic[:BUCKETS].sum() / max(n[:BUCKETS].sum(), 1.0)
    marks = np.log((toxic[BUCKETS:] + 1.0) / (n[BUCKETS:] * share + 1.0)) if share else np.zeros(len(words))
    return Model(weights, words, np.maximum(marks, 0.0))


def weigh(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add __low and __toxic, the log weights of every whole text, to the rows of ``docs``."""
    kept = [f for f in docs.schema.fields if f.name not in ("__low", "__toxic") and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.weigh(batch[text].slice(a, b - a)) for a, b in slices(batch[text])]
            low, toxic = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(low), pa.array(toxic)], [*names, "__low", "__toxic"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "__low double", "__toxic double"]))


def gumbel_key(id: Column, margin: float, temperature: float) -> Column:
    """36-bit key, smaller is better: -(log weight / temperature + Gumbel noise), quantised between -64 and 64.

    The log weight of being kept is how far the worse of the two weights stays below ``margin`` nats.
    The noise comes from a hash of the id, so reruns agree.
    """
    log_weight = F.lit(margin) - F.greatest("__low", "__toxic")
    uniform = (F.shiftrightunsigned(F.xxhash64(id, F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    key = -(log_weight / temperature - F.log(-F.log(uniform)))
    bits = STEP * 3
    return F.least(F.greatest(((key + 64.0) / 128.0 * float(1 << bits)).cast("long"), F.lit(0)), F.lit((1 << bits) - 1))


@dataclass(frozen=True)
class Classifier:
    model: Model
    margin: float
    temperature: float
    threshold: int


def train_classifier(docs: DataFrame, labels: DataFrame, margin: float = 1.0, temperature: float = 0.05, sample: int = 20_000, id: str = "doc_id", text: str = "text") -> Classifier:
    """Fit the models and find the key of the k-th best document, k being the documents whose log weight is positive.

    Keys are counted in histograms, the boundary bucket twice more and finer, so nothing is sorted.
    """
    model = fit(docs, labels, sample, id=id, text=text)
    scored = weigh(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), model)
    rows = cut_lineage(scored.select(F.lit(0).alias("sid"), F.lit(1).cast("long").alias("size"), gumbel_key(F.col("id"), margin, temperature).alias("key"), (F.greatest("__low", "__toxic") < margin).alias("good")))
    k = rows.agg(F.count_if("good")).first()[0]
    budget = rows.sparkSession.range(1).select(F.lit(0).alias("sid"), F.lit(float(k)).alias("budget"))
    found = thresholds(rows.select("sid", "size", "key"), budget).first()
    return Classifier(model, margin, temperature, found["threshold"] if found else 0)


def classify(docs: DataFrame, classifier: Classifier, id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add __low, __toxic (log weights towards low quality and toxic text) and __kept to every row.

    A document is kept if it is among the k best by log weight and Gumbel noise: importance resampling
    without replacement. At the low default temperature noise decides only within about a tenth of a nat
    of the margin; at 1 it samples by the weights themselves.

    Nulls: a null text has no n-gram, both weights 0, and is kept like an empty one; a null id has no
    label. Rows with one id share their noise; repeated rows are judged each. Without labels all rows are
    kept. Empty tables give no rows. Long texts are weighed whole. Other columns are passed on; those called
    ``__low``, ``__toxic`` or ``__kept`` are replaced.
    """
    out = weigh(docs, classifier.model, text, keep_text)
    return out.withColumn("__kept", gumbel_key(F.col(id), classifier.margin, classifier.temperature) < classifier.threshold)
