"""Exact top-k by inner product: long vectors first, rotated partial sums, Cauchy-Schwarz bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from docmarket.llm.columns import pick
from docmarket.llm.vectors import exact_float, usable, whole_numbers
from docmarket.operators.ranking import top_per_group
from docmarket.session import cut_lineage

BLOCK_ROWS = 2048  # candidates scored at once
BLOCK_QUERIES = 512  # queries scored at once
HEAD_ROWS = 4096  # about so many of the longest vectors give the first bounds
NO_ID = np.iinfo(np.int64).max


def measured(vectors: DataFrame) -> DataFrame:
    """id, width, length2 (squared length) and the whole numbers as bytes, of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, numbers in whole_numbers(batch["vector"]):
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * numbers.shape[1] * 4).astype(np.int32).tobytes()), pa.py_buffer(numbers.astype("<i4").tobytes())])
                square = (numbers.astype(np.float64) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), pa.array(np.full(len(rows), numbers.shape[1], np.int32)), pa.array(square), data], ["id", "width", "length2", "numbers"])

    return vectors.filter(usable(F.col("vector"))).mapInArrow(run, "id bigint, width int, length2 double, numbers binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole numbers of rows of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), width)


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows of one width, in order."""
    widths = np.asarray(batch["width"])
    cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(widths[a]), batch.slice(a, b - a)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per width, the singular directions of all vectors, strongest first, as columns of an orthogonal matrix.

    The products of all pairs of components are summed by the tasks; what comes to the driver has the square of the width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, part in by_width(batch):
                numbers = matrix(part["numbers"], width).astype(np.float64)
                sums[width] = sums.get(width, 0) + numbers.T @ numbers
        for width, total in sums.items():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["width", "i", "j", "x"])

    sums = rows.mapInArrow(run, "width int, i int, j int, x double").groupBy("width", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    width, i, j, x = (np.asarray(sums[c]) for c in ("width", "i", "j", "x"))
    out = {}
    for w in np.unique(width).tolist():
        gram, of = np.zeros((w, w)), width == w
        gram[i[of], j[of]] = x[of]
        gram[j[of], i[of]] = x[of]
        out[w] = np.linalg.eigh(gram)[1][:, ::-1].copy()
    return out


class Queries:
    """Queries of one width with the best scores found so far."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.width = ids, k, numbers.shape[1]
        self.numbers, self.rotation = numbers, rotation
        self.real = numbers.astype(np.float64)
        self.largest = int(np.abs(numbers).max(initial=0))
        self.rotated = self.real @ rotation
        self.length = np.sqrt((self.real**2).sum(1))
        self.levels = sorted({h for h in (self.width // 8, self.width // 4, self.width // 2) if h >= 4})
        self.rest = [np.sqrt((self.rotated[:, h:] ** 2).sum(1)) for h in self.levels]
        self.floor = floor  # a score below it is among no query's best
        self.scores = np.zeros((len(ids), k), np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros((len(ids), k), dtype=bool)
        self.exact = 0  # pairs whose inner product was computed whole

    def bounds(self) -> np.ndarray:
        """Score a candidate must reach (ties may still win by their id)."""
        return np.where(self.filled[:, -1], np.maximum(self.scores[:, -1], self.floor), self.floor)

    def take(self, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Hold a block of candidates, in descending length, against all queries."""
        real = numbers.astype(np.float64)
        length = np.sqrt((real**2).sum(1))
        longest = length.max(initial=0.0)
        slack = 1e-9 * self.length * longest + 1e-6
        alive = np.flatnonzero(self.length * longest >= self.bounds() - slack)
        if not len(alive):
            return
        exact_doubles = exact_float(self.largest, int(np.abs(numbers).max(initial=0)), self.width)
        rotated = real @ self.rotation
        rests = [np.sqrt((rotated[:, h:] ** 2).sum(1)) for h in self.levels]
        for a in range(0, len(alive), BLOCK_QUERIES):
            q = alive[a : a + BLOCK_QUERIES]
            bound = self.bounds()[q] - slack[q]
            # No vector shorter than this can reach the bound of any query of this block.
            need = np.divide(bound, self.length[q], out=np.full(len(q), -np.inf), where=self.length[q] > 1e-6).min()
            few = int(np.searchsorted(-length, -need, side="right")) if need > 0 else len(length)
            keep, partial, at = None, np.zeros((len(q), few)), 0
            for h, own, other in zip(self.levels, self.rest, rests):
                partial += self.rotated[q, at:h] @ rotated[:few, at:h].T
                at = h
                keep = partial + own[q][:, None] * other[None, :few] >= bound[:, None]
                if keep.sum() < 0.05 * keep.size:
                    break
            i, j = np.nonzero(keep) if keep is not None else (np.zeros(0, np.int64),) * 2
            if keep is None or len(i) >= 0.05 * keep.size:  # the whole product is cheaper than picking pairs
                self.exact += len(q) * few
                left, right = (self.real[q], real[:few]) if exact_doubles else (self.numbers[q], numbers[:few])
                whole = left @ right.T
                keep = whole >= self.bounds()[q][:, None]
                keep &= ids[None, :few] != self.ids[q][:, None]
                if few > self.k:  # all that tie with a query's k-th stay
                    own = np.where(keep, whole, -np.inf) if exact_doubles else np.where(keep, whole, np.iinfo(np.int64).min)
                    keep &= whole >= np.partition(own, few - self.k, axis=1)[:, few - self.k][:, None]
                i, j = np.nonzero(keep)
                score = whole[i, j].astype(np.int64)
            else:
                self.exact += len(i)
                other = ids[j] != self.ids[q[i]]
                i, j = i[other], j[other]
                score = self.products(q[i], numbers, j)
                enough = score >= self.bounds()[q[i]]
                i, j, score = i[enough], j[enough], score[enough]
            if len(i):
                self.merge(q[i], ids[j], score)

    def products(self, query: np.ndarray, numbers: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Inner products of pairs, a few megabytes at a time."""
        step = max(1, (1 << 20) // max(self.width, 1))
        parts = [np.einsum("ij,ij->i", self.numbers[query[a : a + step]], numbers[j[a : a + step]]) for a in range(0, len(query), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Put found pairs among the best; of equal scores the smaller id comes first."""
        q = np.unique(query)
        old = self.filled[q]
        query = np.concatenate((query, np.repeat(q, old.sum(1))))
        score, ids = np.concatenate((score, self.scores[q][old])), np.concatenate((ids, self.found[q][old]))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        new = np.concatenate(([True], query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        first = rank < self.k
        query, rank = query[first], rank[first]
        self.scores[query, rank], self.found[query, rank], self.filled[query, rank] = score[first], ids[first], True


def best_of(rows: DataFrame, held, k: int) -> DataFrame:
    """query_id, vec_id, score: what every task finds best among its rows, taken in their order. ``held``: broadcast queries by width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {width: Queries(*x, k=k) for width, x in held.value.items()}
        for batch in batches:
            for width, part in by_width(batch):
                if width not in queries:
                    continue
                for a in range(0, part.num_rows, BLOCK_ROWS):
                    some = part.slice(a, BLOCK_ROWS)
                    queries[width].take(np.asarray(some["id"].fill_null(NO_ID)), matrix(some["numbers"], width))
        for q in queries.values():
            i, r = np.nonzero(q.filled)
            ids = q.found[i, r]
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(q.scores[i, r])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", query_block: int = 65_536) -> DataFrame:
    """The ``k`` candidates of greatest inner product for every query: query_id, rank, vec_id, score. Exact.

    Components count as floor(1024 x), so scores are whole numbers; ties go to the smaller vec_id. Candidates are
    sorted by descending length over the partitions once and kept. Queries come in blocks of about
    ``query_block`` rows (about 35 MB at 64 components), one broadcast at a time. The longest vectors give every
    query a first bound; then all tasks go down their candidates and leave out whole blocks by length, and single
    candidates by the first rotated components plus the lengths of the rest.

    Nulls: vectors that are null or hold a null, NaN, infinite component or one of 65,536 or more take no part; a null
    id is no query, and as a candidate comes last among ties. A query's own row is every row with its id. Repeated rows
    are candidates each; an id that repeats among the queries asks once, with one of its vectors, always the same.
    Vectors of different widths are not compared; empty ones have the score 0 with each other. Work a task is
    bounded by blocks, however long the vectors. Empty tables give no rows. Columns are found by exact name, others
    take no part.
    """
    rows = measured(pick(vectors, id=id, vector=vector).select(F.col("id").cast("bigint"), "vector"))
    # The last key spreads rows that agree in everything.
    order = ["width", F.desc("length2"), F.xxhash64("id", "numbers"), F.monotonically_increasing_id()]
    rows = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions("width", F.desc("length2")))
    asked = measured(pick(queries, id=id, vector=vector).filter("id IS NOT NULL").select(F.col("id").cast("bigint"), "vector"))
    asked = cut_lineage(asked.groupBy("id").agg(F.max(F.struct("width", "numbers")).alias("q")).select("id", "q.*"))
    blocks = -(-asked.count() // query_block)
    if not blocks:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    turned = rotations(rows)
    heads = head_lengths(rows)
    head = reduce(lambda a, b: a | b, [(F.col("width") == w) & (F.col("length2") >= x) for w, x in heads.items()], F.lit(False))
    results = []
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        results.append(_of_block(rows, head, some, turned, k))
    return reduce(DataFrame.unionByName, results)


def head_lengths(rows: DataFrame) -> dict[int, float]:
    """Per width, the squared length of the HEAD_ROWS-th vector of the partition that holds the longest ones (of its last, if it has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[float, int, float]] = {}  # greatest, number and the last that counts
        for batch in batches:
            for width, part in by_width(batch):
                values = np.asarray(part["length2"])
                most, n, last = seen.get(width, (values[0], 0, 0.0))
                if n < HEAD_ROWS:
                    last = values[min(HEAD_ROWS - n, len(values)) - 1]
                seen[width] = most, n + len(values), last
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([x[0] for x in seen.values()], pa.float64()), pa.array([x[2] for x in seen.values()], pa.float64())], ["width", "most", "at"])

    found = rows.mapInArrow(run, "width int, most double, at double").groupBy("width").agg(F.max_by("at", "most").alias("at"))
    return {r["width"]: r["at"] for r in found.collect()}


def _of_block(rows: DataFrame, head, asked: pa.Table, turned: dict[int, np.ndarray], k: int) -> DataFrame:
    """Best candidates of one block of queries: of the longest vectors first, then of the rest above the bounds so found."""
    context = rows.sparkSession.sparkContext
    sets, widths = {}, np.asarray(asked["width"])
    for width in np.unique(widths).tolist():
        of = asked.filter(pa.array(widths == width)).combine_chunks()
        sets[width] = (np.asarray(of["id"]), matrix(of["numbers"], width), turned.get(width, np.eye(width)))
    floors = {w: np.full(len(x[0]), np.iinfo(np.int64).min) for w, x in sets.items()}

    def best(part: DataFrame) -> DataFrame:
        held = context.broadcast({w: (*x, floors[w]) for w, x in sets.items()})
        out = cut_lineage(best_of(part, held, k))
        held.destroy()
        return out

    first = best(rows.filter(head))
    ranked = top_per_group(first, ["query_id"], [F.desc("score")], k, "rank")
    least = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).toArrow()
    bound = dict(zip(least["query_id"].to_pylist(), least["least"].to_pylist()))
    for width, x in sets.items():
        floors[width] = np.array([bound.get(i, np.iinfo(np.int64).min) for i in x[0].tolist()], np.int64)
    rest = best(rows.filter(~head))
    merged = top_per_group(first.unionByName(rest), ["query_id"], [F.desc("score"), F.asc_nulls_last("vec_id")], k, "rank")
    return merged.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
