"""Product codes by Lloyd rounds over cover trees: subtrees go whole to a codebook entry where the triangle inequality allows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from docmarket.llm.columns import pick
from docmarket.llm.vectors import exact_float, usable, whole_numbers
from docmarket.session import cut_lineage

CHUNK_ROWS = 1024  # vectors under one tree
LEAF = 8  # a node of so few points is not divided
NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("center", "<i4"), ("child", "<i4"), ("children", "<i4"), ("loose", "<i4"), ("radius", "<f8")])


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover tree over the rows of ``points``: the order of the points, and the nodes.

    A node is a stretch of that order with a center among its points and the greatest distance to it. Its children
    cover it by balls of half that radius, centers first come first served; points alone in their ball stay
    ``loose`` at the end of its stretch and have no node. Children lie next to each other, parents before them.
    """
    square = (points * points).sum(1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (points @ points.T), 0))
    order = np.empty(len(points), np.int32)
    nodes: list[tuple] = []
    waiting = [(np.arange(len(points)), 0, 0)]  # points, place of the first, center
    at = 0
    while at < len(waiting):
        members, start, center = waiting[at]
        at += 1
        stop, radius = start + len(members), float(distance[center, members].max())
        if radius == 0 or len(members) <= LEAF:
            order[start:stop] = members
            nodes.append((start, stop, center, 0, 0, start, radius))
            continue
        near = distance[np.ix_(members, members)] <= radius / 2
        alone = near.sum(1) == 1
        open_ = ~alone
        child, place = len(waiting), start
        loose = [members[alone]]
        for i in np.flatnonzero(open_):
            if open_[i]:
                ball = near[i] & open_
                open_ &= ~ball
                own = members[ball]
                if len(own) > 1:
                    waiting.append((own, place, members[i]))
                    place += len(own)
                else:
                    loose.append(own)
        order[place:stop] = np.concatenate(loose)
        nodes.append((start, stop, center, child, len(waiting) - child, place, radius))
    return order, np.array(nodes, NODE)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    size = stop - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(start) else np.zeros(0, np.int64)


@dataclass
class Work:
    """What an assignment looked at."""

    whole: int = 0  # points that went with their subtree
    compared: int = 0  # points compared one by one


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact: in doubles where they hold them, else in longs."""
    most = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if exact_float(2 * most, 2 * most, points.shape[1]) else np.int64
    a, b = points.astype(kind), book.astype(kind)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def assign(points: np.ndarray, nodes: np.ndarray, book: np.ndarray, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of all points, which are in tree order as the nodes' centers are, and the sums and counts of the entries.

    From the root down: if a node's nearest entry is nearer to its center than the second by more than twice the
    radius, it is nearest to all its points, and the stretch's sum comes from the cumulative sums. Other nodes hand on
    to their children; loose points and those of undivided nodes are compared one by one.
    """
    n, k = len(points), len(book)
    code = np.empty(n, np.int64)
    sums, counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
    running = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)))
    work = work or Work()
    front = np.zeros(1, np.int64)
    single = []
    while len(front):
        node = nodes[front]
        d = squared(points[node["center"]], book)
        best = d.argmin(1)
        first = np.sqrt(d[np.arange(len(d)), best].astype(np.float64))
        if k > 1:
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
            second = np.sqrt(d.min(1).astype(np.float64))
        else:
            second = np.full(len(d), np.inf)
        # A node of radius 0 is its center; elsewhere a margin for rounding.
        sure = (node["radius"] == 0) | (second - first > 2 * node["radius"] * (1 + 1e-9) + 1e-6)
        won, at = node[sure], best[sure]
        code[ranges(won["start"], won["stop"])] = np.repeat(at, won["stop"] - won["start"])
        np.add.at(sums, at, running[won["stop"]] - running[won["start"]])
        np.add.at(counts, at, won["stop"] - won["start"])
        work.whole += int((won["stop"] - won["start"]).sum())
        open_ = node[~sure]
        single.append(ranges(open_["loose"], open_["stop"]))
        front = ranges(open_["child"], open_["child"] + open_["children"])
    places = np.concatenate(single)
    if len(places):
        at = squared(points[places], book).argmin(1)
        code[places] = at
        order = np.argsort(at, kind="stable")
        entry, first = np.unique(at[order], return_index=True)
        sums[entry] += np.add.reduceat(points[places][order], first, axis=0)
        counts += np.bincount(at, minlength=k)
        work.compared += len(places)
    return code, sums, counts


def cuts(width: int, parts: int) -> list[int]:
    """Bounds of the parts: equal ones, or as near as the width allows."""
    return [width * i // parts for i in range(parts + 1)]


def planted(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row for each chunk of vectors: ids, labels, the numbers and the trees of all parts."""
    bounds = cuts(width, parts)

    def chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        numbers = np.vstack([x for b in batches for _, x in whole_numbers(b["vector"])]) if width else np.zeros((table.num_rows, 0), np.int64)
        orders, trees = [], []
        for a, b in zip(bounds, bounds[1:]):
            order, nodes = grow(numbers[:, a:b].astype(np.float64))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            nodes["center"] = place[nodes["center"]]
            orders.append(order.astype("<i4").tobytes())
            trees.append(nodes.tobytes())
        whole = lambda name: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table[name].combine_chunks())
        return pa.RecordBatch.from_arrays([whole("id"), whole("label"), pa.array([numbers.astype("<i4").tobytes()], pa.binary()), pa.array([orders], pa.list_(pa.binary())), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "numbers", "orders", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, CHUNK_ROWS - size)
                held.append(some)
                size += some.num_rows
                batch = batch.slice(some.num_rows)
                if size == CHUNK_ROWS:
                    yield chunk(held)
                    held, size = [], 0
        if size:
            yield chunk(held)

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{label}>, numbers binary, orders array<binary>, trees array<binary>")


def forest(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """For every chunk of a batch its row, its numbers, and for every part the order, the points in that order and the nodes."""
    bounds = cuts(width, parts)
    for r in range(batch.num_rows):
        size = len(batch["ids"][r])
        numbers = np.frombuffer(batch["numbers"][r].as_py(), "<i4").reshape(size, width).astype(np.int64)
        out = []
        for p, (order, tree) in enumerate(zip(batch["orders"][r].as_py(), batch["trees"][r].as_py())):
            order = np.frombuffer(order, "<i4")
            out.append((order, numbers[order, bounds[p] : bounds[p + 1]], np.frombuffer(tree, NODE)))
        yield r, numbers, out


def lloyd_round(trees: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks after one round: the floored mean of each entry's parts. Tasks send one sum for each entry and component."""
    parts = len(books)
    held = trees.sparkSession.sparkContext.broadcast(books)  # entries x width numbers, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, _, chunk in forest(batch, width, parts):
                for p, (_, points, nodes) in enumerate(chunk):
                    _, s, c = assign(points, nodes, books[p])
                    sums[p] += s
                    counts[p] += c
        for p, (s, c) in enumerate(zip(sums, counts)):
            entry = np.flatnonzero(c)
            columns = [np.repeat(entry, s.shape[1]), np.tile(np.arange(s.shape[1]), len(entry)), s[entry].ravel(), np.repeat(c[entry], s.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(columns[0].shape, p, np.int32)), *map(pa.array, columns)], ["part", "entry", "position", "s", "n"])

    found = trees.mapInArrow(run, "part int, entry bigint, position bigint, s bigint, n bigint").groupBy("part", "entry", "position").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    held.destroy()
    part, entry, position, s, n = (np.asarray(found[c]) for c in ("part", "entry", "position", "s", "n"))
    out = [b.copy() for b in books]
    for p, book in enumerate(out):
        of = part == p
        book[entry[of], position[of]] = s[of] // n[of]
    return out


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the vectors with the smallest ids, null ids last; those of one id in the order of their components.

    Only ids are ranked at first; vectors travel for rows up to the last of these ids.
    """
    known = rows.filter("id IS NOT NULL")
    ids = [r["id"] for r in known.select("id").orderBy("id").limit(entries).collect()]
    low = known.filter(F.col("id") <= ids[-1]) if ids else known.limit(0)
    if len(ids) < entries:
        low = low.unionByName(rows.filter("id IS NULL"))
    found = low.select("id", "vector").orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow()
    numbers = np.vstack([x for _, x in whole_numbers(found["vector"])])
    bounds = cuts(numbers.shape[1], parts)
    return [numbers[:, a:b] for a, b in zip(bounds, bounds[1:])]


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks: vec_id, label, code (array of entry numbers, one a part), error.

    Components count as floor(1024 x). Codebooks start from the vectors with the smallest ids and are refined by
    ``rounds`` of Lloyd's method over all vectors, in whole numbers (means are floored, unused entries stay, ties go
    to the lower entry); then all parts are assigned again. Trees are grown once, over chunks of 1,024 vectors of a
    partition, and kept; a round brings the driver one sum for each entry and component.

    Nulls: vectors that are null or hold a null, NaN, infinite component or one of 65,536 or more are dropped; a null id
    comes after all others; a null label is a label. Repeated rows count each and get the same code. Vectors of other
    widths than the one with the smallest id has are dropped, as no codebook fits them; a width that ``parts`` does not
    divide gives parts that differ by one. Fewer vectors than ``entries`` give shorter codebooks. An empty table gives
    no rows and no codebooks. Columns are found by exact name; others take no part. Memory is bounded by chunks.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code has one byte a part")
    rows = pick(vectors, id=id, vector=vector, label=label).withColumn("id", F.col("id").cast("bigint")).filter(usable(F.col("vector")))
    spark, kind = vectors.sparkSession, rows.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {kind}, code array<int>, error bigint"
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").select(F.size("vector").alias("width")).first()
    if first is None:
        return spark.createDataFrame([], schema), []
    width = first["width"]
    rows = rows.filter(F.size("vector") == width)
    books = first_books(rows, parts, entries)
    trees = cut_lineage(planted(rows, width, parts))
    for _ in range(rounds):
        books = lloyd_round(trees, books, width)
    held = spark.sparkContext.broadcast(books)
    bounds = cuts(width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, numbers, chunk in forest(batch, width, parts):
                code, error = np.empty((len(numbers), parts), np.int32), np.zeros(len(numbers), np.int64)
                for p, (order, points, nodes) in enumerate(chunk):
                    code[order, p] = assign(points, nodes, held.value[p])[0]
                    error += ((numbers[:, bounds[p] : bounds[p + 1]] - held.value[p][code[:, p]]) ** 2).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * parts, pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([batch["ids"].slice(r, 1).flatten(), batch["labels"].slice(r, 1).flatten(), lists, pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = cut_lineage(trees.mapInArrow(run, schema))
    held.destroy()
    return coded, books


def books_sha256(books: list[np.ndarray]) -> str:
    """Hash of all entries' components, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over the rows of equal labels (nulls together).

    One row a label is joined back null-safe, so a label with most of the rows is on one side only and can be split.
    """
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["__label"])).drop("__label")
