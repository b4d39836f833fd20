"""N-gram Jaccard join by a token-group matrix: exact links, their counts and connected components.

Documents with one shingle set are one node. Nodes that can have a link at all, by how many of their
tokens no other node has, are put into groups of similar nodes of bounded size; a group stores the union of its members' tokens. A query node opens a
group only if its overlap with that union is large enough for any member.

Which groups a node must be held against is found by blocks: for sets that may differ in at most D
tokens, tokens are dealt by hash into more than D blocks, so two linked sets agree in at least one whole
block; a set with too few blocks that hold tokens is dealt again to more. D follows from the sizes; sizes are cut into classes such that linked sets lie in one class or
in neighbouring ones. A passage that many texts share puts few whole blocks in common, so no list of
the texts with a frequent token is ever joined with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from docmarket.llm.words import WHITESPACE, mix, slices, window_hashes, word_hashes
from docmarket.session import cut_lineage

GOLDEN = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: How often a row is dealt to blocks before each of its tokens is a block.
DEALS = 12


@lru_cache(maxsize=4)
def size_classes(percent: int) -> np.ndarray:
    """Smallest size of each class: linked sets lie in one class or in neighbouring ones."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, dtype=np.int64)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle hashes of every row of a slice, one after the other, and the bounds of the rows."""
    words, rows = word_hashes(column, WHITESPACE)
    hashes, bounds = window_hashes(words, rows, size)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    bounds = np.searchsorted(row, np.arange(len(bounds)))
    return hashes, bounds


def node_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set. Two different sets share one with a chance of n * n / 2**65 over n sets."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B)))))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).astype(np.int64)


def block_keys(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all blocks that hold tokens, with the row of each. A row gives the blocks of its class and of the next.

    An empty block says nothing, so it has no key. A row whose full blocks are no more than the tokens it
    may differ in from a linked one is dealt again to somewhat more blocks, and so on, up to one block a
    token. Of two linked rows the one that ends first has a full block that no difference touches, and the
    other has been dealt the same way that far.
    """
    counts = np.diff(bounds)
    low = size_classes(percent)
    keys, rows = [], []
    every = np.repeat(np.arange(len(counts)), counts)
    for up in (0, 1):
        scheme = np.searchsorted(low, counts, side="right") - 1 + up
        spare = (100 - percent) * 2 * (low[scheme + 1] - 1) // (100 + percent)  # most tokens that linked sets differ in
        most = np.minimum(spare, counts * (100 - percent) // percent)  # the same by the row's own size
        blocks = spare + 1 + spare // 12
        todo = counts > 0
        for deal in range(DEALS + 1):
            own = todo[every]
            tokens, row = hashes[own], every[own]
            if not len(row):
                break
            some = np.flatnonzero(todo)
            place = np.zeros(len(counts), dtype=np.int64)
            if deal < DEALS:
                slot = (mix(tokens + np.uint64(7 + deal)) % blocks[row].astype(np.uint64)).astype(np.int64)
                place[some] = np.cumsum(blocks[some]) - blocks[some]
                at = place[row] + slot
                order = np.argsort(at, kind="stable")
                tokens, row, at = tokens[order], row[order], at[order]
            else:
                at = np.arange(len(row))
            # Sums of token hashes by (row, slot), in order of the slots.
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total = np.add.reduceat(mix(tokens ^ np.uint64(0x5BE0CD19137E2179)), starts)
            owner = row[starts]
            number = at[starts] - place[owner] if deal < DEALS else np.zeros(len(starts), dtype=np.int64)
            salt = mix(scheme[owner].astype(np.uint64) * np.uint64(GOLDEN) + (number * (DEALS + 1) + deal).astype(np.uint64))
            keys.append(mix(total ^ salt))
            rows.append(owner)
            todo &= np.bincount(owner, minlength=len(counts)) <= most
            blocks = blocks + np.maximum(1, blocks // 8)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).astype(np.int64), np.concatenate(rows)


def links_in_group(members: list[tuple[int, int, np.ndarray]], queries: list[tuple[int, int, np.ndarray]], own: bool, percent: int) -> tuple[dict, list]:
    """Hold queries against a group: links by node, as copies of linked nodes, and edges that join what is linked.

    (node, copies, tokens). A query is held against the members only if 100 * (its tokens in the
    group's union) reaches ``percent`` of its own size: no member can share more.
    """
    tokens = np.concatenate([m[2] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    union, first = np.unique(tokens, return_index=True)
    first = np.append(first, len(tokens))
    sizes, copies = np.array([len(m[2]) for m in members]), np.array([m[1] for m in members])
    root = np.arange(len(members))
    added = np.zeros(len(members), dtype=np.int64)
    links: dict[int, int] = {}
    edges = []
    for q, (node, weight, own_tokens) in enumerate(queries):
        at = np.minimum(np.searchsorted(union, own_tokens), len(union) - 1)
        at = at[union[at] == own_tokens]
        if 100 * len(at) < percent * len(own_tokens):
            continue
        length = first[at + 1] - first[at]
        posting = np.arange(length.sum()) + np.repeat(first[at] - (np.cumsum(length) - length), length)
        shared = np.bincount(owner[posting], minlength=len(members))
        linked = 100 * shared >= percent * (sizes + len(own_tokens) - shared)
        if own:
            linked[q] = False
        hit = np.flatnonzero(linked)
        if not len(hit):
            continue
        links[node] = links.get(node, 0) + int(copies[hit].sum())
        if own:
            roots = np.unique(np.append(root[hit], root[q]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        else:
            added[hit] += weight
            edges.append((node, hit))
    for i in np.flatnonzero(added).tolist():
        links[members[i][0]] = links.get(members[i][0], 0) + int(added[i])
    out = []
    if own:
        out = [(members[i][0], members[root[i]][0]) for i in range(len(members)) if root[i] != i]
    else:
        # Members joined by one query need no further edge between themselves.
        for node, hit in edges:
            heads = np.unique(root[hit])
            out += [(node, members[i][0]) for i in heads.tolist()]
            root[np.isin(root, heads)] = heads[0]
    return links, out


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90, group_tokens: int = 1_000_000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links.

    Two documents link when 100 * (common shingles) >= percent * (shingles of either); shingles are
    distinct runs of ``shingle`` lower-cased words, a shorter text being one. component_id is the smallest
    id that links lead to, n_links the number of other documents linked, copies included.

    Nulls: a null text has no shingle, like an empty one: n_shingles 0, no link, its own component. A null id
    is linked like any other but never the smallest; without another id component_id is null. Rows
    that repeat an id are documents of their own. Empty tables give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in slices(batch["text"]):
                hashes, bounds = shingle_sets(batch["text"].slice(a, b - a), shingle)
                nodes.append(node_ids(hashes, bounds))
                counts.append(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["id", "h", "node", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.withColumn("h", F.xxhash64("text"))
    documents = cut_lineage(keyed.mapInArrow(profile, f"id {kind}, h bigint, node bigint, n bigint"))
    nodes = documents.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min("h").alias("h"))
    nodes = cut_lineage(nodes)
    own = nodes.join(_unshared(rows.select("text"), shingle, percent), "node", "left")
    chosen = cut_lineage(own.filter(100 * F.coalesce("unshared", F.lit(0)) <= (100 - percent) * F.col("n")).drop("unshared"))
    found = cut_lineage(_held_against_groups(keyed, chosen, shingle, percent, group_tokens))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(smallest, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = documents.join(placed, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _unshared(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, unshared): how many of a node's tokens in one fixed part of the hash space no other node has.

    A set may hold at most (100 - percent) % tokens that a linked set has not, wherever their hashes lie.
    So a node with more unshared tokens than that in any part of the hash space has no link at all. The
    part is twice as wide as this bound: a text without a link drops out unless half of it is in others.
    """
    part = np.uint64(min(2 * (100 - percent) + 1, 100) * (_ALL // 100))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # one number for each of the task's own documents
        for batch in batches:
            for a, b in slices(batch["text"]):
                hashes, bounds = shingle_sets(batch["text"].slice(a, b - a), shingle)
                nodes = node_ids(hashes, bounds)
                fresh = np.zeros(len(nodes), dtype=bool)
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh[i] = True
                row = np.repeat(np.arange(len(nodes)), np.diff(bounds))
                keep = fresh[row] & (mix(hashes + np.uint64(11)) < part)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].astype(np.int64)), pa.array(nodes[row[keep]], pa.int64())], ["token", "node"])

    tokens = texts.select("text").mapInArrow(run, "token bigint, node bigint").groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return tokens.filter("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("unshared"))


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``df``, to be broadcast if it has few enough of its short rows; else its join is a shuffled one."""
    return F.broadcast(df) if rows <= most else df


def _sets(keyed: DataFrame, chosen: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, task, tokens and keys of the chosen nodes. A node comes once from each task that holds a copy."""
    number = chosen.count()
    texts = keyed.join(small(chosen.select("h"), number), "h", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch["text"]):
                hashes, bounds = shingle_sets(batch["text"].slice(a, b - a), shingle)
                nodes = node_ids(hashes, bounds).tolist()
                keys, row = block_keys(hashes, bounds, percent)
                order = np.argsort(row, kind="stable")
                keys, row = keys[order], row[order]
                at = np.searchsorted(row, np.arange(len(nodes) + 1))
                out: list[list] = [[], [], []]
                for i, node in enumerate(nodes):
                    if node not in seen and bounds[i] < bounds[i + 1]:
                        seen.add(node)
                        own = hashes[bounds[i] : bounds[i + 1]]
                        for column, value in zip(out, (node, own.astype(np.int64), keys[at[i] : at[i + 1]])):
                            column.append(value)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], long), pa.array(out[1], pa.list_(long)), pa.array(out[2], pa.list_(long))], ["node", "tokens", "keys"])

    sets = texts.mapInArrow(run, "node bigint, tokens array<bigint>, keys array<bigint>").withColumn("task", F.spark_partition_id())
    return sets.join(small(chosen.select("node"), number), "node", "left_semi")


def _in_groups(sizes: DataFrame, entries: DataFrame, group_tokens: int) -> DataFrame:
    """(node, gid, split): similar nodes together, about ``group_tokens`` tokens a group.

    Similar are nodes that blocks connect, directly or through others, so no block leads out of such a
    family. Small families share a group; a family of more than twice ``group_tokens`` is split. Two
    groups whose hashed number is the same are one larger group, which changes no result.
    """
    least = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    edges = cut_lineage(entries.join(least.select("key", "first"), "key").filter("node <> first").select("node", "first").distinct())
    # Every node first goes to its smallest neighbour; only what joins two such stars is left for the rounds of `connected`.
    star = cut_lineage(sizes.join(edges.groupBy("node").agg(F.min("first").alias("star")), "node", "left").select("node", "n", F.coalesce("star", "node").alias("star")))
    number = star.count()
    ends = edges.join(small(star.select("node", F.col("star").alias("a")), number), "node").join(small(star.select(F.col("node").alias("first"), F.col("star").alias("b")), number), "first")
    roots = connected(ends.filter("a <> b").select("a", "b").distinct())
    families = star.join(roots.select(F.col("node").alias("star"), "root"), "star", "left").select("node", "n", F.coalesce("root", "star").alias("family"))
    # Large families stand alone, in as many groups as they need; the others are dealt to buckets whole.
    large = families.groupBy("family").agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > 2 * group_tokens)
    large = cut_lineage(large.select("family", F.ceil(F.col("tokens") / group_tokens).alias("parts")))
    families = families.join(small(large, large.count()), "family", "left")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // group_tokens))
    split = F.col("parts").isNotNull()
    gid = F.when(split, F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("family"), F.lit(buckets)))
    return families.select("node", gid.alias("gid"), split.alias("split"))


def _held_against_groups(keyed: DataFrame, chosen: DataFrame, shingle: int, percent: int, group_tokens: int) -> DataFrame:
    """Links and joining edges of all chosen nodes: node, other (null where there is no edge), links."""
    sets = cut_lineage(_sets(keyed, chosen, shingle, percent))
    # Of a node that several tasks gave, one row counts; its tokens are not shuffled for that.
    one = cut_lineage(sets.groupBy("node").agg(F.min("task").alias("task")).join(chosen.select("node", "copies", "n"), "node"))
    number = one.count()
    entries = sets.join(small(one.select("node", "task"), number), ["node", "task"]).select("node", F.explode("keys").alias("key"))
    placed = cut_lineage(one.join(_in_groups(one.select("node", "n"), entries, group_tokens), "node"))
    sets = sets.join(small(placed, number), ["node", "task"]).drop("task")
    # The matrix: which groups hold a block, where families are split. A node opens the groups after its own that hold one of its blocks.
    entries = sets.filter("split").select("node", "gid", F.explode("keys").alias("key"))
    matrix = entries.select("key", F.col("gid").alias("group")).distinct()
    wide = matrix.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").select("key")
    entries = entries.join(wide, "key", "left_semi")
    opened = entries.join(matrix.join(wide, "key", "left_semi"), "key").filter("group > gid").select("node", "group").distinct()
    opened = cut_lineage(opened.join(sets.select("node", "n"), "node"))
    parts = opened.groupBy("group").agg(F.ceil(F.sum("n") / group_tokens).cast("int").alias("parts"))
    queries = opened.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int") + 1).select("node", "group", "part")
    queries = queries.join(sets.select("node", "copies", "tokens"), "node").select("group", "part", F.lit(True).alias("asks"), "node", "copies", "tokens")
    # Part 0 of a group holds its members against each other; each other part brings some queries to the members that hold a block of another group.
    places = parts.select("group", F.explode(F.sequence(F.lit(1), "parts")).alias("part"))
    members = sets.select(F.col("gid").alias("group"), "node", "copies", "tokens")
    own = members.withColumn("part", F.lit(0))
    brought = members.join(entries.select("node").distinct(), "node", "left_semi").join(places, "group")
    columns = ["group", "part", F.lit(False).alias("asks"), "node", "copies", "tokens"]
    rows = own.select(*columns).unionByName(brought.select(*columns)).unionByName(queries)

    def hold(key, frame):
        sets_of = lambda asks: [(n, c, np.asarray(t).astype(np.uint64)) for n, c, t in frame.loc[frame["asks"] == asks, ["node", "copies", "tokens"]].itertuples(index=False)]
        members, asking = sets_of(False), sets_of(True)
        links, edges = links_in_group(members, members if key[1] == 0 else asking, key[1] == 0, percent)
        return pd.DataFrame({"node": [*links, *(a for a, _ in edges)], "other": pd.array([None] * len(links) + [b for _, b in edges], dtype="Int64"), "links": [*links.values(), *([0] * len(edges))]})

    return rows.groupBy("group", "part").applyInPandas(hold, "node bigint, other bigint, links bigint")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges (a, b): root is the smallest node of the component.

    In each round a node takes the smallest root among its neighbours' and its own, and then the root of
    that root, until nothing changes. Every round's table is a checkpoint, so a lost executor costs one round.
    """
    both = cut_lineage(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    number = labels.count()
    if not number:
        return labels
    while True:  # each round at least halves the longest way to a root
        near = both.join(small(labels.select(F.col("node").alias("other"), F.col("root").alias("near")), number), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.join(small(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), number), "root").select("node", "old", F.least("root", "far").alias("root"))
        jump = cut_lineage(jump)
        labels = jump.select("node", "root")
        if jump.filter("old <> root").isEmpty():
            return labels
