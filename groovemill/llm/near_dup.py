"""Operator 7: SimHash near-duplicates, found in BK-trees.

Each distinct fingerprint is a node. Fingerprints that differ in at most ``radius`` bits agree in at least
``blocks - radius`` of ``blocks`` parts of their bits, so it is dealt out under every choice of that many parts; equal
keys share a tree. A tree's children are keyed by their distance to the parent, and a search follows only the edges
within the radius. The trees of a task are built and searched together, level by level, in numpy arrays.

The trees aren't broadcast: they would grow with the input. Each is built where its searches are, by the shuffle that
deals out the keys; a key that many fingerprints have is cut into blocks, and tasks hold a few keys at once. A task
reports a spanning forest of its links, not the pairs, and branches whose nodes are linked to the searching one already
are left out; blocks whose rows are connected already don't meet. So large groups of near copies cost their square
neither in links nor in rows.

Components are the fixpoint of alternating star contractions over the forest's edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import checkpointed, forget, stored
from .text import slices, text_bytes

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Mean number of fingerprints of a tree that decides the number of parts.
TREE = 64
#: Searches that run at once.
SEARCHES = 1 << 15
#: Shingle hashes that are unpacked to bits at once.
HASHES = 1 << 17
#: Rows of a key from which on it is cut into blocks, in how many rows one is counted, and rows that a task works on at once.
HOT, SHARE, AT_ONCE = 1 << 15, 64, 1 << 16


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (signed longs) of runs of hashes, each of at least one: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def _fingerprints(data: np.ndarray, ends: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of the rows' bytes as signed longs."""
    out, hashes, counts, rows = np.zeros(len(ends) - 1, np.int64), [], [], []

    def flush() -> None:
        if counts:
            out[rows] = majority(np.array(hashes, np.uint64), np.array(counts))
            hashes.clear(), counts.clear(), rows.clear()

    digest = xxhash.xxh64_intdigest
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        parts = data[a:b].tobytes().lower().split()  # bytes: A-Z only, and the same white space as the words'
        if not parts:
            continue
        line = b" ".join(parts)
        stops = list(itertools.accumulate(len(p) + 1 for p in parts))
        starts = [0, *stops[: max(0, len(parts) - shingle)]]
        hashes += [digest(line[i : j - 1], SEED) for i, j in zip(starts, stops[shingle - 1 :] or stops[-1:], strict=True)]
        counts.append(len(starts))
        rows.append(row)
        if len(hashes) >= HASHES:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row's whole ``text``.

    A text of fewer words than a shingle has one shingle of all of them; null, empty and blank texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_fingerprints(*text_bytes(batch.column(1)), shingle))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)


class Trees:
    """BK-trees of values, one for each group (numbers from 0, ascending), built level by level.

    A node's children are keyed by their distance to it; equal keys go down together until one of them is a node.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value, self.parent, self.edge = value, np.full(n, -1), np.zeros(n, np.int64)
        first = np.concatenate([np.ones(min(n, 1), bool), group[1:] != group[:-1]])
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # the node that an entry goes down from
        self.root, rest, self.levels = head.copy(), np.flatnonzero(~first), []
        while len(rest):
            d = _distance(value[rest], value[head[rest]])
            _, firsts, where = np.unique(head[rest] * 65 + d, return_index=True, return_inverse=True)
            chosen = rest[firsts]
            self.parent[chosen], self.edge[chosen] = head[chosen], d[firsts]
            self.levels.append(chosen)
            head[rest] = chosen[where]
            rest = rest[head[rest] != rest]
        order = np.lexsort((self.edge, self.parent))
        self.children = order[self.parent[order] >= 0]
        self.below = np.bincount(self.parent[self.children], minlength=n)
        self.begin = np.cumsum(self.below) - self.below

    def bounds(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest label in the branch from each node on."""
        low, high = label.copy(), label.copy()
        for nodes in reversed(self.levels):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return low, high

    def search(self, wanted: np.ndarray, root: np.ndarray, radius: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of wanted values, nodes and their distance of at most ``radius``, level by level.

        Follows only the edges within the radius, and of those the ones that ``keep`` lets pass (numbers, nodes).
        """
        query, node = np.arange(len(wanted)), root
        while len(query):
            kept = keep(query, node)
            query, node = query[kept], node[kept]
            d = _distance(wanted[query], self.value[node])
            near = d <= radius
            yield query[near], node[near], d[near]
            count = self.below[node]
            at = np.repeat(self.begin[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            query, d, child = np.repeat(query, count), np.repeat(d, count), self.children[at]
            follow = np.abs(self.edge[child] - d) <= radius
            query, node = query[follow], child[follow]


def link_trees(group: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """For each entry the smallest entry that it is connected with by links within its group.

    group: numbers from 0, ascending. Builds a BK-tree for each group, then searches it with its own values.
    """
    trees, label = Trees(group, value), np.arange(len(value))
    tied = np.flatnonzero((trees.parent >= 0) & (trees.edge <= radius))
    label = _unite(label, tied, trees.parent[tied])
    grouped = np.flatnonzero(trees.below[trees.root] > 0) if len(value) else label
    for at in range(0, len(grouped), SEARCHES):
        own = grouped[at : at + SEARCHES]
        low, high = trees.bounds(label)
        apart = lambda q, node: (low[node] != high[node]) | (low[node] != label[own[q]])  # noqa: B023, E731 - else linked with the whole branch
        for q, node, _ in trees.search(value[own], trees.root[own], radius, apart):
            label = _unite(label, own[q], node)
    return label


def _parts(n: int, radius: int) -> int:
    """Parts of a fingerprint: as few as leave a tree about TREE of n fingerprints."""
    parts = radius + 1
    while parts < 12 and n / 2 ** (64 * (parts - radius) // parts) > TREE:
        parts += 1
    return parts


def linked(rows: Callable[[DataFrame | None], DataFrame], light: DataFrame, keys: list[str], node: str, link: Callable[[DataFrame], DataFrame], hot_rows: int | None = None) -> DataFrame:
    """Edges (a, b), a > b, that connect what ``link`` connects among rows of equal keys.

    light: keys and node of all rows; rows: gives the rows themselves (keys, node, fp and what else ``link`` reads), or only
    those of (keys, node) that it is given. ``link`` makes edges of rows that are sorted by keys, cell (low, high), side and fp:
    rows of a cell meet each other where low = high, else those of side 1 meet those of side 0.

    A key of more than about ``hot_rows`` (else HOT) rows is never in one task. First each of its rows meets two blocks, by two
    hashes, which connects most of a large group of near copies; then blocks meet each other, two in a cell, but for
    blocks of rows that are connected already. So n connected rows and m others are shipped 2 n + n m / hot_rows times,
    about, not n * n / hot_rows times, and no pair of rows that aren't connected is left out. How many rows a key has is
    estimated from one in SHARE; it decides the blocks, never the result.
    """
    most = hot_rows or HOT
    cell = "struct<low:bigint,high:bigint,side:int>"

    def met(cells: DataFrame) -> DataFrame:
        spread = cells.select("*", F.explode("cells").alias("cell")).select("*", "cell.*").drop("cells", "cell")
        return link(spread.repartition(*keys, "low", "high").sortWithinPartitions(*keys, "low", "high", "side", "fp"))

    one = lambda block: F.struct(block.alias("low"), block.alias("high"), F.lit(0).alias("side"))
    counted = light.where(F.pmod(F.xxhash64(node, F.lit("share")), F.lit(SHARE)) == 0).groupBy(*keys).agg((F.count("*") * SHARE).alias("n_key"))
    hot = checkpointed(counted.where(F.col("n_key") > most).select(*keys, F.ceil(F.col("n_key") / most).alias("blocks")))
    if hot.isEmpty():
        return met(rows(None).withColumn("cells", F.array(one(F.lit(0))).cast(f"array<{cell}>")))
    block = lambda name, of, n: F.pmod(F.xxhash64(of, F.lit(name)), n)
    both = F.array(one(block("first", node, F.col("blocks"))), one(F.col("blocks") + block("second", node, F.col("blocks"))))
    dealt = rows(None).join(hot, keys, "left").withColumn("cells", F.when(F.col("blocks").isNull(), F.array(one(F.lit(0))).cast(f"array<{cell}>")).otherwise(both.cast(f"array<{cell}>"))).drop("blocks")
    first = stored(met(dealt), "links")
    still = _apart(light.select(*keys, node).join(hot.select(*keys), keys), keys, node, first, most)
    if still.isEmpty():
        return first
    blocks = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    others = F.filter(blocks, lambda b: (b < F.col("low_own")) | (b >= F.col("high_own")))
    pair = lambda b: F.struct(F.least("own", b).alias("low"), F.greatest("own", b).alias("high"), (F.col("own") > b).cast("int").alias("side"))
    again = rows(still.select(*keys, node)).join(still, [*keys, node]).withColumn("cells", F.transform(others, pair).cast(f"array<{cell}>")).drop("own", "low_own", "high_own", "total")
    return first.unionByName(met(again))


def _apart(rows: DataFrame, keys: list[str], node: str, edges: DataFrame, most: int) -> DataFrame:
    """The rows (keys, node) of which some in their key aren't connected by the edges, with block (own), the blocks of rows
    connected to it (low_own to high_own, which is left out; none for those of mixed blocks) and the number of blocks of the key.

    Connected rows of a key, if ``most`` or more, have blocks of their own; all others share blocks, those connected one.
    """
    found = components(edges).select(F.col("id").alias(node), "component")
    labelled = stored(rows.join(found, node, "left").select(*keys, node, F.coalesce("component", node).alias("label")), "labelled")
    sizes = stored(labelled.groupBy(*keys, "label").agg(F.count("*").alias("size")), "sizes")
    mixed = sizes.groupBy(*keys).agg(F.ceil(F.sum(F.when(F.col("size") < most, F.col("size")).otherwise(0)) / most).alias("mixed"), F.count("*").alias("labels"))
    parts = F.ceil(F.col("size") / most)
    before = Window.partitionBy(*keys).orderBy("label")  # of one row for each ``most`` rows of a key at most
    large = sizes.where(F.col("size") >= most).select(*keys, "label", parts.alias("parts"), (F.sum(parts).over(before) - parts).alias("begin"))
    total = large.groupBy(*keys).agg(F.sum("parts").alias("n_large"))
    whole = mixed.where("labels > 1").join(total, keys, "left").select(*keys, "mixed", (F.col("mixed") + F.coalesce("n_large", F.lit(0))).alias("total"))
    begin = F.col("mixed") + F.col("begin")
    own = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("label", F.lit("mixed")), F.col("mixed"))).otherwise(begin + F.pmod(F.xxhash64(node, F.lit("own")), F.col("parts")))
    placed = labelled.join(whole, keys).join(large, [*keys, "label"], "left")
    return stored(placed.select(*keys, node, own.alias("own"), F.coalesce(begin, F.lit(-1)).alias("low_own"), F.coalesce(begin + F.col("parts"), F.lit(-1)).alias("high_own"), "total"), "apart")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], at_once: int | None = None) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups of equal keys, with ``group`` (numbers from 0): as many groups as have ``at_once`` (else AT_ONCE) rows, about."""

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if sum(b.num_rows for b in held) < (at_once or AT_ONCE):
                continue
        if not held:
            return
        table = pa.Table.from_batches(held)
        group = numbered(table)
        end = table.num_rows if batch is None else int(np.searchsorted(group, group[-1]))
        if end:
            yield table.slice(0, end).append_column("group", pa.array(group[:end]))
        held = table.slice(end).to_batches()


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a > b, between ids of ``prints`` (id, fp; distinct fingerprints, about n) that connect all that differ in at most ``radius`` bits."""
    parts = _parts(n, radius)
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = []
    for chosen in itertools.combinations(range(parts), parts - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = prints.select("id", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("choice", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("choice", "key", "low", "high")):
            ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy()
            label = link_trees(table.column("group").to_numpy(), fps, radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            distinct, where = np.unique(ids, return_inverse=True)
            forest = _unite(np.arange(len(distinct)), where[linked], where[label[linked]])
            tied = np.flatnonzero(forest != np.arange(len(forest)))
            yield pa.RecordBatch.from_arrays([pa.array(distinct[tied]), pa.array(distinct[forest[tied]])], names=["a", "b"])

    chosen_keys = ["choice", "key"]
    some = lambda only: keyed if only is None else keyed.join(only, [*chosen_keys, "id"], "left_semi")
    return linked(some, keyed, chosen_keys, "id", lambda dealt: dealt.mapInArrow(run, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every end of the edges (a > b), by alternating large and small stars.

    A large star ties each node's larger neighbours to its smallest one, a small star its smaller ones; each keeps
    connectivity, and their fixpoint has all nodes tied to the smallest. Sums before each shuffle and joins that
    Spark can split keep large stars apart; each round is a table of its own.
    """
    edges = stored(edges.distinct(), "stars")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b")).distinct()
        last, edges = edges, stored(small, "stars")
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the connected documents) of each row.

    Equal fingerprints are one node, named by its smallest doc_id. Rows with a null doc_id get the component of their
    fingerprint, if another row names it; rows that repeat a doc_id are kept. No rows give no rows.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL")
    found = components(links(nodes, prints.count(), radius))
    named = nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without those whose document is linked to one of smaller doc_id.

    doc_id is the key: rows that repeat one stay or go together, and rows without one stay.
    """
    gone = near_duplicates(docs, radius, shingle).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
