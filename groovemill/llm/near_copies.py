"""Operator 7 with an exact check: near copies by the Jaccard similarity of their five-word shingles.

Fingerprints (SimHash) of texts that are alike differ in up to a third of their bits, too many to find them among all
fingerprints. So shards are made first: sets that are alike share one of their first shingles, in whatever order all sets
have (prefix filter), and each is dealt out under those only. The order puts first what a sample shows to be rare; the
sample decides the work, never the result. Of shards with the same members one is kept. In each shard a BK-tree of
fingerprints gives the pairs within RADIUS, of which the sizes and parities of their sets leave few in that aren't alike.
What these connect goes, once for each set, to one place with its shingles, where the trees are searched again and
shingles are compared of pairs that aren't connected yet. Tasks report spanning forests of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_dup import SEED, SHARE, Trees, components, linked, majority, whole_groups
from .scratch import checkpointed, stored
from .text import slices, text_bytes

SHINGLE = 5
#: The least similarity, as a fraction.
ALIKE = (4, 5)
#: Bits in which fingerprints of sets that are alike differ at most. They differ in each bit with a chance of about
#: acos(8 / 9) / pi, so in 9.7 of 64 with a deviation of 2.9 at the least similarity; 24 leaves out one in some 100,000.
RADIUS = 24
#: Sets of fewer shingles, whose bits are no averages, are compared without a radius.
SMALL = 24
#: Documents about which the sample has, and most shingles that it names.
SAMPLE, FREQUENT = 4000, 100_000
#: Rows from which on a shard is cut into cells, rows that a task works on at once, and searches between two looks at what is connected.
HOT, AT_ONCE, SEARCHES = 1 << 12, 1 << 12, 1 << 9
#: Bits of a set's parities.
PARITIES = 1024
#: Rows from which on a shingle's sets are counted in parts, about.
HOT_KEY = 1 << 16
#: Sets that a task remembers at most to name their prefixes once.
REMEMBERED = 1 << 18
#: Bits for each document in the map that says whose sets are worth making again, and most bits of the map (32 MB).
BITS_EACH, MOST_BITS = 8, 1 << 28


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words has one of all of them."""
    parts = text.lower().split()  # bytes: A-Z only, and the same white space as the words'
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(parts[i : i + shingle]), SEED) for i in range(max(1, len(parts) - shingle + 1))} if parts else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def _map_bits(n: int) -> int:
    """The size of the map for n documents: a power of two."""
    return min(MOST_BITS, 1 << max(10, (BITS_EACH * n - 1).bit_length()))


def _spread(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bit for each doc_id in a map of so many."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def _made(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]]:
    """doc_id, sets, their hashes and their sizes, slice by slice."""
    for batch in slices(batches):
        data, ends = text_bytes(batch.column(1))
        sets = [_shingles(data[a:b].tobytes(), shingle) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield batch.column(0), sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64), np.array([len(s) for s in sets], np.int64)


def _sims(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(sets), np.int64), np.flatnonzero(n)
    for at in range(0, len(full), 64):  # some sets' bits at once
        some = full[at : at + 64]
        out[some] = majority(np.concatenate([sets[i] for i in some]), n[some])
    return out


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, only: np.ndarray | None = None) -> DataFrame:
    """fp (hash of the set) and hashes of each row's shingles, or n and sim (SimHash; 0 without shingles) as well.

    only: a map of at most MOST_BITS bits; rows whose bit isn't set are left out.
    """
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(only)  # at most MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None:
            wanted = np.unpackbits(shared.value).astype(bool)
            batches = (b.filter(pa.array(wanted[_spread(b.column(0).to_numpy(), len(wanted))])) for b in batches)
        for _, sets, fps, n in _made(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(n), pa.array(_sims(sets, n)), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "n", "sim", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "fp long, n long, sim long, hashes array<long>")


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that are in several documents of a sample, ascending, and how often."""
    share = F.lit(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 30))
    some = docs.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < share)
    counted = shingle_sets(some, shingle).select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    return counted.sort_values("h").to_numpy(np.int64).reshape(-1, 2)


def prints_and_prefixes(docs: DataFrame, frequent: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (hash of the set), n, sim (its SimHash), parities and prefix of each row.

    prefix: the rarest shingles of the set, of which sets that are alike share one; none where the task has had the set before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT rows
    a, b = ALIKE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times = shared.value.T
        seen: set[int] = set()
        nothing = np.zeros(0, np.int64)

        def prefix(fp: int, h: np.ndarray) -> np.ndarray:
            if fp in seen or not len(h):
                return nothing
            if len(seen) >= REMEMBERED:
                seen.clear()  # prefixes may come twice
            seen.add(fp)
            often = np.zeros(len(h), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                often = np.where(names[at] == h, times[at], 0)
            return h[np.lexsort((h, often))[: len(h) - -(-a * len(h) // b) + 1]]

        for ids, sets, fps, n in _made(batches, shingle):
            prefixes = [prefix(fp, h) for fp, h in zip(fps.tolist(), sets, strict=True)]
            odd = pa.array([x.tobytes() for x in _parities(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps), pa.array(n), pa.array(_sims(sets, n)), odd, pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "fp", "n", "sim", "parities", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, n long, sim long, parities binary, prefix array<long>")


def shards(prefixes: DataFrame) -> DataFrame:
    """Distinct rows (key, fp) of the keys that more than one set has; of keys with the same sets, as two hashes of their members tell, the least one.

    A key's members are counted where the shuffle brings them together; those of keys with more than about HOT_KEY rows
    are spread by fp as well and counted in parts. Which keys these are is estimated from one set in SHARE; it decides the
    way, never the result.
    """
    own = Window.partitionBy("key")
    member = [F.bit_xor(F.xxhash64("fp", F.lit(i))) for i in range(2)]
    some = prefixes.where(F.pmod(F.xxhash64("fp", F.lit("share")), F.lit(SHARE)) == 0)
    hot = stored(some.groupBy("key").agg((F.count("*") * SHARE).alias("n_key")).where(F.col("n_key") > HOT_KEY).select("key"), "hot-keys")
    any_hot = not hot.isEmpty()
    cold = prefixes.join(hot, "key", "left_anti") if any_hot else prefixes
    marked = cold.repartition("key").distinct().select("key", "fp", F.count("*").over(own).alias("size"), *(m.over(own).alias(f"members_{i}") for i, m in enumerate(member)))
    if any_hot:
        spread = stored(prefixes.join(hot, "key", "left_semi").distinct(), "spread")
        sums = spread.groupBy("key").agg(F.count("*").alias("size"), *(m.alias(f"members_{i}") for i, m in enumerate(member)))
        marked = marked.unionByName(spread.join(sums, "key"))
    several = stored(marked.where("size > 1"), "shared")
    least = several.groupBy("size", "members_0", "members_1").agg(F.min("key").alias("key")).select("key")
    return several.select("key", "fp").join(least, "key", "left_semi")


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parities of its hashes' counts modulo PARITIES, as 64-bit words."""
    out = np.zeros((len(sets), PARITIES // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = np.bincount((s.view(np.uint64) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
        out[i] = np.packbits(odd.astype(bool)).view(np.uint64)
    return out


def shard_links(group: np.ndarray, side: np.ndarray, sim: np.ndarray, n: np.ndarray, parities: np.ndarray, sets: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Pairs of rows that connect all rows of a shard whose sets are alike; without ``sets`` all that may be by their sizes (n) and parities.

    group: numbers from 0, ascending, and in them side; rows of side 1 search the tree of those of side 0, which search
    each other if there are no others.
    """
    a, b = ALIKE
    links: list[tuple[int, int]] = []
    above = list(range(len(sim)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    two = np.zeros(int(group[-1]) + 1, bool)
    two[group[side == 1]] = True
    planted, wanted = np.flatnonzero(side == 0), np.flatnonzero((side == 1) | ~two[group])
    trees, tree_of = Trees(group[planted], sim[planted]), np.full(len(two), -1)
    if len(planted):
        tree_of[group[planted]] = trees.root
    wanted = wanted[tree_of[group[wanted]] >= 0]
    wide = n <= SMALL * b // a  # whatever may be alike to a small set
    label = np.arange(len(sim))
    for radius, queries in ((RADIUS, wanted[~wide[wanted]]), (64, wanted[wide[wanted]])):
        for at in range(0, len(queries), SEARCHES):
            own = queries[at : at + SEARCHES]
            low, high = trees.bounds(label[planted])
            apart = lambda q, node: (low[node] != high[node]) | (low[node] != label[own[q]])  # noqa: B023, E731
            for q, node, _ in trees.search(sim[own], tree_of[group[own]], radius, apart):
                i, j = own[q], planted[node]
                may = (label[i] != label[j]) & (b * np.minimum(n[i], n[j]) >= a * np.maximum(n[i], n[j])) & (two[group[i]] | (j < i))  # else each pair is found from both ends
                i, j = i[may], j[may]
                both = n[i] + n[j]
                may = np.bitwise_count(parities[i] ^ parities[j]).sum(axis=1, dtype=np.int64) <= both - 2 * -(-a * both // (a + b))
                before = len(links)
                for x, y in zip(i[may].tolist(), j[may].tolist(), strict=True):
                    p, r = top(x), top(y)
                    if p == r:
                        continue
                    if sets is not None:
                        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if b * common < a * (len(sets[x]) + len(sets[y]) - common):
                            continue
                    above[max(p, r)] = min(p, r)
                    links.append((x, y))
                if len(links) > before:
                    label = np.array([top(k) for k in range(len(above))])
    return links


def _linked(rows: Callable[[DataFrame | None], DataFrame], light: DataFrame, whole: bool) -> DataFrame:
    """a > b: enough links of sets to connect all that are alike (``whole``, from their hashes) or may be (from n and parities).

    rows: gives key, fp, sim and those columns, of all rows or of given ones (key, fp); light: key and fp of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "low", "high"), AT_ONCE):
            fp, sim, side, group = (table.column(c).to_numpy() for c in ("fp", "sim", "side", "group"))
            if whole:
                sets = [x.values.to_numpy() for x in table.column("hashes").combine_chunks()]
                n, odd = np.array([len(x) for x in sets], np.int64), _parities(sets)
            else:
                sets, n = None, table.column("n").to_numpy()
                odd = np.frombuffer(b"".join(table.column("parities").to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
            links = np.array(shard_links(group, side, sim, n, odd, sets), np.int64).reshape(-1, 2)
            one, other = fp[links[:, 0]], fp[links[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], names=["a", "b"])

    return linked(rows, light, ["key"], "fp", lambda dealt: dealt.mapInArrow(run, "a long, b long"), HOT)


def _map_of(ids: DataFrame) -> np.ndarray:
    """The map of the doc_ids, sized by their number."""
    size = _map_bits(ids.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_spread(batch.column(0).to_numpy(), size)] = True
        words = np.packbits(bits).view(np.int64)
        place = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words[place])], names=["place", "word"])

    out = np.zeros(size // 64, np.int64)
    for batch in ids.select("doc_id").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint8)


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and component_id (smallest doc_id of the connected documents) of each row with a doc_id.

    Documents are connected whose sets of shingles have a Jaccard similarity of 4/5 or more, also through others; texts
    without words are alike. Sets are made twice, for their prefixes and for the check, as those of all would take more
    room than the texts; a third time for groups of more than HOT sets that aren't connected in the first blocks. A map says which documents may be alike to others, so that texts aren't shuffled; what it lets pass
    beyond them (one in nine, and more beyond MOST_BITS / BITS_EACH documents) is dropped by the join.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    known = stored(prints_and_prefixes(docs, _frequent(docs, shingle), shingle), "prints")
    dealt = stored(shards(known.select(F.explode("prefix").alias("key"), "fp")), "shards")
    marks = known.select("fp", "n", "sim", "parities").dropDuplicates(["fp"])
    marked = lambda only: (dealt if only is None else only).join(marks, "fp")
    near = checkpointed(components(_linked(marked, dealt, False)).select(F.col("id").alias("fp"), F.col("component").alias("key")))

    def own(only: DataFrame | None) -> DataFrame:
        wanted = near if only is None else only
        used = checkpointed(known.select("doc_id", "fp").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
        return shingle_sets(docs, shingle, _map_of(used)).select("fp", "sim", "hashes").join(wanted, "fp").dropDuplicates(["fp"])

    labels = components(_linked(own, near, True)).select(F.col("id").alias("fp"), F.col("component").alias("label"))
    prints = known.select("doc_id", "fp").join(labels, "fp", "left").select("doc_id", F.coalesce("label", "fp").alias("label"))
    return prints.join(prints.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without those whose document is connected to one of smaller doc_id.

    doc_id is the key: rows that repeat one stay or go together, and rows without one stay.
    """
    gone = near_copies(docs, shingle).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
