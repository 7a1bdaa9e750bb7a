"""Operator 12: a Merkle manifest of a dataset, built bottom-up, with proofs pushed top-down.

Leaves get a place in their language by ranges of their order. Each level is a stored table in which a row has the digests
of its children, so that the way up is one grouping a level and the way down one join a level of parents to their own
proofs: every child puts its siblings before the proof that its parent hands down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Children of a node.
FAN = 8
#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings on the left and on the right of a node, level by level.
PROOF = "array<struct<left: string, right: string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a document's fields; all of FIELDS have to be there."""
    return F.sha2(F.concat(*(encoded(fields[c]) for c in FIELDS)), 256)


def lowered(text: Column) -> Column:
    """A-Z made a-z."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows, stored, with ``idx`` (place in the group from 0, by ``order``) and ``n`` (rows of the group).

    Rows are dealt out by ranges of group and order, with the row's number in the input as the last key, so that neither
    a large group nor rows that are all equal go to one task. A range then knows the places of its rows as soon as it
    is known how many rows of the group the ranges before it have: one row for each range and group.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = rows.withColumn("m_row", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("m_row").asc())
    ranged = dealt.sortWithinPartitions(*keys, F.col("m_row").asc()).drop("m_row").withColumns({"m_range": F.spark_partition_id(), "m_at": F.monotonically_increasing_id()})
    kept = stored(ranged, name)
    before = Window.partitionBy(group).orderBy("m_range")
    counts = kept.groupBy("m_range", group).agg(F.count(F.lit(1)).alias("m_n"), F.min("m_at").alias("m_first"))
    starts = counts.select(
        F.col("m_range").alias("s_range"), F.col(group).alias("s_group"), (F.sum("m_n").over(before) - F.col("m_n") - F.col("m_first")).alias("m_shift"), F.sum("m_n").over(Window.partitionBy(group)).alias("n")
    )
    joined = kept.join(starts, (F.col("m_range") == F.col("s_range")) & (F.col(group) == F.col("s_group")))
    return joined.withColumn("idx", F.col("m_at") + F.col("m_shift")).drop("m_range", "m_at", "s_range", "s_group", "m_shift")


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The levels above ``nodes`` (g, idx, n, hash), each stored; the last has no group of more than one node.

    Rows: g, idx, n (nodes of the group at this level), hash and ``children``, the digests below in order. A group ends at
    the level where it has one node left.
    """
    levels, last = [], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        parents = last.where("n > 1").groupBy("g", F.floor(F.col("idx") / FAN).cast("long").alias("up"), F.ceil(F.col("n") / FAN).cast("long").alias("up_n")).agg(run.alias("children"))
        last = stored(parents.select("g", F.col("up").alias("idx"), F.col("up_n").alias("n"), F.sha2(F.array_join("children", ""), 256).alias("hash"), "children"), f"{name}-{len(levels) + 1}")
        levels.append(last)
        most = -(-most // FAN)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """g and hash of the one node that remains of each group."""
    found = nodes.where("n = 1").select("g", "hash")
    for level in levels:
        found = found.unionAll(level.where("n = 1").select("g", "hash"))
    return found


def _sibling(children: Column, at: Column) -> Column:
    one = at.cast("int")
    return F.struct(F.array_join(F.slice(children, 1, one), "").alias("left"), F.array_join(F.slice(children, one + 2, F.greatest(F.size(children) - one - 1, F.lit(0))), "").alias("right"))


def push(nodes: DataFrame, levels: list[DataFrame], base: DataFrame, name: str) -> DataFrame:
    """``nodes`` with what ``base`` (g, top, proof: one row for each group) hands down: top, and proof with their own siblings before it.

    base: ``top`` is any column that all nodes of a group share.
    """
    inherited = None
    for depth in range(len(levels), 0, -1):
        level = levels[depth - 1].select("g", "idx", "n", "children")
        known = level.where("n = 1").join(base, "g")
        if inherited is not None:
            known = known.unionByName(level.where("n > 1").join(inherited, ["g", "idx"]))
        known = known.select("g", "idx", "children", "top", "proof")
        if depth == 1:
            inherited = known
        else:
            child = known.select("g", F.col("idx").alias("above"), "top", "proof", "children", F.posexplode("children").alias("at", "own"))
            inherited = stored(child.select("g", (F.col("above") * FAN + F.col("at")).alias("idx"), "top", F.concat(F.array(_sibling(F.col("children"), F.col("at"))), F.col("proof")).alias("proof")), f"{name}-{depth}")
    lone = nodes.where("n = 1").join(base, "g")
    if inherited is None:
        return lone
    above = inherited.withColumnsRenamed({"idx": "above"})
    inner = nodes.where("n > 1").withColumn("above", F.floor(F.col("idx") / FAN).cast("long")).join(above, ["g", "above"])
    own = F.concat(F.array(_sibling(F.col("children"), F.col("idx") % FAN)), F.col("proof"))
    return lone.unionByName(inner.withColumn("proof", own).select(*lone.columns))


def folded(start: Column, proof: Column) -> Column:
    """The digest at the root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root and verified of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    tampered: true where the text is read back with A-Z made lower case, before its leaf is folded with the original
    siblings; by default no text is. ``proof`` has the siblings level by level, as struct of left and right digests.

    Null fields are encoded as such; null languages are one group, which comes first. Within a language rows ascend by doc_id
    (null first), rows of one doc_id by their leaf. Rows that repeat are leaves of their own. An empty text differs from a
    null one. Further columns of ``docs`` are ignored; no rows give no rows.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    marked = docs.select(*FIELDS, changed.alias("changed"))
    other = F.when(F.col("changed"), leaf(fields | {"text": lowered(F.col("text"))}))
    # groups are strings that are never null, so that joins find them: "-" comes before all that start with "="
    group = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang")))
    leaves = placed(marked.select("doc_id", group.alias("g"), leaf(fields).alias("hash"), other.alias("other")), "g", ["doc_id", "hash"], "leaves")
    levels = build(leaves, "level")
    # the tree over subroots has one group
    subroots = placed(tops(leaves, levels).select(F.lit("").alias("g"), F.col("g").alias("lang_key"), "hash"), "g", ["lang_key"], "subroots")
    over = build(subroots, "over")
    root = tops(subroots, over).select("g", F.col("hash").alias("top"), F.array().cast(PROOF).alias("proof"))
    base = push(subroots, over, root, "over-proofs").select(F.col("lang_key").alias("g"), F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"), "proof")
    proofs = push(leaves, levels, stored(base, "subroot-proofs"), "proofs")
    found = proofs.select("doc_id", F.col("hash").alias("leaf"), "top.subroot", "top.root", "proof", folded(F.coalesce(F.col("other"), F.col("hash")), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def digests(proved: DataFrame) -> DataFrame:
    """The rows of ``manifest`` with the digest of all siblings, from the leaf to the root, in place of the proof."""
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")
