"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups' roots.

Rows are numbered within their group by a global sort and prefix counts. On every level a node is joined with its
siblings by computed places (XOR with 1 for two a run, offsets of the slot otherwise), and the nodes at slot zero emit
the parents, so a level is a plain equi-join on (tree, place) that no large group can skew. Each level is written to
the shared folder, which also is what a lost executor starts again from. Proofs are then handed down level by level:
a node's proof is its siblings, and after them the proof of its parent.

A hash is that of its inputs one after another, digests as lowercase hex text. A field is `-` if null, otherwise its
length in UTF-8 bytes, a colon and the value as a string. A run at a level's end may be short, even a single node; what
is alone in its tree is the root.

Cases: rows of one group and one order value come in the order of their leaves; a null order value comes first, and the
null group before all others; groups are ordered by their UTF-8 bytes; a table without rows has no root and no proofs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_IN_PARTITION = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a partition
_PROOF = "array<struct<slot:int,siblings:array<string>>>"


def leaf(*fields: Column) -> Column:
    """The hash of a row's fields."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(own: Column, level: Column) -> Column:
        slot, others = level["slot"], level["siblings"]
        return F.sha2(F.concat(F.array_join(F.slice(others, 1, slot), ""), own, F.array_join(F.slice(others, slot + 1, F.size(others)), "")), 256)

    return F.aggregate(proof, start, step)


def siblings_hash(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda x: x["siblings"])), ""), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows(tree, ...) with `at`, the place of a row in its tree from 0 by `order`, and `size`, the rows of the tree."""
    keys = ["tree", *order]
    spread = rows.withColumn("apart", F.monotonically_increasing_id())  # equal rows may be dealt to several tasks
    ordered = shared.cut(spread.repartitionByRange(*keys, "apart").sortWithinPartitions(*keys, "apart").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    # one row for each part of a tree: as many as there are partitions and trees
    counts = ordered.groupBy("tree", "part").agg(F.count("*").alias("many"), F.min("row").alias("first"))
    counts = counts.selectExpr("tree", "part", "first", "sum(many) OVER (PARTITION BY tree ORDER BY part) - many AS before", "sum(many) OVER (PARTITION BY tree) AS size")
    return ordered.join(counts, ["tree", "part"]).withColumn("at", F.expr("before + row - first")).drop("part", "row", "first", "before", "apart")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes(tree, at, hash, ...) with `siblings`, the hashes of the other nodes of the run from left to right."""
    out, slot = nodes, F.col("at") % arity
    for k in range(1, arity):
        there = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + k) % arity
        other = nodes.select(F.col("tree").alias("tree_k"), F.col("at").alias("at_k"), F.col("hash").alias(f"hash_{k}"))
        out = out.withColumn("there", there).join(other, F.expr("tree = tree_k AND there = at_k"), "left").drop("tree_k", "at_k", "there")
    # by slot: what follows a node in its run and then, wrapped around, what stands before it
    after = [F.when(slot + k < arity, F.col(f"hash_{k}")) for k in range(1, arity)]
    before = [F.when(slot + k >= arity, F.col(f"hash_{k}")) for k in range(1, arity)]
    return out.withColumn("siblings", F.array_compact(F.array(*before, *after))).drop(*(f"hash_{k}" for k in range(1, arity)))


def levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from the leaves(tree, at, size, hash, ...) on, each with siblings, without nodes that are
    alone in their tree; and those, the roots(tree, height, hash)."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    roots, out, height = nodes.where("size = 1").selectExpr("tree", "0 AS height", "hash"), [], 0
    while largest > 1:
        out.append(shared.cut(with_siblings(nodes.where("size > 1"), arity)))
        parents = out[-1].where(F.col("at") % arity == 0)
        nodes = parents.select("tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), F.sha2(F.concat("hash", F.array_join("siblings", "")), 256).alias("hash"))
        largest, height = -(-largest // arity), height + 1
        roots = roots.union(nodes.where("size = 1").select("tree", F.lit(height).alias("height"), "hash"))
    return out, roots


def handed_down(found: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame | None:
    """The lowest level with `proof` and the columns of tops(tree, height, proof, ...), the roots' own proofs; None if
    there is no level."""
    above = None
    for height in range(len(found), 0, -1):
        own = tops.where(F.col("height") == height).drop("height").withColumn("at", F.lit(0).cast("long"))
        above = own if above is None else above.unionByName(own)
        level = found[height - 1] if height == 1 else found[height - 1].select("tree", "at", "siblings")
        parent = above.withColumnsRenamed({"tree": "tree_p", "at": "at_p", "proof": "proof_p"})
        slot = (F.col("at") % arity).cast("int").alias("slot")
        above = level.join(parent, F.expr(f"tree = tree_p AND at div {arity} = at_p")).withColumn("proof", F.concat(F.array(F.struct(slot, "siblings")), "proof_p")).drop("tree_p", "at_p", "proof_p", "siblings")
    return above


def proved(rows: DataFrame, leaf: Column, order: str = "doc_id", group: str = "lang", keep: Sequence[str | Column] = ("doc_id",), arity: int = 2) -> DataFrame:
    """The columns `keep` of rows, and leaf, subroot (of the group's tree), root and proof (an array of slot and siblings
    for each level, from the leaf to the root)."""
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    narrow = shared.cut(rows.select(tree.alias("tree"), F.col(order).alias("key"), leaf.alias("hash"), F.struct(*keep).alias("kept")))
    leaves = shared.cut(numbered(narrow, ["key", "hash"]).drop("key"))
    found, roots = levels(leaves, arity)
    roots = shared.cut(roots)
    upper, top = levels(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("height").alias("of_height"), "hash"), ["of"]), arity)
    top = top.first()
    tops = _group_tops(roots, upper, arity)
    down = handed_down(found, tops, arity)
    alone = leaves.where("size = 1").join(tops.where("height = 0"), "tree").select("kept", "hash", "subroot", "proof")
    out = alone if down is None else alone.unionByName(down.select("kept", "hash", "subroot", "proof"))
    names = narrow.schema["kept"].dataType.names
    return out.select(*(F.col("kept")[c].alias(c) for c in names), F.col("hash").alias("leaf"), "subroot", F.lit(top and top["hash"]).cast("string").alias("root"), "proof")


def _group_tops(roots: DataFrame, upper: list[DataFrame], arity: int) -> DataFrame:
    """(tree, height, subroot, proof) of each group: where its root stands in the tree over all groups."""
    start = F.array().cast(_PROOF)
    if not upper:
        return roots.select("tree", "height", F.col("hash").alias("subroot"), start.alias("proof"))
    whole = roots.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(len(upper)).alias("height"), start.alias("proof"))
    return shared.cut(handed_down(upper, whole, arity).select(F.col("of").alias("tree"), F.col("of_height").alias("height"), F.col("hash").alias("subroot"), "proof"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, order: str = "doc_id", group: str = "lang", arity: int = 2) -> DataFrame:
    """(order, group, leaf, subroot, root, proof) of every row of docs."""
    return proved(docs, leaf(*map(F.col, fields)), order, group, (order, group), arity)
