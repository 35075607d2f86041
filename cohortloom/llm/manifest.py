"""Merkle manifest of a dataset: a tree of hashes per language, one root, a proof for every row.

A node is the hash of up to eight consecutive nodes. The nodes of an aligned block
stand together as one string of 64 hexadecimal digits a node; each level is such a
string, its parents are hashes of fixed-width substrings, and what flanks a node in
its run are the siblings of the proof. Roots of blocks are the leaves of the next
round, so a block never holds more than BLOCK nodes, whatever the size of a language.

Edge cases: null cells count as ``-`` (an empty text is ``0:``), an empty table gives
no row. Leaves of one doc_id are ordered by hash, null ids come first. Equal rows are
leaves of their own, next to each other. Columns other than the five hashed ones are
not read and cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import written

FAN, WIDTH, LEVELS = 8, 64, 3
#: Nodes of a block: LEVELS levels stand between them and its root.
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(cells: list[Column]) -> Column:
    """SHA-256 of the cells: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cells]
    return F.sha2(F.concat(*told), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (g, ...) with pos, the place from 0 inside the group g in the given order (nulls first).

    Range partitions are counted and numbered apart, so no task orders a whole group;
    rows of equal order are parted too, by an arbitrary number.
    """
    keyed = nodes.withColumn("_tie", F.monotonically_increasing_id())
    # the partitioning is kept in a table: a second run of the stage may draw other bounds
    placed = written(keyed.repartitionByRange("g", *order, "_tie").withColumn("_part", F.spark_partition_id()), "manifest-order")
    counts = placed.groupBy("_part", "g").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.col("g").alias("_g"), F.coalesce(before, F.lit(0)).alias("_before"))
    local = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_part", "g").orderBy(*order, "_tie")))
    joined = local.join(offsets, (local["_part"] == offsets["_part"]) & local["g"].eqNullSafe(offsets["_g"]))
    return joined.select(*nodes.columns, (F.col("_before") + F.col("_k") - 1).alias("pos"))


def parents(level: Column) -> Column:
    """The next level's string: a hash of every FAN nodes of this one."""
    wide = FAN * WIDTH
    starts = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / wide).cast("int"))
    return F.array_join(F.transform(starts, lambda k: F.sha2(F.substring(level, k * wide + 1, F.lit(wide)), 256)), "").cast("binary")


def flanks(level: Column, place: Column) -> Column:
    """(left, right) strings of the siblings that stand before and after the node at ``place`` of a level."""
    inside = F.pmod(place, F.lit(FAN)).cast("int")
    piece = lambda first, nodes: F.substring(level, (first * WIDTH + 1).cast("int"), nodes * WIDTH).cast("string")
    return F.struct(piece(place - inside, inside).alias("left"), piece(place + 1, F.lit(FAN - 1) - inside).alias("right"))


def forest(nodes: DataFrame, payload: list[str], most: int) -> DataFrame:
    """Blocks (g, nodes array, depth, level0.., above, root) of nodes (g, pos, n, node, *payload).

    n is the number of nodes of the group, most the largest n. above lists the
    siblings of the block's own root, level by level up to the root of the group.
    """
    blocks = (
        nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
        .groupBy("g", "block")
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("nodes"))
    )
    depth = reduce(lambda rest, k: F.when(F.col("n") <= FAN**k, k).otherwise(rest), reversed(range(LEVELS)), F.lit(LEVELS))
    blocks = blocks.withColumn("depth", depth).withColumn("level0", F.array_join("nodes.node", "").cast("binary"))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("depth") > k, parents(F.col(f"level{k}"))))
    tops = F.element_at(F.array(*[F.col(f"level{k}") for k in range(LEVELS + 1)]), F.col("depth") + 1).cast("string")
    blocks = written(blocks.withColumn("top", tops), "manifest-blocks")
    if most <= BLOCK:
        return blocks.withColumn("above", F.array().cast("array<struct<left: string, right: string>>")).withColumn("root", F.col("top"))
    tops = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"), F.col("block").alias("member"))
    over = members(forest(tops, ["member"], -(-most // BLOCK)), ["member"])
    over = over.select(F.col("g").alias("_g"), F.col("member").alias("_block"), F.col("flanks").alias("above"), "root")
    return blocks.join(over, blocks["g"].eqNullSafe(over["_g"]) & (blocks["block"] == over["_block"])).drop("_g", "_block")


def members(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """(g, node, *payload, flanks, root) of every node of the blocks; flanks are its siblings, level by level up to the root."""

    def proven(x, k):
        own = F.array(*[flanks(F.col(f"level{j}"), F.floor(k / FAN**j)) for j in range(LEVELS)])
        return F.struct(*[x[c].alias(c) for c in ("node", *payload)], F.concat(F.slice(own, F.lit(1), F.col("depth")), F.col("above")).alias("flanks"))

    return blocks.select("g", "root", F.explode(F.transform("nodes", proven)).alias("x")).select("g", "x.*", "root")


def climbed(start: Column, siblings: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(siblings, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def build_manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof array, tampered_leaf) of every row of docs.

    proof: (left, right) siblings level by level through the group's root to the root.
    tampered: what stands in for text where the row is to be checked against its proof.
    """
    cells = {c: F.col(f"`{c}`") for c in FIELDS}
    leaf = leaf_hash(list(cells.values()))
    other = leaf if tampered is None else leaf_hash([*list(cells.values())[:-1], tampered])
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("g"), cells["doc_id"].alias("doc_id"), leaf.alias("node"), F.when(other != leaf, other).alias("tampered"))
    placed = numbered(leaves, ["doc_id", "node"])
    sizes = placed.groupBy("g").agg((F.max("pos") + 1).alias("n"))
    sizes = written(sizes, "manifest-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    placed = placed.join(sizes.withColumnRenamed("g", "_g"), placed["g"].eqNullSafe(F.col("_g"))).drop("_g")
    blocks = forest(placed, ["doc_id", "tampered"], most)
    # the groups' roots are the leaves of one more tree
    roots = blocks.groupBy("g").agg(F.first("root").alias("node")).select(F.lit(0).alias("g"), F.col("g").alias("name"), "node")
    count = sizes.count()
    over = members(forest(numbered(roots, ["name"]).withColumn("n", F.lit(count).cast("long")), ["name"], count), ["name"])
    over = over.select("name", F.col("flanks").alias("rest"), F.col("root").alias("top_root"))
    joined = blocks.join(over, blocks["g"].eqNullSafe(over["name"])).drop("name").withColumn("above", F.concat("above", "rest"))
    rows = members(joined.withColumn("root", F.struct(F.col("root").alias("subroot"), F.col("top_root").alias("root"))), ["doc_id", "tampered"])
    return rows.select("doc_id", F.col("node").alias("leaf"), "root.subroot", "root.root", F.col("flanks").alias("proof"), F.coalesce("tampered", "node").alias("tampered_leaf"))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every third row (by crc32 of its id) is checked with its text in lower case."""
    checked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    text = F.when(checked, F.translate(F.col("text"), UPPER, LOWER)).otherwise(F.col("text"))
    rows = build_manifest(docs, tampered=text)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = climbed(F.col("tampered_leaf"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
