"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws an exponential
number from the hash of the row's id and its own name, divided by its weight (the sum of
the shards below it); the least draw wins. So a child gets its share of the weight, and a
change of one weight moves rows only into or out of that child: what the other subtrees
decide below does not change. ``grow`` adds a shard as a region of its own, so all rows
that move at all move into the new shard.

Nothing but the id and the tree decides; equal ids (and null ids) share a shard. A null
text has no bytes and the checksum of the empty text. Slots number the rows of a shard
from 0 without gaps, in buckets, so that no task holds a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that each row takes besides its text.
OVERHEAD = 16
#: Rows that one task numbers at once, about, and buckets of a shard at least.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 8

#: A leaf of the tree: region, rack, shard, weight.
Leaf = tuple[str, str, int, float]


def even_tree(shards: int, rack: int = 4, racks: int = 2) -> list[Leaf]:
    """A tree of equal shards: ``rack`` shards in a rack, ``racks`` racks in a region."""
    return [(f"region{s // (rack * racks)}", f"rack{s // rack}", s, 1.0) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, which takes rows only into itself."""
    shard = max(leaf[2] for leaf in tree) + 1
    return [*tree, (f"grown{shard}", f"grown{shard}", shard, weight)]


def _children(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level the children of every node, by path, with their weights."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in tree:
        path = ""
        for level in range(3):
            below = levels[level].setdefault(path, {})
            below[str(leaf[level])] = below.get(str(leaf[level]), 0.0) + leaf[3]
            path = f"{path}/{leaf[level]}"
    return levels


def place(key: Column, tree: list[Leaf], seed: int = 1) -> Column:
    """The shard of a key: at each level the child with the least draw. Shards of weight 0
    get nothing. The tree is a constant of the plan, a map from each path to its children."""
    path = F.lit("")
    for children in _children([x for x in tree if x[3] > 0]):
        known = F.create_map(
            *[
                x
                for node, below in children.items()
                for x in (F.lit(node), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in below.items()]))
            ]
        )

        def drawn(parent: Column):
            def of(child: Column) -> Column:
                bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), parent, child["name"], key), 11)
                uniform = (bits.cast("double") + 0.5) / float(2**53)
                return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["name"].alias("name"))

            return of

        step = F.transform(F.array(path), lambda p: F.concat(p, F.lit("/"), F.array_min(F.transform(F.element_at(known, p), drawn(p)))["name"]))
        path = step.getItem(0)
    return F.element_at(F.split(path, "/"), -1).cast("int")


def assign_shards(docs: DataFrame, tree: list[Leaf] | None = None, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text and any others) with size, text_crc32, law, shard, slot and
    grown_shard; columns of these names are replaced."""
    tree = tree or even_tree(40)
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = [c for c in docs.columns if c not in added]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"d_{c}") for c in own],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"),
        place(F.col("doc_id"), tree, seed).alias("shard"),
        place(F.col("doc_id"), grow(tree), seed).alias("grown_shard"),
    )
    shards = len(tree)
    buckets = max(LEAST_BUCKETS, -(-docs.count() // (shards * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("d_doc_id", "text_crc32", "size", F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("d_doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1).join(counts, ["shard", "bucket"])
    return numbered.select(
        *[F.col(f"`d_{c}`").alias(c) for c in own],
        "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("number")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots within each file."""
    assigned.repartition("shard", F.floor(F.col("slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
