"""A Merkle tree over a table, and a proof for each row.

Rows are ranked within their group, and the binary digits of a rank are the way from the
root of the group down to the row. The lowest digits number the rows of a block of 2^BITS
rows, which meets in one task by one shuffle; there the digits are grouped away one after
the other, the lowest first (fewer digits, where fewer are left), and each node keeps the structs of its children. What is left
of a block is one struct that nests the whole subtree. The roots of the blocks are rows
again, of which a block is made in turn, until a group has one row. Then the way goes
down: a transform over the nested structs writes the proof of every child, and an explode
makes them rows; a block gets the proof of its root by grouping, so there is no join on the
way up or down. Nothing but a block is held in one place, whatever the size of a group.

A run is ``ARITY`` = 2 nodes; a last run may have one, which is hashed as well. The digest
of a run is the SHA-256 of the digests in it, as lowercase hex.

Order: rows by the columns of ``order``, nulls first, then by leaf, then by place in the
input, so rows with equal ids have a defined order and equal rows give equal digests in any
order. Null and empty texts have leaves of their own (``-`` and ``0:``). An empty table has
no rows and no root. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, materialize, with_row_key

#: Binary digits of the ranks in a block.
BITS = 9
#: Each of so many documents is tampered with in the query, by the checksum of its id.
TAMPERED = 7

PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its bytes in UTF-8, counted."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their rank from 0 in their group and its size n.

    They are dealt out by ranges and written; the counts of the ranges meet, not the rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # such numbers hold the partition above 33 bits with the place in it
    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    dealt = materialize(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    keys = [F.col(c).alias(f"k_{c}") for c in group]
    counts = dealt.groupBy("part", *group).agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("begin"))
    whole = Window.partitionBy(*group)
    counts = counts.select(
        F.col("part").alias("k_part"), *keys,
        (F.sum("size").over(whole.orderBy("part")) - F.col("size") - F.col("begin")).alias("offset"), F.sum("size").over(whole).alias("n"),
    )
    same = F.col("part") == F.col("k_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    joined = dealt.join(counts, same)
    return joined.select(*rows.columns, (F.col("offset") + F.col("place")).alias("rank"), "n")


def _levels(n: Column) -> Column:
    """How often the nodes of a group are halved until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _roll_up(nodes: DataFrame, group: list[str], first: int, width: int) -> DataFrame:
    """Blocks of nodes (group, rank, levels, h and others in ``own``): group, rank of the
    block, levels, h of its root and its nested children. ``first`` is the level of the nodes,
    ``width`` the number of binary digits in a block."""
    bits = [f"bit{k}" for k in range(width)]
    rows = nodes.select(
        *group, "levels", F.shiftright("rank", width).alias("block"), *[F.shiftright("rank", k).bitwiseAND(1).cast("int").alias(b) for k, b in enumerate(bits)],
        F.struct("h", "own").alias("node"),
    )
    rows = rows.repartition(*group, "block")  # which the groupings below need no more
    for k, bit in enumerate(bits):
        keys = [*group, "levels", "block", *bits[k + 1 :]]
        run = F.sort_array(F.collect_list(F.struct(F.col(bit).alias("bit"), "node")))
        rows = rows.groupBy(*keys).agg(F.transform(run, lambda x: x["node"]).alias("run"))
        digests = F.transform("run", lambda x: x["h"])
        # above the root of a small group there are no more runs
        digest = F.when(F.col("levels") > first + k, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0])
        rows = rows.select(*keys, F.struct(digest.alias("h"), F.col("run")).alias("node"))
    return rows.select(*group, "levels", F.col("block").alias("rank"), "node.h", F.col("node.run").alias("run"))


def _proofs(run: Column, path: Column, levels: Column, level: int, left: int) -> Column:
    """The structs ``own`` of all nodes ``left`` levels below a run, each with its proof."""

    def of(child: Column, at: Column) -> Column:
        others = F.transform(run, lambda x: x["h"])
        step = F.struct(
            F.array_join(F.slice(others, F.lit(1), at), "").alias("before"),
            F.array_join(F.slice(others, at + 2, F.lit(2)), "").alias("after"),
        )
        longer = F.concat(F.when(levels > level, F.array(step)).otherwise(F.array().cast(PATH)), path)
        if not left:
            return F.array(F.struct(child["own"].alias("own"), child["h"].alias("h"), longer.alias("path")))
        return _proofs(child["run"], longer, levels, level - 1, left - 1)

    return F.flatten(F.transform(run, of))


def _explode_proofs(blocks: DataFrame, roots: DataFrame, group: list[str], first: int, width: int) -> DataFrame:
    """The nodes of blocks with their paths, given the paths of the blocks' roots (group,
    rank, path, top)."""
    kept = ["levels", "run"]
    sides = blocks.select(*group, "rank", *kept, F.lit(None).cast(PATH).alias("path"), F.lit(None).cast(roots.schema["top"].dataType).alias("top"))
    told = roots.select(*group, "rank", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in kept], "path", "top")
    met = sides.unionByName(told).groupBy(*group, "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*kept, "path", "top")])
    proofs = _proofs(F.col("run"), F.col("path"), F.col("levels"), first + width - 1, width - 1)
    rows = met.select(*group, "top", F.explode(proofs).alias("x"))
    return rows.select(*group, "top", "x.own", "x.h", "x.path")


def tree(nodes: DataFrame, group: list[str], tops: DataFrame | None = None, climb=None) -> DataFrame:
    """Proofs of nodes (group, rank, n, h, own): group, own, h, top (the digest of their
    group) and path, from the node to the top, an array of what stands before and after in
    each run. ``climb`` turns the roots of the groups (group, h) into group, path and top of
    a tree above them, by which all paths go on."""
    nodes = nodes.withColumn("levels", _levels(F.col("n"))).drop("n")
    first, rounds = 0, []
    most = nodes.agg(F.max("levels")).first()[0] or 0
    while not rounds or first < most:
        width = max(1, min(BITS, most - first))
        rounds.append((first, width, materialize(_roll_up(nodes, group, first, width))))
        nodes = rounds[-1][-1].select(*group, "levels", "rank", "h", F.struct(F.col("rank")).alias("own"))
        first += width
    paths = climb(nodes) if climb else nodes.select(*group, F.col("h").alias("top"), F.array().cast(PATH).alias("path"))
    paths = paths.withColumn("rank", F.lit(0).cast("long"))
    for first, width, blocks in rounds[::-1]:
        paths = _explode_proofs(blocks, paths, group, first, width)
        if first:
            paths = paths.withColumn("rank", F.col("own.rank")).drop("own", "h")
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The digest that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def merkle_manifest(rows: DataFrame, columns: list[str], group: str, order: str) -> DataFrame:
    """Leaves of ``columns``, trees per value of ``group`` in ascending ``order``, and a tree
    of their roots in ascending order of the group. Returns the columns, leaf, subroot, root
    and proof, an array from the leaf up of ``before`` and ``after``, the digests that stand
    left and right of the own one in its run (empty strings, if alone)."""
    keyed = with_row_key(rows.select(*dict.fromkeys([*columns, group, order])))
    digest = leaf(*[F.col(c) for c in columns]).alias("h")
    narrow = keyed.select(F.col(group).alias("g"), F.col(order).alias("o"), digest, ROW, F.struct(*columns).alias("own"))
    return manifest_of(narrow, ["g"], ["o", "h", ROW])


def manifest_of(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``own``, leaf, subroot, root and proof of nodes (group, order, h, own)."""
    one = ["one"]

    def climb(roots: DataFrame) -> DataFrame:
        named = roots.select(F.lit(0).alias("one"), *group, "h", F.struct(*group, F.col("h").alias("subroot")).alias("own"))
        above = tree(ranked(named, one, group).select("one", "rank", "n", "h", "own"), one)
        return above.select("own.*", "path", "top").select(*group, "path", F.struct("subroot", F.col("top").alias("root")).alias("top"))

    placed = ranked(nodes, group, order).select(*group, "rank", "n", "h", "own")
    found = tree(placed, group, climb=climb)
    return found.select("own", F.col("h").alias("leaf"), "top.subroot", "top.root", F.col("path").alias("proof"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of documents, with proofs tried on rows that were changed.

    A row is tampered with if seven divides the checksum of its id; then n_chars is one more.
    A null id is left alone, and a null n_chars can't be told apart from itself."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = with_row_key(docs.select(*columns))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    changed = leaf(*[F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in columns])
    own = F.struct("doc_id", F.when(tampered, changed).alias("changed"))
    nodes = rows.select(F.col("lang").alias("g"), F.col("doc_id").alias("o"), leaf(*map(F.col, columns)).alias("h"), ROW, own.alias("own"))
    found = manifest_of(nodes, ["g"], ["o", "h", ROW])
    folded = fold(F.coalesce("own.changed", "leaf"), F.col("proof"))
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["before"], x["after"])), "")
    out = found.select("own.doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
