"""Merkle manifest of a table by cogrouped subtree exchange.

Leaves of a tree (one per language) are numbered in order; ``width`` = arity ** ``LEVELS``
consecutive nodes are a superblock. Up: every superblock is reduced to one node by itself, the nodes
of all superblocks are the leaves of the next, 512 times smaller round, until each tree has one
node; the subroots are the leaves of one last tree. Down: from the top round to the leaves,
the nodes of a round are cogrouped by superblock with the one outer node that the round above
made for it, which carries the siblings on its way to the root. Inside ``applyInPandas`` a superblock is
reduced once more, the siblings inside it are joined to the outer ones, and, for the leaves,
the tampered or original leaf is folded with them to a root.

A group has at most 512 rows of digests, however large a language is; texts are hashed where
they are read and never shuffled. The number of rounds follows the logarithm of the rows, and
all that reaches the driver is the number of rounds.
"""

from __future__ import annotations

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import kept, partitions

ARITY = 8
#: Levels of a superblock, which so has 512 nodes at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUTER = "tree string, pos long, path string, subroot string, root string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    """Lower-case hex SHA-256 of the digests' hex texts one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v).cast("binary") for v in values]), 256)


def depth(n: int, arity: int = ARITY) -> int:
    """Levels above n nodes until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // arity), found + 1
    return found


def reduce_block(nodes: list[str], levels: int, arity: int = ARITY) -> list[list[str]]:
    """The nodes of a block on each level, from the given ones upwards."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest(last[k : k + arity]) for k in range(0, len(last), arity)])
    return out


def siblings(stack: list[list[str]], at: int, arity: int = ARITY) -> list[tuple[int, list[str]]]:
    """(place in its run, the run's other nodes) on each level of a block below its top, for the node ``at``."""
    out = []
    for level in stack[:-1]:
        run = at // arity * arity
        out.append((at - run, level[run:at] + level[at + 1 : run + arity]))
        at //= arity
    return out


def write_path(steps: list[tuple[int, list[str]]]) -> str:
    """A way upwards as text: levels apart by ``/``, each its place, ``:`` and the siblings of 64 digits each."""
    return "/".join([f"{place}:{''.join(others)}" for place, others in steps])


def fold(leaf: str, path: str) -> str:
    """The root that a leaf gives with the siblings of a path."""
    for step in path.split("/") if path else []:
        place, _, others = step.partition(":")
        cut = 64 * int(place)
        leaf = hashlib.sha256((others[:cut] + leaf + others[cut:]).encode()).hexdigest()
    return leaf


def proof(path: str) -> str:
    """SHA-256 of all siblings of a path."""
    return digest([step.partition(":")[2] for step in path.split("/")] if path else [])


def join_paths(inner: str, outer: str) -> str:
    return f"{inner}/{outer}" if inner and outer else inner or outer


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos`` (place in its tree, from 0) and ``n`` (nodes of the tree).

    Rows are dealt into sorted ranges and stored with the partition's own running number, which orders
    them; a tree's rows in earlier ranges come from a table of counts, one row per tree and range.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
    stored = kept(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), spark)
    group = Window.partitionBy(tree)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = sizes.select(
        tree, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n")
    )
    return stored.join(offsets, [tree, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def blocks(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes dealt by superblock; the number of partitions is the session's, whatever the bytes."""
    cut = nodes.withColumn("block", F.floor(F.col("pos") / width))
    return cut.repartition(partitions(nodes.sparkSession), "tree", "block")


def up(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """The next round: (tree, pos, n, node) of the superblocks' tops."""
    width = arity**levels

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        nodes, n = group.sort_values("pos")["node"].tolist(), int(group["n"].iloc[0])
        top = reduce_block(nodes, min(levels, depth(n, arity)), arity)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // width)], "node": [top]})

    cut = blocks(nodes.select("tree", "pos", "n", "node"), width)
    return cut.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, node string")


def rounds_above(nodes: DataFrame, levels: int, arity: int) -> list[DataFrame]:
    """The given nodes and the stored rounds above them, one at least, until each tree has one node."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1 or len(out) == 1:
        out.append(kept(up(out[-1], levels, arity), nodes.sparkSession))
        most = -(-most // arity**levels)
    return out


def exchanged(nodes: DataFrame, outer: DataFrame, levels: int, arity: int, finish, schema: str) -> DataFrame:
    """``finish`` of every superblock of ``nodes``, sorted, its levels and the outer row that the round above made for it."""

    def exchange(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        return finish(left, reduce_block(left["node"].tolist(), min(levels, depth(int(left["n"].iloc[0]), arity)), arity), right.iloc[0])

    cut = blocks(nodes, arity**levels)
    outer = outer.withColumnRenamed("pos", "block").repartition(partitions(nodes.sparkSession), "tree", "block")
    return cut.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(exchange, schema)


def down(rounds: list[DataFrame], outer: DataFrame, levels: int, arity: int, until: int) -> DataFrame:
    """(tree, pos, path, subroot, root) of the nodes of round ``until``, from those of the last round."""

    def finish(left: pd.DataFrame, stack: list[list[str]], above: pd.Series) -> pd.DataFrame:
        paths = [join_paths(write_path(siblings(stack, k, arity)), above["path"]) for k in range(len(left))]
        return pd.DataFrame({"tree": left["tree"], "pos": left["pos"], "path": paths, "subroot": above["subroot"], "root": above["root"]})

    for nodes in reversed(rounds[until:-1]):
        made = exchanged(nodes.select("tree", "pos", "n", "node"), outer, levels, arity, finish, OUTER)
        outer = kept(made, nodes.sparkSession)
    return outer


def verified(base: DataFrame, outer: DataFrame, levels: int, arity: int) -> DataFrame:
    """The manifest's rows: each leaf's way to the root, and the root that it or its tampered form gives with it."""

    def finish(left: pd.DataFrame, stack: list[list[str]], above: pd.Series) -> pd.DataFrame:
        paths = [join_paths(write_path(siblings(stack, k, arity)), above["path"]) for k in range(len(left))]
        used = left["other"].where(left["other"].notna(), left["node"])
        folded = [fold(leaf, path) for leaf, path in zip(used, paths)]
        return pd.DataFrame({
            "id": left["id"], "leaf": left["node"], "subroot": above["subroot"], "root": above["root"],
            "proof_sha256": [proof(path) for path in paths], "folded_root": folded, "verified": [f == above["root"] for f in folded],
        })

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return exchanged(base, outer, levels, arity, finish, schema)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, tree, node, other) of every row; ``other``: the leaf after tampering, null where nothing is tampered with.

    ``tree`` orders languages bytewise with null first.
    """
    values = {c: F.col(c) for c in FIELDS}
    lowered = values | {"text": F.translate("text", UPPER, LOWER)}
    return docs.select(
        "doc_id",
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("tree"),
        leaf_of([values[c] for c in FIELDS]).alias("node"),
        F.when(tampered, leaf_of([lowered[c] for c in FIELDS])).alias("other"),
    )


def tampered_ids(doc_id: Column) -> Column:
    """Ids whose unsigned crc32 of the decimal text 3 divides; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text with their byte counts, nulls as ``-``.
    Leaves of a lang ascend by doc_id, null ids first and equal ids by their leaf; nulls in lang are a tree
    of their own, the first. ``folded_root`` comes from the tampered leaf where ``tampered`` holds (default:
    3 divides the crc32 of the id), else from the original one, with the original siblings.
    Repeated rows are leaves of their own; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tampered = tampered_ids(F.col("doc_id")) if tampered is None else tampered
    made = kept(leaves(docs.select(*FIELDS), tampered), spark)
    # Groups travel through pandas, where a number column with nulls would lose digits.
    base = numbered(made, "tree", ["doc_id", "node"]).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    lower = rounds_above(base, levels, arity)
    tops = numbered(lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "tree", ["name"])
    upper = rounds_above(tops, levels, arity)
    last = upper[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    ways = down(upper, last, levels, arity, 0)
    # One row per language, its subroot and its way to the root.
    named = tops.select("tree", "pos", "name", "node").join(ways, ["tree", "pos"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"
    )
    rows = verified(base, down(lower, named, levels, arity, 1), levels, arity)
    return rows.withColumn("id", F.col("id").cast(made.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")
