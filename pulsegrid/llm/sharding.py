"""Sharding by a hierarchical weighted hash tree.

A key descends region -> rack -> shard. At each level every candidate subtree
draws ``-ln(u) / weight`` with u a hash of (key, subtree name) and the smallest
draw wins, so a subtree receives keys in proportion to its weight and a change
of one weight moves keys only into or out of that subtree.

Capacity that is added later is a *generation* of its own beside the first
layout: it draws against the older subtrees at region level with its own
weight, and a key that it wins descends only inside that generation. One more
shard therefore takes keys into itself and moves no other key.

Edge cases: a null key is a key like any other (all its rows share a shard), a
null or empty text has size 16 and checksum 0, repeated rows share a shard and
take consecutive slots, an empty table gives no rows. Columns of the input
other than the key and the text are not read, so their names cannot clash.
Everything is a DataFrame expression; no step collects rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one slot-numbering group may hold on average.
ROWS_PER_CHUNK = 50_000


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has a shard number and no children."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple["Node", ...] = ()


def _inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), None, tuple(children))


def layout(shards: int, first: int, regions: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``shards`` shards, of which ``first`` were there from the start and the others were added one at a time."""
    w = weights or {}
    leaf = lambda i: Node(f"shard{i}", w.get(i, 1.0), i)
    groups: dict[tuple[int, int], list[Node]] = {}
    for i in range(min(first, shards)):
        groups.setdefault((i % regions, i // regions % racks), []).append(leaf(i))
    tree = [_inner(f"region{r}/0", [_inner(f"region{r}/0/rack{k}", groups[r, k]) for k in range(racks) if (r, k) in groups]) for r in range(regions) if any(g[0] == r for g in groups)]
    for i in range(first, shards):
        r, k = i % regions, i // regions % racks
        tree.append(_inner(f"region{r}/{i}", [_inner(f"region{r}/{i}/rack{k}", [leaf(i)])]))
    return _inner("root", tree)


def _inner_nodes(node: Node) -> list[Node]:
    return [node, *(x for c in node.children for x in _inner_nodes(c))] if node.children else []


def _pick(key: Column, children: Column) -> Column:
    """The child with the smallest draw: struct<draw, name, shard>."""

    def draw(c: Column) -> Column:
        # 52 bits of the hash, moved off 0, as a number in (0, 1)
        u = (F.pmod(F.xxhash64(key, c["name"]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["name"].alias("name"), c["shard"].alias("shard"))

    return F.array_min(F.transform(children, draw))


def shard_of(key: Column, tree: Node) -> Column:
    """Shard of a key: a pure expression of the key and the tree, one draw for each child of the nodes that it passes."""
    item = lambda c: F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(-1 if c.shard is None else c.shard).alias("shard"))
    below = F.create_map(*[x for n in _inner_nodes(tree) for x in (F.lit(n.name), F.array(*[item(c) for c in n.children]))])
    depth = lambda n: 1 + depth(n.children[0]) if n.children else 0
    at = F.lit(tree.name)
    for _ in range(depth(tree) - 1):
        at = _pick(key, F.element_at(below, at))["name"]
    return _pick(key, F.element_at(below, at))["shard"]


def shard_documents(docs: DataFrame, shards: int = 40, grow_to: int | None = None, key: str = "doc_id", text: str = "text", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots run from 0 without gaps in each shard. They come from counts by
    (shard, chunk of the key's hash) and a rank inside each chunk, so no task
    orders a whole shard; the number of chunks follows the number of rows.
    """
    grow_to = grow_to or shards + 1
    chunks = max(1, -(-docs.count() // (shards * rows_per_chunk)))
    k = F.col("doc_id")
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0).cast("long")).alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        shard_of(k, layout(shards, shards)).cast("int").alias("shard"),
        shard_of(k, layout(grow_to, shards)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(k, "text_crc32", F.lit("chunk")), F.lit(chunks)).alias("chunk"),
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside))
    return ranked.join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, key: str = "doc_id") -> None:
    """Write whole rows below ``path``, one folder for each shard."""
    at = shard_of(F.col(key), layout(shards, shards)).cast("int")
    docs.withColumn("shard", at).repartition(shards, "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
