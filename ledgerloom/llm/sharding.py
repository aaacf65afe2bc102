"""Sharding by a hierarchical weighted hash tree.

A tree has three levels: regions hold racks, racks hold shards, and only shards
carry weights; a rack or region weighs what its shards weigh together.  A row
descends from the root: at each level every child makes one weighted hash draw,
``-ln(u) / weight`` with ``u`` uniform in (0, 1) from a hash of the row's id, the
child's level and its name, and the smallest draw wins.  A child's draw depends on
nothing but its own name and weight, so a change of weights moves rows only
between the children whose weights change, and only below them.

The ``key`` law, where the id and the shard count decide and one more shard takes rows
only into itself, holds at every count.  Up to the size of the base tree a row descends
again, with fresh draws, until it lands on a shard that exists yet: one more shard takes
just the rows that landed on it sooner.  Beyond it ``grow`` adds a shard as a region of
its own, so no other node's weight changes.

Everything is JVM-side expressions.  Slots are ranks inside a shard, made from
ranks inside (shard, cell) groups plus cell offsets, so that no task ever holds a
whole shard: cells are hashes of the id and of the size and checksum of the text.

Edge cases: a null text has size 8 and checksum 0; a null id draws as a fixed
value of its own, rows with equal ids go to the same shard, whatever else they
hold, and rows equal in id, size and checksum take their slots in any order; a very long
text counts by its size only; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table

#: Cells of a shard for ranking; their counts, at most CELLS for each shard, are broadcast.
CELLS = 512


#: Regions of the base tree, and descents after which a row without a shard goes to shard 0.
REGIONS, DESCENTS = 3, 16


@dataclass(frozen=True)
class Tree:
    """regions[region][rack] is a tuple of (shard number, weight); shards from ``count`` on
    do not exist yet."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]
    count: int

    @staticmethod
    def of(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
        """Equal weights: the base tree, of which the first shards exist, or all and more."""
        size = racks * per_rack
        base = tuple(tuple(tuple((n * size + r * per_rack + i, 1.0) for i in range(per_rack)) for r in range(racks)) for n in range(REGIONS))
        tree = Tree(base, min(shards, REGIONS * size))
        while tree.count < shards:
            tree = tree.grow()
        return tree

    def shards(self) -> list[int]:
        return sorted(s for region in self.regions for rack in region for s, _ in rack)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard: the next of the tree, or one alone in a region of its own."""
        if self.count < len(self.shards()):
            return Tree(self.regions, self.count + 1)
        return Tree((*self.regions, (((self.count, weight),),)), self.count + 1)

    def weighted(self, shard: int, weight: float) -> Tree:
        """The same tree with another weight for one shard."""
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions), self.count)


def draw(key: Column, level: int, name: int, weight: float) -> Column:
    """-ln(u) / weight with u = (h + 0.5) / 2**53 from the upper 53 bits of the hash."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(name)), 11)
    return -F.ln((h.cast("double") + 0.5) / float(1 << 53)) / F.lit(weight)


def choose(key: Column, level: int, children: list[tuple[int, float, Column]]) -> Column:
    """What belongs to the child with the smallest draw; ties go to the earlier child."""
    live = [(n, w, c) for n, w, c in children if w > 0]
    if len(live) == 1:
        return live[0][2]
    draws = [draw(key, level, n, w) for n, w, _ in live]
    least = F.least(*draws)
    out = F.when(draws[0] == least, live[0][2])
    for d, (_, _, c) in zip(draws[1:-1], live[1:-1], strict=True):
        out = out.when(d == least, c)
    return out.otherwise(live[-1][2])


def landing(key: Column, tree: Tree, descent: int) -> Column:
    """Names: a node is named by the smallest shard number below it, which growth never changes."""
    level = 3 * descent
    regions = []
    for region in tree.regions:
        racks = []
        for rack in region:
            shards = [(s, w, F.lit(s)) for s, w in rack]
            racks.append((min(s for s, _ in rack), sum(w for _, w in rack), choose(key, level + 3, shards)))
        regions.append((min(n for n, _, _ in racks), sum(w for _, w, _ in racks), choose(key, level + 2, racks)))
    return choose(key, level + 1, regions)


def shard_of(key: Column, tree: Tree) -> Column:
    if tree.count == len(tree.shards()):
        return landing(key, tree, 0)
    tries = [landing(key, tree, i) for i in range(DESCENTS)]
    return F.coalesce(F.get(F.filter(F.array(*tries), lambda s: s < tree.count), 0) if tree.count > 1 else F.lit(0), F.lit(0))


def shard_documents(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    key = F.col("doc_id")
    measured = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = measured.select("*", shard_of(key, tree).cast("int").alias("shard"), shard_of(key, tree.grow()).cast("int").alias("grown_shard"))
    cell = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(CELLS)).cast("int")
    placed = placed.withColumn("_cell", cell)
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n")).select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # At most CELLS rows for each shard of the tree, whatever the input.
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), ["shard", "_cell"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), Tree.of(24))


QUERIES: dict[str, Callable] = {"op3_sharding": op3_sharding}
ORACLE: dict[str, str] = {}
