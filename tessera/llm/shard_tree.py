"""Sharding by a hierarchy of weighted hash draws: region, then rack, then shard.

Every node of the tree draws, for a key, an exponential variate of a rate that equals its weight;
among siblings the least draw wins, which picks each in proportion to its weight. A draw depends on
the key and the node alone, so a change of weights moves keys only into nodes that gained weight and
out of nodes that lost some, and nothing moves between subtrees whose weights stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards of the first layout: 3 regions of 2 racks of 4 shards.
BASE = (3, 2, 4)
#: Parts into which the rows of a shard are dealt to number them without gathering a shard.
SLOT_PARTS = 256


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves carry their shard number; a weight is that of its leaves."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree_for(shards: int) -> tuple[Node, ...]:
    """The layout of that many shards, as a tuple of regions.

    The base layout fills up leaf by leaf to 24 shards; each further shard opens a region of its own, so
    that from 24 shards on one more shard draws keys into itself and into no other.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    regions, racks, leaves = BASE
    tree, at = [], 0
    for r in range(regions):
        own = []
        for k in range(racks):
            named = [Node(f"s{n}", 1.0, (), n) for n in range(at, min(at + leaves, shards))]
            at += len(named)
            if named:
                own.append(Node(f"r{r}k{k}", float(len(named)), tuple(named)))
        if own:
            tree.append(Node(f"r{r}", sum(n.weight for n in own), tuple(own)))
    for n in range(at, shards):
        tree.append(Node(f"r{n}x", 1.0, (Node(f"r{n}xk", 1.0, (Node(f"s{n}", 1.0, (), n),)),)))
    return tuple(tree)


def _draw(key: Column, node: Column) -> Column:
    """-ln(u) / weight for a uniform u in (0, 1] made of 52 bits of a hash of key and node."""
    bits = F.shiftrightunsigned(F.xxhash64(key, node["name"]), 12)
    return -F.log((bits.cast("double") + 1.0) / float(2**52)) / node["weight"]


def _siblings(nodes: tuple[Node, ...]) -> Column:
    """These nodes as a constant array; those without weight draw no keys and are left out."""
    live = [F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight"), F.lit(i if n.shard is None else n.shard).alias("i")) for i, n in enumerate(nodes) if n.weight > 0]
    if not live:
        raise ValueError("siblings without any weight")
    return F.array(*live)


def _least(key: Column, siblings: Column) -> Column:
    """The number of the sibling with the least draw; of equal draws, the smaller number."""
    return F.array_min(F.transform(siblings, lambda n: F.struct(_draw(key, n).alias("d"), n["i"].alias("i"))))["i"]


def assign(rows: DataFrame, key_col: str, tree: tuple[Node, ...], out: str = "shard") -> DataFrame:
    """Adds the shard number as column `out` (an existing column of that name is replaced).

    Descends by one weighted draw a level. Equal keys share a shard; null keys are one key. A key
    that has a third of all rows cannot be spread by this law, whose purpose is that the key alone
    decides; rows are told apart by giving another key column.
    """
    key, region, rack = F.col(key_col), f"__{out}_region", f"__{out}_rack"
    racks = F.array(*[_siblings(r.children) for r in tree])
    shards = F.array(*[F.array(*[_siblings(k.children) for k in r.children]) for r in tree])
    return (
        rows.withColumn(region, _least(key, _siblings(tree)))
        .withColumn(rack, _least(key, F.get(racks, F.col(region))))
        .withColumn(out, _least(key, F.get(F.get(shards, F.col(region)), F.col(rack))).cast("int"))
        .drop(region, rack)
    )


def number_slots(rows: DataFrame, shard_col: str, order: list[str], out: str = "slot") -> DataFrame:
    """Adds a number that is gapless from 0 within each shard.

    The rows of a shard are dealt into SLOT_PARTS parts by a hash of the ordering columns and
    numbered within a part; parts start where the parts before them end, and those starts are one
    row for each shard and part, however large the table. Rows equal in all ordering columns are
    interchangeable.
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(SLOT_PARTS)).cast("int"))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col(shard_col).alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("n"))
    starts = starts.select("__s", "__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(shard_col, "__part").orderBy(*order))
    numbered = dealt.withColumn("__at", within.cast("long"))
    # At most SLOT_PARTS rows a shard: a size that does not grow with the table.
    joined = numbered.join(F.broadcast(starts), (F.col(shard_col) == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(out, (F.col("__start") + F.col("__at") - 1).cast("long")).drop("__s", "__p", "__part", "__start", "__at")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard. Law: `key`.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes and a text_crc32 of 0 (that
    of no bytes). grown_shard is the shard if there were one more. Equal ids share a shard, repeated rows
    included; each row has its own slot. Null ids are one key. An empty table gives no rows. Other
    columns, also those named like results, are ignored.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    placed = assign(assign(rows, id_col, tree_for(shards)), id_col, tree_for(shards + 1), "grown_shard")
    numbered = number_slots(placed, "shard", [id_col, "size", "text_crc32"])
    return numbered.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
