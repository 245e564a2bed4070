"""Merkle manifest of a table: a tree of row digests for each group, and a tree of the groups' roots.

Levels are DataFrames. Nodes have row numbers; a number divided by the fanout is that of the parent, and
a parent is the digest of its children's array, sorted by number. Back from the root each level is joined
with the proofs of its parents, and every child puts its siblings before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, scratch_scope

#: Levels of at most so many nodes are kept in one partition, whose groups and joins need no shuffle.
SMALL = 4_096
#: Levels of proofs that make one plan.
PLANNED = 4
#: A proof: for each level from the leaf on, the siblings before and after, as joined digests.
NO_PROOF = "cast(array() AS array<struct<before: binary, after: binary>>)"


def field(value: Column) -> Column:
    """A value as it enters a digest: `-` if null, else its length in bytes, a colon, and itself."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def digest(*values: Column) -> Column:
    """Lowercase hex of the SHA-256 of the values' concatenation."""
    return F.sha2(F.concat(*values), 256)


def _text(joined: Column) -> Column:
    return F.lower(F.hex(joined))


def _joined(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(b""), lambda a, h: F.concat(a, h))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `at`, their place from 0 on within `tree`, and `n`, the rows of the tree.

    Rows are dealt over ranges of (tree, order) and written with their range's number; a place is that within the
    range plus the rows of ranges before, which is one row a range and tree. Equal rows may be many: a number that
    says nothing divides them.
    """
    dealt = rows.withColumn("__any", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "__any").withColumn("__range", F.spark_partition_id())
    dealt, _ = materialize(dealt, name)
    whole = Window.partitionBy("tree")
    sizes = dealt.groupBy("tree", "__range").agg(F.count("*").alias("__c"))
    starts = sizes.select("tree", "__range", F.sum("__c").over(whole).alias("n"), (F.sum("__c").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("tree", "__range").orderBy(*order, "__any"))
    return dealt.withColumn("__within", within).join(starts, ["tree", "__range"]).withColumn("at", F.col("__before") + F.col("__within") - 1).drop("__range", "__any", "__before", "__within")


def _gathered(rows: DataFrame, n: int) -> DataFrame:
    return rows.coalesce(1) if n <= SMALL else rows


class _Forest:
    """The levels above `nodes` (tree, at, n, hash); n is the count of the tree's nodes at their height.

    levels[h] is a written table (tree, at, n, kids, hash), kids the hashes of at most `fanout` nodes of height h. A tree
    ends with its single node. counts[h] are the nodes of height h that have a parent; the driver gets one for each
    height, a number that is the logarithm of the rows.
    """

    def __init__(self, nodes: DataFrame, fanout: int, name: str) -> None:
        self.fanout, self.levels, self.name = fanout, [], name
        power = F.pow(F.lit(float(fanout)), F.col("h"))
        sizes = nodes.groupBy("tree").agg(F.max("n").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("h")).where(power < F.col("n"))
        self.counts = [r["c"] for r in sizes.groupBy("h").agg(F.sum(F.ceil(F.col("n") / power)).alias("c")).orderBy("h").collect()]
        self.roots = [nodes.where("n = 1")]
        now = nodes
        for n in self.counts:
            kids = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda k: k["hash"])
            rising = _gathered(now.where("n > 1"), n).select("tree", F.expr(f"at div {fanout}").alias("up"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("many"), "at", "hash")
            above = rising.groupBy("tree", "up").agg(F.first("many").alias("n"), kids.alias("kids"))
            parent = F.unhex(F.sha2(F.array_join(F.transform("kids", _text), ""), 256))
            now, _ = materialize(above.select("tree", F.col("up").alias("at"), "n", "kids", parent.alias("hash")), f"{name}-level")
            self.levels.append(now)
            self.roots.append(now.where("n = 1"))
        named = [r.select("tree", "hash", F.lit(h).alias("height")) for h, r in enumerate(self.roots)]
        #: (tree, hash, height), one row for each tree.
        self.ends, _ = materialize(reduce(DataFrame.union, named), f"{name}-ends")

    def proofs(self, above_roots: DataFrame) -> DataFrame:
        """(tree, at, subroot, proof) of the nodes below, from (tree, proof) of their trees' roots."""

        starts, _ = materialize(self.ends.join(above_roots, "tree").select("tree", F.lit(0).cast("long").alias("at"), F.col("hash").alias("subroot"), "proof", "height"), f"{self.name}-starts")
        heights = {r["height"] for r in starts.select("height").distinct().collect()}
        now = None
        for height in range(len(self.levels), -1, -1):
            if now is not None:
                level, n = self.levels[height].select("tree", "at", "kids"), self.counts[height]
                met = _gathered(level, n).join(_gathered(now, n), ["tree", "at"])
                child = met.select("tree", "at", "subroot", "proof", "kids", F.posexplode("kids").alias("i", "own"))
                before, after = _joined(F.slice("kids", F.lit(1), F.col("i"))), _joined(F.slice("kids", F.col("i") + 2, F.size("kids")))
                siblings = F.array(F.struct(before.alias("before"), after.alias("after")))
                now = child.select("tree", (F.col("at") * self.fanout + F.col("i")).alias("at"), "subroot", F.concat(siblings, "proof").alias("proof"))
                if height and (height % PLANNED == 0 or n <= SMALL < self.counts[height - 1]):
                    now, _ = materialize(now, f"{self.name}-proofs")
            if height in heights:
                ended = starts.where(F.col("height") == height).drop("height")
                now = ended if now is None else now.union(ended)
        return starts.drop("height") if now is None else now


def manifest(rows: DataFrame, values: list[str], group_col: str, id_col: str, fanout: int = 2, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified; digests are lowercase hex.

    A leaf is the digest of the row's values. The leaves of a group ascend by id (null first; of equal ids by leaf), and every
    `fanout` consecutive nodes, the last run fewer, become their digest until one is left, the subroot. Subroots
    ascend by group (null first, bytewise) and make the root likewise. The proof of a row are its siblings from level to
    level up to the root; proof_sha256 is the digest of all, from left to right. folded_root is what the proof
    makes of the leaf with `tampered` (new values of some columns) in place, verified whether that is the root.

    Any value may be null or empty; repeated rows are leaves of their own; an empty table gives no rows; a table of one row
    has its leaf as root and the digest of nothing as proof. Other columns are ignored. No level, group
    or run of equal rows is in one task unless it has at most 4,096 nodes; a lost executor costs a reread of written levels.
    """
    spark, changed = rows.sparkSession, tampered or {}
    leaf = F.unhex(digest(*[field(F.col(c)) for c in values]))
    forged = F.unhex(digest(*[field(changed.get(c, F.col(c))) for c in values])) if changed else leaf
    # Groups as keys that sort like them and are never null.
    tree = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    with scratch_scope(spark) as keep:
        leaves = rows.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("hash"), forged.alias("forged"))
        leaves, path = materialize(_numbered(leaves, ["id", "hash"], "merkle-leaves"), "merkle-numbered")
        forest = _Forest(leaves.select("tree", "at", "n", "hash"), fanout, "merkle")
        tops, _ = materialize(_numbered(forest.ends.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), ["of"], "merkle-roots"), "merkle-tops")
        crown = _Forest(tops.select("tree", "at", "n", "hash"), fanout, "crown")
        last = crown.ends.first()
        nothing = spark.range(1).select(F.lit("").alias("tree"), F.expr(NO_PROOF).alias("proof"))
        above = crown.proofs(nothing).join(tops.select("at", F.col("of")), "at").select(F.col("of").alias("tree"), "proof")
        above, _ = materialize(above, "merkle-crown")
        found = leaves.select("tree", "at", "id", "hash", "forged").join(forest.proofs(above), ["tree", "at"])
        root = F.lit(last["hash"].hex() if last else "")
        steps = F.transform("proof", lambda s: _text(F.concat(s["before"], s["after"])))
        folded = F.aggregate("proof", _text(F.col("forged")), lambda h, s: F.sha2(F.concat(_text(s["before"]), h, _text(s["after"])), 256))
        out = found.select(F.col("id").alias(id_col), _text(F.col("hash")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
        out, path = materialize(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")
        keep.append(path)
    return out
