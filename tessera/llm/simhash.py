"""SimHash fingerprints, and the near-duplicate groups that they form.

Candidate pairs come from an inverted index over the bytes of a fingerprint and their positions. Two
fingerprints that differ in at most RADIUS = 2 bits share at least 8 - 2 = 6 of their 8 positional bytes
(the guaranteed count). A posting list of a single byte would hold a 256th of all fingerprints, and its
pairs would grow with the square of the table; so the index is keyed by the guaranteed count of positional
bytes jointly, in each of the 28 ways to choose them. A pair that shares 6 bytes meets in one list and a pair
that shares 7 meets in 7, so the number of its lists is the tally of its shared bytes. Fingerprints of one
list differ in the other two bytes at most, so no list is longer than 65,536 however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.filters import MANY, join_few, possibly_in
from tessera.session import materialize, remove, scratch_scope

RADIUS = 2
SEED = 42
#: Bytes of a fingerprint, and how many of them two linked ones share at least.
BYTES = 8
LEAST_SHARED = BYTES - RADIUS


def words_of(text: str) -> list[bytes]:
    """Maximal runs of bytes other than space and 09-0D, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words joined by spaces; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    after = np.cumsum(lengths)
    digest = xxhash.xxh64_intdigest
    spans = zip((after - lengths).tolist(), (after[width - 1 :] - 1).tolist(), strict=False)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash as an unsigned number; zero for a text without words."""
    return majority(shingle_hashes(words_of(text or ""), width))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        set_in += part.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(set_in * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp): one row per row of docs, fp as a signed long. A null text is one without words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], ["doc", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(compute, "doc long, fp long")


def _postings(classes: DataFrame) -> DataFrame:
    """The inverted index: (slot, key, fp), a row for each choice of LEAST_SHARED positional bytes."""
    keys = []
    for slot, positions in enumerate(combinations(range(BYTES), LEAST_SHARED)):
        mask = sum(255 << 8 * i for i in positions)
        keys.append(F.struct(F.lit(slot).cast("byte").alias("slot"), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("key")))
    return classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.key", "fp")


def tallied_pairs(classes: DataFrame) -> DataFrame:
    """(src, dst, shared): pairs of distinct fingerprints with at least LEAST_SHARED equal positional bytes, and how many.

    A pair is in one list for each choice of LEAST_SHARED bytes out of those it shares.
    """
    postings = _postings(classes)
    shared, _ = materialize(postings.groupBy("slot", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("slot", "key"), "simhash-shared")
    # Most keys are of one fingerprint; only the postings of the others are put together.
    met = possibly_in(postings, [F.col("slot"), F.col("key")], shared).where("__maybe")
    lists = met.groupBy("slot", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps", F.explode("fps").alias("src"))
    pairs = lists.select("src", F.explode(F.filter("fps", lambda x: x > F.col("src"))).alias("dst"))
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("lists"))
    shared = F.coalesce(*[F.when(F.col("lists") >= comb(n, LEAST_SHARED), n) for n in range(BYTES, LEAST_SHARED, -1)], F.lit(LEAST_SHARED))
    return counted.select("src", "dst", shared.alias("shared"))


def linked_fingerprints(classes: DataFrame) -> DataFrame:
    """(src, dst): the pairs of distinct fingerprints at most RADIUS bits apart. Candidates are the pairs that
    reach the guaranteed count of shared bytes, and each is verified."""
    candidates = tallied_pairs(classes).where(F.col("shared") >= LEAST_SHARED)
    return candidates.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS).select("src", "dst")


def near_duplicate_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most RADIUS bits; component_id is the smallest
    id in the connected component. Equal fingerprints are one node, so copies are never paired.

    A null or blank text has fingerprint zero and links like any other. Null ids are no component's
    id unless it has no other; repeated rows are returned as often as they occur; an empty table
    gives no rows. Other columns are ignored.
    """
    fps, _ = materialize(fingerprints(docs, width, id_col, text_col), "simhash-fps")
    classes, _ = materialize(fps.groupBy("fp").agg(F.min("doc").alias("low")), "simhash-classes")
    parts = connected_components(linked_fingerprints(classes))
    named = classes.join(parts, F.col("fp") == F.col("id"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows, _ = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-roots")
    by_fp, _ = materialize(named.join(lows, "root").select("fp", "component_id"), "simhash-groups")
    return fps.join(by_fp, "fp").select(F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicate stages compare texts by the sets of their five-word shingles.
STAGE_WIDTH = 5
#: Shingles are ordered by how many documents have one of their bucket. Any order that is the same for all
#: documents gives the same pairs; one from rare to frequent gives the shortest lists.
BUCKETS = 1 << 18


def shingle_set(text: str | None, width: int = STAGE_WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(words_of(text or ""), width))


def prefix(hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, as many as a set of Jaccard similarity 0.8 must share one of.

    Such a set has at least 0.8 of the shingles of this one, rounded up; all but that many, and one more,
    cannot all be missing. So the least common shingle of two similar sets is in both prefixes.
    """
    n = len(hashes)
    order = np.lexsort((hashes, frequency[hashes & np.uint64(BUCKETS - 1)]))
    return hashes[order[: n - (4 * n + 4) // 5 + 1]] if n else hashes


def _set_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its node, the hash of its shingle set, so that equal sets are one node (0 without
    words), the set with its size, and its fingerprint."""
    names = ["doc", "node", "n", "shingles", "fp"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), shingles, pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))], names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(compute, "doc long, node long, n int, shingles array<long>, fp long")


def _bucket_counts(noded: DataFrame) -> np.ndarray:
    """Of every bucket how many shingles of documents fall into it. Tasks count theirs, and what is collected is
    bounded by BUCKETS, whatever the size of the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    found = noded.select("shingles").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefix_postings(noded: DataFrame) -> DataFrame:
    """(key, node, n, part, pos): the prefix shingles of every node, with their places in the order."""
    shared = noded.sparkSession.sparkContext.broadcast(_bucket_counts(noded))
    names = ["key", "node", "n", "part", "pos"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keys = [prefix(s.values.to_numpy().view(np.uint64), shared.value) for s in part.column(3)]
                lengths = [len(x) for x in keys]
                of = lambda c: np.repeat(part.column(c).to_numpy(), lengths)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(of(0)), pa.array(of(1)), pa.array(of(2)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]))], names)

    return noded.select("node", "n", "part", "shingles").mapInArrow(work, "key long, node long, n int, part long, pos int")


def _verified(pairs: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """Of pairs (src, dst) of nodes those whose shingle sets have a Jaccard similarity of at least 0.8."""
    ends, _ = materialize(pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct(), "set-ends")
    firsts = ends.join(classes.select("node", "low"), "node").withColumnRenamed("node", "own")
    # One set a node, also where rows repeat the id of its first document. The sets of other nodes are not moved.
    asked = possibly_in(prints, [F.col("node")], ends).where("__maybe").drop("__maybe")
    sets = asked.join(firsts, (F.col("node") == F.col("own")) & F.col("doc").eqNullSafe(F.col("low"))).select("node", "shingles").dropDuplicates(["node"])
    sets, _ = materialize(sets, "set-sets")
    both = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    # 9 * common >= 4 * (|a| + |b|) is common / (|a| + |b| - common) >= 0.8.
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("src", "dst")


def _met(one: DataFrame, other: DataFrame) -> DataFrame:
    """(src, dst): pairs of different components from two tables of postings with the same key that may reach 0.8.

    At the least common shingle of two sets no more is common than what follows in either, itself
    included; a pair that cannot reach 0.8 there is none.
    """
    pairs = one.alias("a").join(other.alias("b"), (F.col("a.key") == F.col("b.key")) & F.expr("a.part <> b.part AND 9 * least(a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)"))
    return pairs.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct()


def _in_parts(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of nodes with their node's component as part, the node itself if it is in none. Nodes without links are
    not moved."""

    def named(few: DataFrame) -> DataFrame:
        return few.join(parts, F.col("node") == F.col("id"), "left").withColumn("part", F.coalesce("component", "node")).drop("id", "component")

    return join_few(nodes.withColumn("part", F.col("node")), [F.col("node")], parts.select("id"), named)


def _near_fingerprints(classes: DataFrame) -> DataFrame:
    """(src, dst): nodes of one fingerprint with the least of them, and these where fingerprints link."""
    firsts, _ = materialize(classes.groupBy("fp").agg(F.min("node").alias("first")), "set-fps")
    same = classes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    links = linked_fingerprints(firsts.select("fp"))
    ends = links.join(firsts.toDF("src", "a"), "src").join(firsts.toDF("dst", "b"), "dst")
    return same.union(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))


def _links(classes: DataFrame, noded: DataFrame) -> DataFrame:
    """(src, dst): pairs of similar nodes, which connect all that are.

    Three passes, each over what the ones before have not joined. First nodes whose fingerprints link by the
    positional index (linked_fingerprints). Then every list of the prefix index, whatever its length, is
    compared with its head, the node with the most shingles left behind the shared one: what resembles any
    node of the list most likely resembles this. Last, of each list the nodes outside its largest
    component meet the nodes of other components. So a list whose nodes are alike takes rows in
    proportion to its length, and no similar pair is left apart.
    """
    prints, _ = materialize(_near_fingerprints(classes), "set-near")
    near, _ = materialize(_verified(prints, classes, noded), "set-links")
    parts, _ = materialize(connected_components(near), "set-parts")
    postings, at = materialize(_prefix_postings(_in_parts(noded.select("node", "n", "shingles"), parts)), "set-postings")
    shared, _ = materialize(postings.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key"), "set-shared")
    # Most keys are of one component only; the postings of the others go on.
    open_lists, _ = materialize(possibly_in(postings, [F.col("key")], shared, MANY).where("__maybe").drop("__maybe").distinct(), "set-open")
    remove(postings.sparkSession, at)
    best = F.struct(((F.col("n") - F.col("pos")) / F.col("n")).alias("share"), (-F.col("n")).alias("less"), "node", "n", "pos", "part")
    heads, _ = materialize(open_lists.groupBy("key").agg(F.max(best).alias("head")).select("key", "head.node", "head.n", "head.pos", "head.part"), "set-heads")
    first, _ = materialize(_met(open_lists, heads), "set-pairs")
    linked, _ = materialize(near.union(_verified(first, classes, noded)), "set-links")
    parts, _ = materialize(connected_components(linked), "set-parts")

    named, _ = materialize(_in_parts(open_lists.drop("part"), parts), "set-listed")
    counted = named.groupBy("key", "part").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    largest, _ = materialize(counted.select("key", F.col("most.part").alias("largest")), "set-largest")
    rest, _ = materialize(named.join(largest, "key"), "set-open")
    second, _ = materialize(_met(rest.where("part <> largest"), rest).join(first, ["src", "dst"], "left_anti"), "set-pairs")
    return linked.union(_verified(second, classes, noded))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of documents that have words with their class (node) and their group's smallest id as
    component_id. Documents are linked if the Jaccard similarity of their sets of five-word shingles is at
    least 0.8; equal sets are one class.

    Fingerprints within RADIUS bits, found by the positional index, give the first links; no number of shared
    bytes is certain at 0.8, so the rest come from an index of the rarest shingles, one of which every pair at
    0.8 shares. All candidates are verified, and none is missed.
    """
    prints, _ = materialize(_set_table(docs, id_col, text_col), "set-prints")
    # Texts without words have no shingles to be similar in.
    noded = prints.where("n > 0")
    classes, _ = materialize(noded.groupBy("node").agg(F.min("doc").alias("low"), F.first("fp").alias("fp")), "set-classes")
    parts = connected_components(_links(classes, noded))
    named = classes.select("node", "low").join(parts, F.col("node") == F.col("id"), "left").select("node", "low", F.coalesce("component", "node").alias("root"))
    lows, _ = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "set-roots")
    groups, _ = materialize(named.join(lows, "root").select("node", "component_id"), "set-groups")
    return noded.select("doc", "node").join(groups, "node").select(F.col("doc").alias(id_col), "node", "component_id")


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are similar to a document with a smaller id in their group.

    Texts without words and rows without an id stay. Of rows that repeat an id all stay or go.
    """
    with scratch_scope(docs.sparkSession) as keep:
        gone = similar_groups(docs, id_col, text_col).where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
        gone, path = materialize(gone, "similar-gone")
        keep.append(path)
    own = F.col(id_col).cast("long")
    return join_few(docs, [own], gone, lambda few: few.join(gone, own == F.col("__gone"), "left_anti"))
