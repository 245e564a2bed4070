"""Ranked lexical search over term-partitioned postings, by three phases with one threshold a query.

The heads of the lists name rows whose scores give each query a bound that its k best rows reach. No row whose part in
every list is below a threshold can reach it; so every list returns its entries from that threshold on. Bounds
of what the rows found may have in other lists leave few candidates, whose exact scores are looked up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import CHUNK, possibly_in
from tessera.session import materialize, scratch_scope

#: A term is a maximal match: digits, letters and whatever is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes: A-Z in lower case, and a space for every ASCII character that no term has.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bits of the bitmap of query terms' checksums (1 MB), which bounds what tasks get. With more terms than bits more postings are
#: written in vain; the join with the terms decides.
BITS = 1 << 23
#: Rows for each of the k results that are looked up for the first bound. The bound is the better the more there are.
SEEDS = 4
#: Terms of queries, with repeats, that are broadcast: 6 MB of numbers, and as much for the steps of their queries' bounds.
BROADCAST = 100_000
#: The greatest unit there is (of a row much shorter than the mean), and the width of the steps in which bounds regard it.
UNITS, STEP = 500_000, 4_000
#: Postings of an Arrow batch.
FLUSH = 1 << 18


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _bitmap(vocabulary: DataFrame) -> bytes:
    """Bits of the terms' checksums, a fixed number of bytes."""
    at = vocabulary.select((F.crc32("term") % BITS).alias("at"))
    chunks = at.groupBy(F.expr(f"cast(at div {CHUNK} as int)").alias("chunk")).agg(F.bitmap_construct_agg(F.col("at") % CHUNK).alias("bits"))
    out = bytearray(BITS // 8)
    for row in chunks.collect():
        begin = row["chunk"] * CHUNK // 8
        out[begin : begin + len(row["bits"])] = row["bits"]
    return bytes(out)


def _counted(docs: DataFrame, wanted: bytes, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, term, tf, n): the counts of the terms of each row that the bitmap has, and a row without term for each row
    that has any; n are all terms of the row."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["row", "doc", "term", "tf", "n"]

    def batch_of(kept: list) -> pa.RecordBatch:
        sizes = [len(k[2]) for k in kept]
        whole = lambda i: np.repeat(np.array([k[i] for k in kept], np.int64), sizes)
        ids = pa.array([k[1] for k in kept], pa.int64()).take(pa.array(np.repeat(np.arange(len(kept)), sizes)))
        words = pa.array([t for k in kept for t in k[2]], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(whole(0)), ids, words, pa.array([c for k in kept for c in k[3]], pa.int64()), pa.array(whole(4))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, crc, kept, size = bits.value, zlib.crc32, [], 0
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                counts = Counter((text.as_py() or b"").translate(FOLD).split())
                if not counts:
                    continue
                held: list = [None]
                held += [t for t in counts if has[(c := crc(t) % BITS) >> 3] >> (c & 7) & 1]
                kept.append((row, doc, held, [0, *[counts[t] for t in held[1:]]], counts.total()))
                size += len(held)
                if size >= FLUSH:
                    yield batch_of(kept)
                    kept, size = [], 0
        yield batch_of(kept)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "row long, doc long, term string, tf long, n long")


class Index:
    """Postings (t, part, row, unit) of the terms that `vocabulary` has, dealt over ranges of (t, part) from the greatest part on;
    a frequent term's list is in several. A part is at least the term's weight w times the row's unit, which is what one
    occurrence counts there. terms_ is (term, t, w, top), top the greatest part; rows is (row, doc)."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> None:
        counted, _ = materialize(_counted(docs, _bitmap(vocabulary), id_col, text_col), "lexical-counts")
        self.rows = counted.where("term IS NULL").select("row", "doc")
        total = counted.where("term IS NULL").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        held = counted.where("term IS NOT NULL")
        found = held.groupBy("term").agg(F.count("*").alias("df")).join(vocabulary, "term", "left_semi")
        # The weight of a term is the one value in doubles; all else is in integers.
        weight = F.floor(1000 * F.log(F.lit(2.0 * total["rows"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weights, _ = materialize(found.select("term", F.monotonically_increasing_id().alias("t"), weight.alias("w")), "lexical-terms")
        long = F.expr(f"50 + (50 * n * {total['rows']}L) div {max(total['terms'], 1)}L")
        part = F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")
        unit = F.expr("cast(1000000000 div (1000 + 20 * m) as int)").alias("unit")
        scored = held.join(weights, "term").withColumn("m", long).select("t", part.alias("part"), "row", unit).where("part > 0")
        self.postings, _ = materialize(scored.repartitionByRange("t", F.desc("part"), "row"), "lexical-postings")
        tops = self.postings.groupBy("t").agg(F.max("part").alias("top"))
        self.terms_, _ = materialize(weights.join(tops, "t").select("term", "t", "w", "top"), "lexical-tops")

    def scores(self, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(q, row, score) of pairs (q, row), looked up in all lists of the query; only postings of such rows are shuffled."""
        looked = possibly_in(self.postings, [F.col("row")], pairs.select("row")).where("__maybe").drop("__maybe")
        return pairs.join(wanted.select("q", "t"), "q").join(looked, ["t", "row"]).groupBy("q", "row").agg(F.sum("part").alias("score"))


def _kth(scores: DataFrame, k: int, by: str, score: str, out: str) -> DataFrame:
    """(by, out): the k-th greatest score, for those that have k. Tasks pass on their k greatest."""
    best = scores.select(by, score).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score)))).where(F.col("rank") <= k)
    return best.groupBy(by).agg(F.min(score).alias(out), F.count("*").alias("held")).where(F.col("held") == k).drop("held")


def thresholds(wanted: DataFrame, least: DataFrame) -> DataFrame:
    """(q, t, top, cut, rest) of the query terms (q, t, top), given the score `least` that k rows of a query have.

    A row with less than `cut` in every list has no more than rest = sum of min(cut - 1, top) in all, and cut is the greatest
    for which that is below `least`. With tops in order, the sum for a cut is the least over i of the i least tops plus
    (cut - 1) for each other list; so the greatest cut comes from the best i. Without `least` it is 1 and every entry counts.
    """
    upto = Window.partitionBy("q").orderBy("top", "t")
    placed = wanted.withColumns({"before": F.sum("top").over(upto.rowsBetween(Window.unboundedPreceding, -1)), "others": F.count("*").over(Window.partitionBy("q")) - F.row_number().over(upto) + 1})
    bound = F.expr("CASE WHEN least > coalesce(before, 0) THEN (least - 1 - coalesce(before, 0)) div others ELSE 0 END")
    cuts = placed.join(least, "q", "left").groupBy("q").agg(F.max(F.coalesce(bound, F.lit(0))).alias("below"), F.coalesce(F.first("least"), F.lit(1)).alias("least"))
    rest = F.sum(F.least("top", "below")).over(Window.partitionBy("q"))
    return wanted.join(cuts, "q").select("q", "t", "top", (F.col("below") + 1).alias("cut"), rest.alias("rest"), "least")


def search(items: DataFrame, docs: DataFrame, k: int = 50, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """(item, rank, id, score): the k documents of the highest scores above 0 of each item, equal scores by ascending id (null first).

    A score is the sum of the parts of the item's distinct terms: the term's weight floor(1000 ln((2 N + 2) / (2 df + 1)))
    times (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L; N are the rows with a term, L all their terms, n a row's,
    df the rows that hold the term and tf how often one does. Text is folded from A-Z to a-z only.

    Null and empty texts have no term: such documents do not count, such items have no result. Rows that repeat an id are
    documents, or items, of their own. Texts may have any length; an empty table gives no rows; other columns
    are ignored. Phases pass each other written tables. `report`, if given, gets the numbers of postings of all
    (item, term) pairs, of those fetched by threshold, and of candidates.
    """
    spark = docs.sparkSession
    with scratch_scope(spark) as keep:
        asked = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"), F.array_distinct(terms(F.col(text_col))).alias("terms"))
        asked, _ = materialize(asked.select("q", "item", F.explode("terms").alias("term")), "lexical-asked")
        vocabulary, _ = materialize(asked.select("term").distinct(), "lexical-vocabulary")
        index = Index(docs, vocabulary, id_col, text_col)
        wanted, _ = materialize(asked.join(index.terms_, "term").select("q", "t", "w", "top"), "lexical-wanted")

        # Heads of the lists, and the score that the k best of the rows leading in them have.
        place = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("part"), "row"))
        heads = index.postings.withColumn("place", place).where(F.col("place") <= k)
        partial = wanted.join(heads, "t").groupBy("q", "row").agg(F.sum("part").alias("score"))
        first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
        leading, _ = materialize(partial.withColumn("place", first).where(F.col("place") <= SEEDS * k).select("q", "row"), "lexical-heads")
        known, _ = materialize(index.scores(leading, wanted), "lexical-known")
        cut, _ = materialize(thresholds(wanted.select("q", "t", "top"), _kth(known, k, "q", "score", "least")).join(wanted.select("q", "t", "w"), ["q", "t"]), "lexical-cuts")

        # The terms of all queries go to every task if they are few, so that entries stay with their rows; else by a plain join.
        small = F.broadcast if cut.count() <= BROADCAST else lambda df: df
        # Every list from its queries' thresholds on. Entries go to their row's task once, whatever queries share them.
        floors = cut.groupBy("t").agg(F.min("cut").alias("floor"))
        sent = index.postings.join(small(floors), "t").where("part >= floor").select("t", "part", "row", "unit").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
        met = sent.join(small(cut), "t").where("part >= cut")
        seen = met.groupBy("q", "row").agg(F.sum("part").alias("score"), F.sum(F.expr("cut - 1")).alias("bound"), F.first("rest").alias("rest"), F.first("least").alias("least"), F.first("cut").alias("cut"), F.first("unit").alias("unit"))
        # What a row may have in lists that did not send it: no more than the cut allows in each, and nothing where one
        # occurrence would have been sent.
        seen = seen.where("score + rest - bound >= least")
        # For each step of units, from its least on: a list is silent in a row where one occurrence counts below the cut.
        steps = F.array(*[F.sum(F.when(F.col("w") * (i * STEP) < F.col("cut"), F.expr("least(top, cut - 1)")).otherwise(F.lit(0))) for i in range(UNITS // STEP + 1)])
        silent = cut.groupBy("q").agg(steps.alias("steps"))
        most = F.col("score") + F.least(F.col("rest") - F.col("bound"), F.get("steps", F.expr(f"unit div {STEP}").cast("int")))
        seen = seen.join(small(silent), "q").select("q", "row", "score", most.alias("most"), "least").where("most >= least")
        seen, _ = materialize(seen.drop("least"), "lexical-seen")
        better = _kth(seen, k, "q", "score", "more")
        near, _ = materialize(seen.join(better, "q", "left").where("most >= coalesce(more, 1)").select("q", "row", "score"), "lexical-candidates")

        # Exact scores: the entries of candidates below the thresholds, from the rows that are any.
        left = possibly_in(index.postings, [F.col("row")], near.select("row")).where("__maybe").join(small(cut), "t").where("part < cut")
        below = left.select("q", "row", "part").join(near.select("q", "row"), ["q", "row"], "left_semi")
        exact = near.union(below).groupBy("q", "row").agg(F.sum("score").alias("score"))
        named = exact.join(index.rows, "row")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc", "row")
        best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        owners = asked.select("q", "item").distinct()
        out = best.join(owners, "q").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
        out, path = materialize(out, "lexical-results")
        if report is not None:
            report["postings"] = wanted.join(index.postings.groupBy("t").count(), "t").agg(F.sum("count")).first()[0] or 0
            report["fetched"] = cut.join(index.postings, "t").where("part >= cut").count()
            report["seen"], report["candidates"] = seen.count(), near.count()
        keep.append(path)
    return out
