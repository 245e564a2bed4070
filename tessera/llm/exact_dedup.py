"""Exact de-duplication by most-significant-digit radix partitioning of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import join_few, possibly_in
from tessera.session import materialize, remove, scratch_scope

#: The first digit is this many bytes; each further digit is GROWTH times as long, so that a text
#: of b bytes is settled after log(b) rounds.
FIRST_DIGIT = 256
GROWTH = 16


def _split(rows: DataFrame, digit: list) -> DataFrame:
    """One radix pass: the rows whose (grp, digit) is not theirs alone, with their new group.

    Class counts are combined before the shuffle, so a class of any size costs a row a task. The
    repeated classes are written, so that the join back is a plain equi-join of two shuffles whose
    large side adaptive execution may split; or a broadcast, where Spark measures the classes as
    small. Rows that a bitmap of the repeated classes does not have are alone, and their texts stay
    where they are.
    """
    keyed = rows.select("rid", "doc", "txt", "len", *digit)
    classes = keyed.groupBy("grp", "digit").agg(F.min("rid").alias("next"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes, _ = materialize(classes, "exact-classes")
    keyed = possibly_in(keyed, [F.col("grp"), F.col("digit")], classes.select("grp", "digit")).where("__maybe").drop("__maybe")
    return keyed.join(classes, ["grp", "digit"]).select("rid", "doc", "txt", "len", F.col("next").alias("grp"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are. Groups are split by length and by successive blocks of bytes
    (the digits) until they hold one document or their texts have ended; no digest takes part in the
    comparison, text_sha256 is only reported. Of a group the row with the largest id stays.

    A null text counts as empty, and all empty texts are one group. A null id is smaller than any
    other; a group of null ids has a null keep_id. Of repeated rows (equal id and text) with the
    largest id exactly one is kept. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.encode(text, "UTF-8").alias("txt"))
    # Row numbers must stay the same in every later read, so the numbered table is written once.
    base, base_path = materialize(base, "exact-base")
    rows = base.select("*", F.octet_length("txt").alias("len"))
    at, width = 0, FIRST_DIGIT
    parts, path = [], None
    digit = [F.col("len").cast("long").alias("grp"), F.expr(f"substring(txt, 1, {width})").alias("digit")]
    while True:
        active, to = materialize(_split(rows, digit), "exact-round")
        if path:
            remove(spark, path)
        rows, path = active, to
        at += width
        parts.append(rows.where(F.col("len") <= at).select("rid", "doc", "grp"))
        # Ended groups are settled: write them without their texts before this round's table goes.
        parts[-1], _ = materialize(parts[-1], "exact-done")
        rows = rows.where(F.col("len") > at)
        if rows.isEmpty():
            break
        width *= GROWTH
        digit = [F.col("grp"), F.expr(f"substring(txt, {at + 1}, {width})").alias("digit")]
    remove(spark, path)
    grouped = parts[0]
    for part in parts[1:]:
        grouped = grouped.union(part)
    # Nulls come first in a struct's order, so a null id never wins over another.
    totals = grouped.groupBy("grp").agg(F.max(F.struct("doc", "rid")).alias("top"), F.count("*").alias("group_size"))
    totals, _ = materialize(totals, "exact-totals")
    known = grouped.join(totals, "grp").select("rid", F.col("top.doc").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"))
    hashed = base.select("rid", "doc", F.sha2("txt", 256).alias("text_sha256"))
    return hashed.join(known, "rid", "left").select(
        F.col("doc").alias(id_col),
        F.when(F.col("kept").isNull(), F.col("doc")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns (see duplicate_groups).

    Rows that go are known by id and text digest, which tell them apart where rows repeat an id; the other
    rows are not moved. Where rows repeat both id and text one of them stays, the one with the least
    values in the remaining columns, by their hash.
    """
    with scratch_scope(docs.sparkSession) as keep:
        groups = duplicate_groups(docs, id_col, text_col).where(~F.col("kept"))
        gone, path = materialize(groups.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__of"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("__again")).distinct(), "exact-gone")
        keep.append(path)
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__of"))
    repeated = not gone.where("__again").isEmpty()

    def exact(few: DataFrame) -> DataFrame:
        tagged = few.withColumn("__sha", sha)
        if not repeated:
            return tagged.join(gone, same, "left_anti").drop("__sha")
        stay = tagged.join(gone.where("NOT __again"), same, "left_anti")
        copies = stay.join(gone.where("__again"), same, "left_semi")
        row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in few.dtypes if "map<" not in kind])
        one = copies.groupBy(F.col(id_col).alias("__id"), "__sha").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in few.columns]), row).alias("__one")).select("__one.*", "__sha")
        return stay.join(gone.where("__again"), same, "left_anti").union(one).drop("__sha")

    return join_few(docs, [F.col(id_col)], gone.select("__id"), exact)
