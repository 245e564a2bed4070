"""Joins with a small share of a large table, which leave the rest of its rows where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap of hashed keys, which bounds what is broadcast: 4 MB, or 16 MB where MANY is asked for, however many
#: keys there are. With n keys a row without a partner is moved in vain with probability 1 - exp(-n / bits) at most.
BITS, MANY = 1 << 25, 1 << 27
#: Bits that bitmap_construct_agg puts into one value.
CHUNK = 1 << 15


def possibly_in(rows: DataFrame, key: list[Column], keys: DataFrame, bits: int = BITS) -> DataFrame:
    """rows with a column __maybe: false only if no row of `keys` (all its columns, in order, of the types of `key`)
    equals key. A null equals a null. Nothing of rows is shuffled; the keys' hashes are, and a bitmap of
    them with one bit a hash is broadcast."""
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    at = keys.select(place([F.col(c) for c in keys.columns]).alias("__at"))
    # Dealt by chunk first, so that hashes are shuffled and not a bitmap of each task.
    chunks = at.select(F.expr(f"cast(__at div {CHUNK} as int)").alias("__chunk"), (F.col("__at") % CHUNK).alias("__bit")).repartition("__chunk").groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    # As words of 64 bits, byte 0 first, so that a row's bit is one place of an array and a shift.
    word = lambda i: F.conv(F.hex(F.substring("__bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = chunks.select("__chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1)), word).alias("__words"))
    placed = rows.withColumn("__at", place(key)).withColumn("__of", F.expr(f"cast(__at div {CHUNK} as int)"))
    met = placed.join(F.broadcast(words), F.col("__of") == F.col("__chunk"), "left")
    held = F.get("__words", F.expr(f"cast((__at & {CHUNK - 1}) >> 6 as int)"))
    bit = F.call_function("shiftright", held, F.expr("cast(56 - (__at & 56) + (__at & 7) as int)")).bitwiseAND(F.lit(1).cast("long"))
    return met.withColumn("__maybe", F.coalesce(bit == 1, F.lit(False))).drop("__at", "__of", "__chunk", "__words")


def join_few(rows: DataFrame, key: list[Column], keys: DataFrame, join: Callable[[DataFrame], DataFrame], bits: int = BITS) -> DataFrame:
    """What `join` makes of the rows that may have a partner in keys, together with all other rows unchanged.

    join gets rows of the same columns and returns such; it has to be exact, as some rows come to it by chance.
    """
    marked = possibly_in(rows, key, keys, bits)
    return marked.where(~F.col("__maybe")).drop("__maybe").union(join(marked.where("__maybe").drop("__maybe")))
