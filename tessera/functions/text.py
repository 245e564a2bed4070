"""Tokens, vocabularies, and string similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stemming import stems
from tessera.operators.ranking import running_sum

#: A short list of frequent English function words (fixed values).
STOP_WORDS = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "between", "both", "but", "by", "can", "did", "do", "does", "during", "each", "for", "from", "had", "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your")
# Token patterns of molecule strings.
SMILES_TOKEN = r"\[|]|Cl|Br|Si|Se|Na|Ca|Li|Mg|Zn|Fe|Cu|Mn|Hg|Sn|As|Bi|Cd|se|Cr|Sb|[A-Z]|[a-z]|[=#/\\().+\-:]|\d"
DEEPSMILES_TOKEN = SMILES_TOKEN + r"|\)+|\(+"
SELFIES_TOKEN = r"\[.*?]"
PAD, UNKNOWN = "<pad>", "<unk>"
#: What a word may consist of.
KINDS = {"alpha": r"^[a-z]+$", "alnum": r"^[a-z0-9]+$", "ascii": r"^[\x00-\x7f]+$"}


def tokenize(text: Column, chars: str | None = "alpha", pattern: str | None = None, stop_words: tuple[str, ...] = STOP_WORDS, stem: bool = False) -> Column:
    """Lower-case words of the text without stop words, of the given kind, and matching pattern if given; their stems if asked."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stop_words])
    out = F.filter(words, lambda w: ~F.array_contains(stop, w)) if stop_words else words
    if chars:
        out = F.filter(out, lambda w: w.rlike(KINDS[chars]))
    out = F.filter(out, lambda w: w.rlike(pattern)) if pattern else out
    return stems(out) if stem else out


def split_tokens(text: Column, pattern: str = SMILES_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def vocabulary(df: DataFrame, col: str, order: str, pattern: str | None = SMILES_TOKEN, padding: bool = True) -> DataFrame:
    """(token, n, id): the tokens by falling frequency, ties by where they are first seen (row order, position).

    `<pad>` has id 0 if padding; `<unk>` is last. One row a token is numbered.
    """
    tokens = split_tokens(F.col(col), pattern) if pattern else F.col(col)
    seen = df.select(F.col(order).alias("row"), F.posexplode(tokens).alias("pos", "token"))
    counts = seen.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first"))
    shift = 1 if padding else 0
    ranked = running_sum(counts, [F.desc("n"), F.col("first")], F.lit(1), "rank").select("token", "n", (F.col("rank") - 1 + shift).cast("int").alias("id"))
    spark = df.sparkSession
    last = ranked.agg(F.lit(UNKNOWN).alias("token"), F.lit(0).cast("long").alias("n"), (F.coalesce(F.max("id"), F.lit(shift - 1)) + 1).cast("int").alias("id"))
    out = ranked.union(last)
    return spark.createDataFrame([(PAD, 0, 0)], "token string, n long, id int").union(out) if padding else out


def encode(df: DataFrame, col: str, vocab: dict[str, int], max_length: int | None = None, pattern: str | None = SMILES_TOKEN) -> DataFrame:
    """Adds tokens (ids, padded up to max_length) and length; unknown tokens have the id of `<unk>`, or -1.

    Texts of more than max_length tokens are an error.
    """
    tokens = split_tokens(F.col(col), pattern) if pattern else F.col(col)
    known = F.create_map(*[x for t, i in vocab.items() for x in (F.lit(t), F.lit(i))])
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.lit(vocab.get(UNKNOWN, -1))))
    out = df.withColumn("length", F.size(tokens))
    if max_length is not None:
        fits = F.assert_true(F.col("length") <= max_length, "more tokens than max_length").isNull()
        ids = F.when(fits, F.concat(ids, F.array_repeat(F.lit(vocab.get(PAD, 0)), F.greatest(F.lit(0), F.lit(max_length) - F.col("length")))))
    return out.withColumn("tokens", ids)


def decode(ids: Column, vocab: dict[str, int]) -> Column:
    """The text of token ids, without padding."""
    names = F.create_map(*[x for t, i in vocab.items() for x in (F.lit(i), F.lit(t))])
    return F.array_join(F.filter(F.transform(ids, lambda i: F.try_element_at(names, i)), lambda t: t != PAD), "")


def attention_mask(length: Column, max_length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: i <= length)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, to 3 digits; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.round(F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest), 3)


def string_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.round(F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest), 3)


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths; 1 for two empty strings. Bit-parallel."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    common = len(a) - free.bit_count()
    return 2 * common / (len(a) + len(b))


def similar_strings(queries: DataFrame, targets: DataFrame, query_col: str, target_col: str, method: str = "levenshtein", threshold: float = 0.75, num_matches: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query, target, similarity, rank): per query its best targets of at least the threshold, ties by target.

    A similarity of s bounds the ratio of lengths, so only strings of near lengths meet: targets are
    joined on length bands, not by all pairs.
    """
    ratio = threshold if method == "levenshtein" else threshold / (2 - threshold)
    q = queries.select(F.col(query_col).alias("query")).where("query is not null").distinct().withColumn("ql", F.length("query"))
    t = targets.select(F.col(target_col).alias("target"), *keep).where("target is not null").distinct().withColumn("tl", F.length("target"))
    if threshold > 0:
        q = q.withColumn("band", F.explode(F.sequence(F.floor(F.col("ql") * ratio), F.ceil(F.col("ql") / ratio))))
        met = q.join(t.withColumn("band", F.col("tl").cast("long")), "band")
    else:
        met = q.crossJoin(t)
    if method == "levenshtein":
        scored = met.withColumn("similarity", levenshtein_similarity(F.col("query"), F.col("target")))
    else:

        @F.pandas_udf("double")
        def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([round(indel_ratio(x, y), 3) for x, y in zip(a, b, strict=True)])

        scored = met.withColumn("similarity", fuzzy("query", "target"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "target"))
    return scored.where(F.col("similarity") >= threshold).withColumn("rank", rank).where(F.col("rank") <= num_matches).select("query", "target", "similarity", "rank", *keep)
