"""Topic models over tokenized documents."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def lda_topics(df: DataFrame, tokens_col: str, id_col: str, no_below: int = 3, no_above: float = 0.7, num_topics: int = 64, passes: int = 16, top: int = 16, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(topics, assignments): the `top` words of each topic with weights, and each document's topic.

    Words in fewer than no_below documents or more than no_above of them are left out.
    """
    vectorizer = CountVectorizer(inputCol=tokens_col, outputCol="__bag", minDF=float(no_below), maxDF=float(no_above)).fit(df)
    bags, _ = materialize(vectorizer.transform(df.select(id_col, tokens_col)).select(id_col, "__bag"), "lda-bags")
    model = LDA(k=num_topics, maxIter=passes, seed=seed, optimizer="online", featuresCol="__bag").fit(bags)
    words = F.array(*[F.lit(w) for w in vectorizer.vocabulary])
    topics = model.describeTopics(top).select(F.col("topic"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")).select("topic", "rank", F.get(words, F.col("t.termIndices")).alias("word"), F.col("t.termWeights").alias("weight"))
    from pyspark.ml.functions import vector_to_array

    share = F.posexplode(vector_to_array("topicDistribution"))
    best = model.transform(bags).select(id_col, share.alias("topic", "share")).withColumn("rn", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("share"), "topic"))).where("rn = 1").drop("rn")
    return topics, best


def coherence(df: DataFrame, tokens_col: str, topics: DataFrame) -> DataFrame:
    """(topic, coherence): UMass coherence of each topic's words, from counts of documents with both."""
    spoken = df.select(F.monotonically_increasing_id().alias("d"), F.explode(F.array_distinct(tokens_col)).alias("word")).join(F.broadcast(topics.select("word").distinct()), "word")
    spoken, _ = materialize(spoken, "coherence")
    single = spoken.groupBy("word").agg(F.count("*").alias("n"))
    pairs = topics.alias("a").join(topics.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") > F.col("b.rank"))).select(F.col("a.topic").alias("topic"), F.col("a.word").alias("w1"), F.col("b.word").alias("w2"))
    # Bounded by the words of the topics squared.
    together = spoken.select("d", F.col("word").alias("w1")).join(spoken.select("d", F.col("word").alias("w2")), "d").groupBy("w1", "w2").agg(F.count("*").alias("both"))
    joined = pairs.join(together, ["w1", "w2"], "left").join(single.select(F.col("word").alias("w2"), "n"), "w2")
    return joined.groupBy("topic").agg(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1) / F.col("n"))).alias("coherence"))
