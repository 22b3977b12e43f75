"""Conversation memory: the last exchanges, topic shifts, and what a conversation has gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, exchange, question, answer): a user's turn and the assistant's turn right behind it, numbered from 1."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    pair = turns.withColumn("next_role", F.lead("role").over(by)).withColumn("answer", F.lead("text").over(by)).filter("role = 'user' AND next_role = 'assistant'")
    return pair.select("conv_id", F.row_number().over(by).cast("long").alias("exchange"), F.col("text").alias("question"), "answer")


def recent(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The last k exchanges of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("exchange"))
    return pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def history(pairs: DataFrame, k: int = 5) -> DataFrame:
    """(conv_id, messages, history): the remembered exchanges as lines for a prompt."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("exchange", "question", "answer"))), lambda x: F.concat(F.lit("User: "), x["question"], F.lit("\nAssistant: "), x["answer"]))
    return recent(pairs, k).groupBy("conv_id").agg((2 * F.count("*")).alias("messages"), F.array_join(lines, "\n").alias("history"))


def topic_shifts(pairs: DataFrame, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """(conv_id, exchange, overlap, clear): the part of a question's words that the k questions before it held; clear if under the threshold.

    The first question of a conversation clears nothing, nor does one without words.
    """
    low = F.filter(F.array_distinct(F.split(F.lower("question"), r"\s+")), lambda w: w != "")
    before = F.array_distinct(F.flatten(F.collect_list("words").over(Window.partitionBy("conv_id").orderBy("exchange").rowsBetween(-k, -1))))
    rows = pairs.withColumn("words", low).withColumn("known", before)
    overlap = F.size(F.array_intersect("words", "known")) / F.size("words")
    usable = (F.size("known") > 0) & (F.size("words") > 0)
    return rows.select("conv_id", "exchange", F.when(usable, overlap).alias("overlap"), F.coalesce(usable & (overlap < threshold), F.lit(False)).alias("clear"))


def state(turns: DataFrame, sources: int = 10) -> DataFrame:
    """(conv_id, queries, last_topic, sources, words): counter, last question, last distinct sources (here: roles and turns), distinct words."""
    own = turns.withColumn("s", F.concat_ws("#", "role", F.col("turn").cast("string")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"])
    return own.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("queries"),
        F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("last_question"),
        F.array_join(F.slice(F.array_distinct(ordered), -F.least(F.size(F.array_distinct(ordered)), F.lit(sources)), F.lit(sources)), ",").alias("sources"),
        F.size(F.array_distinct(F.flatten(F.collect_list(text.tokens("text"))))).cast("long").alias("words"),
    )
