"""Conversation memory: the newest turns of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int = 10, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest ``n`` turns with ``back``, 1 for the newest."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))).cast("long")).where(F.col("back") <= n)


def summary(turns: DataFrame, n: int = 3, cut: int = 100, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest ``n`` turns as lines, oldest first; answers are cut to ``cut`` characters and end in dots."""
    line = F.when(F.col("role") == "assistant", F.concat(F.lit("A: "), F.substring("text", 1, cut), F.lit("..."))).otherwise(F.concat(F.lit("Q: "), F.col("text")))
    rows = last_turns(turns, n, by, order).select(by, order, line.alias("line"))
    lines = F.sort_array(F.collect_list(F.struct(order, "line")))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"))


def augment(questions: DataFrame, summaries: DataFrame, by: str = "conv_id") -> DataFrame:
    """Questions with the summary of what was said before in front; unchanged without one."""
    both = questions.join(summaries, by, "left")
    text = F.concat(F.lit("Previous conversation:\n"), F.col("summary"), F.lit("\n\nCurrent question: "), F.col("text"))
    return both.withColumn("augmented", F.coalesce(text, F.col("text"))).drop("summary")
