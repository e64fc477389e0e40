"""Chat histories: the last messages, cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip, truncated

LAST, CHARS, ROLES = 12, 4000, ("user", "assistant")


def clean_history(turns: DataFrame, last: int = LAST, chars: int = CHARS) -> DataFrame:
    """(conv_id, turn, role, text): of the last messages of a conversation, those of users and assistants that say something, stripped and cut."""
    recent = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())) <= last
    kept = turns.withColumn("_recent", recent).where("_recent").drop("_recent")
    return kept.where(F.col("role").isin(*ROLES) & (strip(F.col("text")) != "")).select("conv_id", "turn", "role", truncated(strip(F.col("text")), chars).alias("text"))


def clean_messages(messages: Column, last: int = LAST, chars: int = CHARS) -> Column:
    """The same for an array<struct<role, content>>."""
    recent = F.slice(messages, F.greatest(F.size(messages) - last + 1, F.lit(1)), last)
    cleaned = F.transform(recent, lambda m: F.struct(m["role"].alias("role"), truncated(strip(m["content"]), chars).alias("content")))
    return F.filter(cleaned, lambda m: m["role"].isin(*ROLES) & (F.coalesce(m["content"], F.lit("")) != ""))
