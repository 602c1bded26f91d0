"""Recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import join_lookup


def latest_answers(log: DataFrame) -> DataFrame:
    """One answer per prompt: the last by ``seq`` when the log has that column."""
    order = F.col("seq") if "seq" in log.columns else F.lit(0)
    return log.groupBy("prompt_key").agg(
        F.max(F.struct(order.alias("seq"), F.col("raw")))["raw"].alias("raw")
    )


def attach_responses(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Prompts with their recorded answer; many prompts may share one text."""
    return join_lookup(prompts, latest_answers(log), "prompt_key")


def open_prompts(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Prompts without an answer yet."""
    return prompts.join(log.select("prompt_key").distinct(), "prompt_key", "left_anti")
