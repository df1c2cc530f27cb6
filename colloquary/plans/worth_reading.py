"""From messages to the readable text of the discussions most worth keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colloquary.operators.consume import PART_TURNS, transcript
from colloquary.operators.select import discussion_stats, top_discussions, value_score


def worth_reading(messages: DataFrame, weights: dict[str, tuple[float, float]], k: int,
                  part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, score, body`` of the k best discussions."""
    best = top_discussions(value_score(discussion_stats(messages), weights), k)
    # one join by which only the chosen get their score; adaptive execution broadcasts a
    # small choice and splits a discussion that holds much of the texts
    chosen = messages.join(best.select("conv_id", "score"), "conv_id")
    return (transcript(chosen, part_turns, carry=["score"])
            .select("conv_id", "part", "score", "body"))
