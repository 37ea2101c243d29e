"""Votes of several scorers on one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS_SCORE, FINAL_SCORE, FALLBACK_SCORE = 55, 50, 40


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def combined(votes: DataFrame, key: str, scorer_rank: str, scorer: str, score: str, mode: str = "union") -> DataFrame:
    """Per key: final_score (rounded mean), passed, winner, n_votes. Of equal scores the later scorer wins.

    consensus asks for all votes, majority for more than half, union for one; the mean must reach
    FINAL_SCORE too. Keys come from ``votes`` with a null scorer standing for no vote at all."""
    n, passing = F.count(score), F.count_if(F.col(score) >= PASS_SCORE)
    enough = {"consensus": passing == n, "majority": passing > n / 2, "union": passing >= 1}[mode]
    mean = half_up(F.avg(F.col(score).cast("double")))
    return votes.groupBy(key).agg(
        F.when(n == 0, FALLBACK_SCORE).otherwise(mean).cast("bigint").alias("final_score"),
        F.when(n == 0, True).otherwise(enough & (mean >= FINAL_SCORE)).alias("passed"),
        F.coalesce(F.max_by(scorer, F.when(F.col(score).isNotNull(), F.struct(F.col(score), F.col(scorer_rank)))), F.lit("fallback")).alias("winner"),
        n.cast("bigint").alias("n_votes"),
    )


def filled_best(results: DataFrame, key: str, score: str, scorer_rank: str, fill: list[str]) -> DataFrame:
    """The highest-scored result of each key, its missing fields from the runners-up in order.

    Blank texts and zeros count as missing. One aggregation: each field takes the value that
    comes first among those that have one."""
    place = F.struct(-F.col(score), F.col(scorer_rank))

    def present(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.col(c).isNotNull() & (text != "") & ~text.isin("0", "0.0")

    return results.groupBy(key).agg(
        F.max(score).alias("best_score"),
        F.min_by(scorer_rank, place).alias("best_scorer"),
        *[F.min_by(F.when(present(c), F.col(c)), F.when(present(c), place)).alias(c) for c in fill],
    )


def vote_list(votes: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """All votes of a key as one array in the scorers' order. Scorers are few by nature."""
    return votes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("v")).select(key, F.transform("v", lambda x: x["t"]).alias("votes"))


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
