"""Evaluation against labelled truth: confusion, rates with intervals, stability over runs, distributions, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scores import ratio, wilson


def confusion(df: DataFrame, expected: str, observed: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(observed).alias("observed")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each group; 0 where undefined. With groups, a rollup adds the total."""
    grouped = df.rollup(*by) if by else df.groupBy()
    n = grouped.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def intervals(df: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """Successes, trials and the Wilson interval of each group."""
    n = df.groupBy(*by).agg(F.count_if(hit).alias("successes"), F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("successes"), F.col("total"))
    return n.withColumns({"low": low, "high": high})


def least_successes(totals: DataFrame, total: str, target: float, z: float = 1.959963984540054) -> DataFrame:
    """The least number of successes whose lower bound exceeds the target, for each number of trials; null if none.

    The lower bound is the target where the share is target + z * sqrt(target * (1 - target) / trials); the numbers around
    that one are tried, so rounding decides nothing."""
    n = F.col(total).cast("long")
    near = F.floor(n * target + z * F.sqrt(n * target * (1 - target)))
    tried = F.filter(F.sequence(near - 1, near + 2), lambda s: (s >= 0) & (s <= n) & (wilson(s, n, z)[0] > target))
    return totals.select(total).distinct().select(total, F.array_min(tried).alias("needed"))


def stability(df: DataFrame, item: str, run: str) -> DataFrame:
    """In how many runs each item is seen, with flags for all of them and for a strict majority."""
    runs = df.agg(F.countDistinct(run).alias("runs"))
    seen = df.groupBy(item).agg(F.countDistinct(run).alias("seen"))
    return seen.join(F.broadcast(runs)).select(item, "seen", (F.col("seen") == F.col("runs")).alias("in_all"), (2 * F.col("seen") > F.col("runs")).alias("in_majority"))


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("span"))


def gates(metrics: DataFrame, name: str, value: str, least: Mapping[str, float], most: Mapping[str, float]) -> DataFrame:
    """Each gated metric with its bound and whether it holds."""
    rows = [(k, v, True) for k, v in least.items()] + [(k, v, False) for k, v in most.items()]
    bounds = df_of(metrics, rows, f"{name} string, bound double, is_least boolean")
    holds = F.when(F.col("is_least"), F.col(value) >= F.col("bound")).otherwise(F.col(value) <= F.col("bound"))
    return metrics.join(F.broadcast(bounds), name).select(name, value, "bound", holds.alias("passed"))


def df_of(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def verdicts(evidence: DataFrame, goal: str, confidence: str, supports: str) -> DataFrame:
    """Noisy-or of what supports a goal: 0.7 confirms; up to 0.2 with two refuting ones refutes; else inconclusive."""
    miss = F.sum(F.when(F.col(supports), F.log(F.greatest(1 - F.col(confidence), F.lit(1e-12)))).otherwise(F.lit(0.0)))
    n = evidence.groupBy(goal).agg((1 - F.exp(miss)).alias("score"), F.count_if(~F.col(supports)).alias("refuting"))
    return n.withColumn("verdict", F.when(F.col("score") >= 0.7, "confirmed").when((F.col("score") <= 0.2) & (F.col("refuting") >= 2), "refuted").otherwise("inconclusive"))


def posteriors(rewards: DataFrame, arm: str, reward: str) -> DataFrame:
    """Beta posteriors from uniform priors; the order of rewards doesn't matter."""
    n = rewards.groupBy(arm).agg((1 + F.sum(reward)).alias("alpha"), (1 + F.sum(1 - F.col(reward))).alias("beta"))
    return n.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
