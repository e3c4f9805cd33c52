"""Access observations, content caches, and decisions from evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scores import first_match

def matrix(seen: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Routes by roles: the last status that each role got (route, method, role, status, seq); absent roles count as
    `user`, absent methods as GET. With the roles named, the pivot is one aggregate."""
    named = seen.withColumns({"role": F.coalesce("role", F.lit("user")), "method": F.coalesce("method", F.lit("GET"))})
    return named.groupBy("route", "method").pivot("role", list(roles)).agg(F.max_by("status", "seq"))


def cached(sources: DataFrame, cache: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached result, misses) by the content's digest; the cache is (digest, result)."""
    keyed = sources.withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    return keyed.join(cache, "digest"), keyed.join(cache, "digest", "left_anti")


def decided(evidence: DataFrame, subject: str) -> DataFrame:
    """(subject, outcome) of observations (subject, required, primary, result true, false or null): a required one without
    a result leaves it open, a failed one means a bypass, and without a primary one nothing is enforced."""
    a = evidence.groupBy(subject).agg(
        F.bool_or(F.col("required") & F.col("result").isNull()).alias("open"), F.bool_or(F.coalesce(~F.col("result"), F.lit(False))).alias("failed"),
        F.bool_or(F.col("primary") & F.coalesce("result", F.lit(False))).alias("proved"),
    )
    outcome = first_match([(F.col("open"), "inconclusive"), (F.col("failed"), "bypassed"), (F.col("proved"), "enforced")], "inconclusive")
    return a.select(subject, outcome.alias("outcome"))


def learned(claims: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Confidences after verdicts: confirmed ones rise by 0.2 up to 0.99, refuted ones fall by 0.3 down to 0.01; with the
    reward each verdict gives its arm."""
    j = claims.join(verdicts.select(key, "verdict"), key, "left")
    c = F.when(F.col("verdict") == "confirmed", F.least(F.lit(0.99), F.col("confidence") + 0.2)).when(F.col("verdict") == "refuted", F.greatest(F.lit(0.01), F.col("confidence") - 0.3)).otherwise(F.col("confidence"))
    reward = F.when(F.col("verdict") == "confirmed", 1.0).when(F.col("verdict") == "refuted", 0.0).when(F.col("verdict").isNotNull(), 0.3)
    return j.select(*[c.alias(x) if x == "confidence" else F.col(x) for x in claims.columns], reward.alias("reward"))
