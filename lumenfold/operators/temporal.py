"""Order of events: what is taken and never given back, and calls that nothing handles.

Taking pushes, giving back pops, and giving back when nothing is held changes nothing. With S the running sum of +1 and -1,
what is held after an event is S less the smallest S so far, if that is below zero; something taken is given back if later on
less is held than with it. Both are running minima, which are put together from parts: units with very many events are
spread over partitions, each of which is summed up by two numbers, and every row is then settled from its own part and the
sums of those before or after it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.tables import cut_lineage

# Parts of names that take and that give back, and what an unmatched one is worth.
RESOURCE = {"take": ("acquire", "lock", "connect", "open", "begin", "start"), "give": ("release", "unlock", "close", "disconnect", "end", "stop", "commit", "rollback"), "confidence": 0.82}
LOCK = {"take": ("acquire", "lock("), "give": ("release", "unlock"), "confidence": 0.80}
FILE = {"take": ("open",), "give": ("close",)}


def _any(name: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def steps(operation: Column) -> Mapping[str, Column]:
    """For each kind of thing what an operation does to it: 1 takes, -1 gives back, 0 neither or both at once."""
    name = F.lower(operation)
    take, give = _any(name, RESOURCE["take"]), _any(name, RESOURCE["give"])
    locks = name.contains("lock")
    return {
        "resource": F.when(take & ~give, 1).when(give & ~take, -1).otherwise(0),
        "lock": F.when(locks & _any(name, LOCK["take"]), 1).when(locks & _any(name, LOCK["give"]), -1).otherwise(0),
        "file": F.when(_any(name, FILE["take"]) & ~_any(name, FILE["give"]), 1).when(_any(name, FILE["give"]), -1).otherwise(0),
    }


def unreleased(events: DataFrame, units: Sequence[str], order: Sequence[str], step: str) -> DataFrame:
    """The rows of `events` that take something (step 1) which nothing later in their unit gives back, with `held`: how much
    is held once they have. `order` must tell rows of a unit apart; a null step counts as 0."""
    e = events.withColumn("_step", F.coalesce(step, F.lit(0))).filter("_step <> 0")
    e = cut_lineage(e.repartitionByRange(*units, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *units).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_sum", F.sum("_step").over(so_far))
    e = e.withColumn("_low", F.min("_sum").over(so_far))
    # What each part does to its unit: by how much it moves the sum, and how low the sum gets inside it.
    before = Window.partitionBy(*units).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = e.groupBy("_part", *units).agg(F.sum("_step").alias("_move"), F.min("_low").alias("_dip"))
    parts = parts.withColumn("_base", F.coalesce(F.sum("_move").over(before), F.lit(0)))
    parts = parts.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_dip")).over(before), F.lit(0))))
    e = _with_parts(e, parts.select("_part", *units, "_base", "_floor"), units)
    held = F.col("_base") + F.col("_sum") - F.least("_floor", F.col("_base") + F.col("_low"))
    e = cut_lineage(e.withColumn("held", held).drop("_sum", "_low", "_base", "_floor"))
    after = Window.partitionBy(*units).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    least = e.groupBy("_part", *units).agg(F.min("held").alias("_least"))
    least = least.withColumn("_later", F.min("_least").over(after)).drop("_least")
    e = _with_parts(e, least, units).withColumn("_next", F.min("held").over(here.rowsBetween(1, Window.unboundedFollowing)))
    kept = (F.col("_step") == 1) & (F.coalesce(F.least("_next", "_later"), F.col("held")) >= F.col("held"))
    return e.filter(kept).select(*events.columns, F.col("held").cast("long").alias("held"))


def _with_parts(e: DataFrame, parts: DataFrame, units: Sequence[str]) -> DataFrame:
    p = parts.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(("_part", *units))], *[c for c in parts.columns if c not in ("_part", *units)])
    same = F.col("_part") == F.col("_p0")
    for k, u in enumerate(units):
        same &= F.col(u).eqNullSafe(F.col(f"_p{k + 1}"))
    return e.join(p, same).drop(*[f"_p{k}" for k in range(len(units) + 1)])


def unhandled(calls: DataFrame, handled: DataFrame, unit: str, external: Column) -> DataFrame:
    """(unit, n): how many external calls a unit makes, of units that handle no error at all (handled holds those that do)."""
    return calls.filter(external).groupBy(unit).agg(F.count(F.lit(1)).alias("n")).join(handled.select(unit).distinct(), unit, "left_anti")
