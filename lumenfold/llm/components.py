"""Connected components by contraction, on tables alone: links never reach the driver, only counts do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that has a link to another node; root is the smallest node reached.

    Each round hooks a node to its smallest neighbour or itself, follows the hooks to their ends by doubling, and
    contracts the links to those ends; what is left shrinks by half or more. Every round is a table in the shared
    folder, joined by sorting, so the driver holds none. Rows with a null end are ignored; repeated links and loops change nothing.
    """
    spark = links.sparkSession
    live = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), spark)
    label = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), spark)
        while True:
            above = hook.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            hook = written(hook.join(above.hint("merge"), F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("to"), "up"), spark)
            moved = not hook.filter("to < up").isEmpty()
            hook = hook.select("node", F.col("to").alias("up"))
            if not moved:
                break
        if label is None:
            label = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            label = written(label.join(step.hint("merge"), F.col("root") == F.col("n2"), "left").select("node", F.coalesce("up2", "root").alias("root")), spark)
        h1, h2 = hook.select(F.col("node").alias("a"), F.col("up").alias("x")), hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        live = written(live.join(h1.hint("merge"), "a").join(h2.hint("merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), spark)
    return live.select(F.col("a").alias("node"), F.col("b").alias("root")) if label is None else label
