"""Merging statements of one scope that say the same: the surer one stays and gains a little, in the order of the rows.

The rule is a loop: each row that is still there, in order, meets every later one that is still there, is alike and doesn't
contradict it; of the two the surer one stays (the first on a tie) and gains a tenth of the other's confidence. A row that has
lost goes on meeting others until its turn ends. Only rows of one cluster of alike texts affect each other, so clusters go
side by side: in a round each has the turn of its first row that hasn't had one, in one pass over the cluster's rows, sorted, of
which a task holds one at a time. Rows with equal words are one text while alike texts are searched, so copies build no
pairs. Rounds are as many as the most rows of a cluster that outlive their turn or had one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import graphs as G
from lumenfold.operators.likeness import alike_sets
from lumenfold.sources.tables import cut_lineage

# Fixed values.
ALIKE, GAIN, MOST = 0.9, 0.1, 0.99


def merged(rows: DataFrame, contradictions: DataFrame, least: float = ALIKE) -> DataFrame:
    """(scope, id, confidence, into) of rows (scope, id, place, text, confidence): `into` is null for rows that stay, else the id
    of the row that they went into last; place orders the rows of a scope, ids are unique in the table and places in a scope. contradictions
    (a, b) are pairs of ids, either way round, that never merge. Words are split at white space, in lower case; a text without words is
    like none. A null confidence is 0."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), ""))
    df = rows.select("scope", "id", "place", F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), F.array_sort(words).alias("words"))
    df = cut_lineage(df.withColumn("class", F.when(F.size("words") > 0, F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("scope").cast("string"), F.lit("\x1e")), F.array_join("words", "\x1f")), 256))))
    kinds = df.filter("class is not null").groupBy("scope", "class").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    # Scopes may be null, so the digest, which holds the scope, keeps apart what a join by scope would.
    kinds = cut_lineage(kinds.withColumn("scope", F.coalesce(F.col("scope").cast("string"), F.lit("\x1e"))))
    alike = cut_lineage(alike_sets(kinds, "class", "words", least, ["scope"]).select("a", "b"))
    place = G.clusters(kinds.select(F.col("class").alias("node")), alike.toDF("src", "dst"))
    size = df.filter("class is not null").join(place, F.col("class") == F.col("node")).groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    in_play = place.join(size.filter("members > 1"), "root").select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    live = cut_lineage(df.join(in_play, "class").select("cluster", "class", "id", "place", "confidence", F.lit(False).alias("done"), F.lit(None).cast(rows.schema["id"].dataType).alias("into")))
    alone = df.join(live.select("id"), "id", "left_anti").select("id", "confidence", F.lit(None).cast(rows.schema["id"].dataType).alias("into"))
    near = cut_lineage(alike.union(alike.select("b", "a")).union(kinds.select("class", "class")).toDF("class", "other"))
    apart = contradictions.select("a", "b").union(contradictions.select("b", "a")).distinct().toDF("head", "id")
    out = alone

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each cluster's rows come in order, its head first."""
        cluster, head, sure, lost = None, None, 0.0, None
        for b in batches:
            got = []
            for r in b.itertuples(index=False):
                if r.cluster != cluster:
                    if cluster is not None:
                        got.append((head, sure, lost))
                    cluster, head, sure, lost = r.cluster, r.id, r.confidence, None
                elif sure >= r.confidence:
                    sure = min(MOST, sure + r.confidence * GAIN)
                    got.append((r.id, r.confidence, head))
                else:
                    got.append((r.id, min(MOST, r.confidence + sure * GAIN), None))
                    lost = r.id
            yield pd.DataFrame(got, columns=["id", "confidence", "into"])
        if cluster is not None:
            yield pd.DataFrame([(head, sure, lost)], columns=["id", "confidence", "into"])

    kind = rows.schema["id"].dataType.simpleString()
    while not live.isEmpty():
        waits = live.filter(~F.col("done"))
        heads = cut_lineage(waits.groupBy("cluster").agg(F.min(F.struct("place", "id", "class", "confidence")).alias("h")).select("cluster", "h.*"))
        h = heads.select("cluster", F.col("id").alias("head"), F.col("class").alias("head_class"), F.col("place").alias("head_place"))
        met = waits.join(h, "cluster").filter(F.col("place") > F.col("head_place")).join(near.toDF("head_class", "class"), ["head_class", "class"], "left_semi").join(apart, ["head", "id"], "left_anti")
        both = met.select("cluster", "id", "place", "confidence").unionByName(heads.select("cluster", "id", "place", "confidence"))
        # Ids cross Python as text, as a batch with a null would make doubles of them.
        sent = both.withColumn("id", F.col("id").cast("string")).repartition("cluster").sortWithinPartitions("cluster", "place").select("cluster", "id", "confidence")
        after = cut_lineage(sent.mapInPandas(turns, "id string, confidence double, into string"))
        after = after.select(F.col("id").cast(kind).alias("id"), F.col("confidence").alias("_sure"), F.col("into").cast(kind).alias("_into"))
        live = live.join(after, "id", "left").join(heads.select("id", F.lit(True).alias("_head")), "id", "left")
        live = live.select("cluster", "class", "id", "place", F.coalesce("_sure", "confidence").alias("confidence"), (F.col("done") | F.coalesce("_head", F.lit(False)) | F.col("_into").isNotNull()).alias("done"), F.coalesce("_into", "into").alias("into"))
        live = cut_lineage(live)
        # A cluster in which nobody is left to have a turn is settled.
        open_ = live.filter(~F.col("done")).select("cluster").distinct()
        out = out.unionByName(live.join(open_, "cluster", "left_anti").select("id", "confidence", "into"))
        live = cut_lineage(live.join(open_, "cluster", "left_semi"))
    return rows.select("scope", "id").join(out, "id").select("scope", "id", "confidence", "into")
