"""Reach, depth, components, confidence propagation, two-hop paths and cycles, on edge tables.

Rounds are cut with checkpoints in the shared folder; only counts reach the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenfold.functions.scores import logit, sigmoid
from lumenfold.sources.tables import Growing, cut_lineage

# Signs and weights of relations in propagation (fixed values).
RELATION = {"DEPENDS_ON": 0.7, "SUPPORTS": 1.0, "CONTRADICTS": -1.0, "MITIGATES": -0.5, "WEAKENS": -0.7}
OTHER_RELATION = 0.3
# Units up to this size are followed in one task each: their nodes, twice the edges and the entries at most, are bits of a number.
SMALL_EDGES, SMALL_ENTRIES = 24, 8


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): the least number of edges (src, dst) from any root (node); what no root reaches has no row."""
    found = Growing(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    front = found.rows()
    level = 0
    while True:
        level += 1
        ahead = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = found.add(ahead.join(found.rows(), "node", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            return found.rows()


def impact(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that a start node reaches, without the start nodes."""
    return depths(edges, start).filter("depth > 0").select("node")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node, edges taken both ways; root is the smallest node of the component.

    Labels spread to neighbours and jump along themselves, so rounds grow with the logarithm of a path's length."""
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    label = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    while True:
        low = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("root").alias("low"))
        new = label.join(low, label["node"] == low["src"], "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"))
        up = new.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = cut_lineage(new.join(up, new["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root")))
        old = label.withColumnRenamed("root", "was")
        same = new.join(old, "node").filter("root <> was").isEmpty()
        label = new
        if same:
            return label


def propagate(nodes: DataFrame, edges: DataFrame, rate: float = 0.15, rounds: int = 50, tolerance: float = 1e-3) -> DataFrame:
    """(node, confidence) after synchronous messages along (src, dst, relation, weight): logits move by
    rate * sign * weight * logit(src), 10 % of the prior stays, logits stay within 8; stops when nothing moves further
    than the tolerance."""
    sign = F.lit(OTHER_RELATION)
    for k, v in RELATION.items():
        sign = F.when(F.col("relation") == k, F.lit(v)).otherwise(sign)
    strength = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    e = cut_lineage(edges.select("src", "dst", (sign * strength).alias("pull")))
    state = cut_lineage(nodes.select("node", logit(F.col("confidence")).alias("prior"), logit(F.col("confidence")).alias("x")))
    for _ in range(rounds):
        sent = e.join(state, e["src"] == state["node"]).groupBy("dst").agg(F.sum(F.col("pull") * F.col("x")).alias("got"))
        moved = F.col("x") + rate * F.coalesce("got", F.lit(0.0))
        x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), 0.9 * moved + 0.1 * F.col("prior")))
        new = cut_lineage(state.join(sent, state["node"] == sent["dst"], "left").select("node", "prior", F.col("x").alias("was"), x.alias("x")))
        step = new.agg(F.max(F.abs(sigmoid(F.col("x")) - sigmoid(F.col("was"))))).first()[0]
        state = new.select("node", "prior", "x")
        if step is None or step <= tolerance:
            break
    return state.select("node", sigmoid(F.col("x")).alias("confidence"))


def two_hops(edges: DataFrame) -> DataFrame:
    """Distinct paths (a, via, c) of two edges with three different nodes."""
    x, y = edges.select(F.col("src").alias("a"), F.col("dst").alias("via")), edges.select(F.col("src").alias("via"), F.col("dst").alias("c"))
    return x.join(y, "via").filter("a <> c and a <> via and via <> c").select("a", "via", "c").distinct()


def short_cycles(edges: DataFrame) -> DataFrame:
    """Cycles of one to three edges, each once, from its smallest node; `simple_cycles` finds those of any length."""
    e = edges.select("src", "dst").distinct()
    one = e.filter("src = dst").select(F.array("src").alias("cycle"))
    x, y, z = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("c", "d")
    two = x.join(y, "b").filter("c = a and a < b").select(F.array("a", "b").alias("cycle"))
    three = x.join(y, "b").filter("a < b and a < c and b <> c").join(z, "c").filter("d = a").select(F.array("a", "b", "c").alias("cycle"))
    return one.union(two).union(three)


def _lowest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, low): the smallest node from which edges taken from `a` to `b` lead to the node, itself included. Labels take
    their neighbours' and jump along themselves: what leads to a node's label leads to the node."""
    label = cut_lineage(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("low", F.col("node")))
    while True:
        ahead = edges.join(label, edges[a] == label["node"]).groupBy(F.col(b).alias("_to")).agg(F.min("low").alias("_low"))
        new = label.join(ahead, label["node"] == ahead["_to"], "left").select("node", F.least("low", "_low").alias("near"), F.col("low").alias("was"))
        up = label.select(F.col("node").alias("_n"), F.col("low").alias("_up"))
        new = cut_lineage(new.join(up, new["near"] == up["_n"], "left").select("node", F.least("near", "_up").alias("low"), "was"))
        label = new.select("node", "low")
        if new.filter("low < was").isEmpty():
            return label


def _trimmed(live: DataFrame) -> DataFrame:
    """The edges left after nodes that nothing leads to, or that lead nowhere, are taken off again and again: they lie on
    no cycle."""
    n = live.count()
    while n:
        live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        live = cut_lineage(live.select("src", "dst"))
        was, n = n, live.count()
        if n == was:
            break
    return live


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in strongly connected components of two nodes or more, named after the smallest.

    A node whose smallest ancestor is its smallest descendant, too, is in that node's component. Each round settles the
    components of such smallest nodes and goes on with the edges that stay among nodes with equal labels."""
    live = _trimmed(cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct()))
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).filter("false")
    while not live.isEmpty():
        both = cut_lineage(_lowest(live, "src", "dst").join(_lowest(live, "dst", "src").withColumnRenamed("low", "high"), "node"))
        found = found.unionByName(both.filter("low = high").select("node", F.col("low").alias("component")))
        rest = both.filter("low <> high").withColumn("k", F.struct("low", "high"))
        s, t = rest.select(F.col("node").alias("src"), F.col("k").alias("_x")), rest.select(F.col("node").alias("dst"), F.col("k").alias("_y"))
        live = _trimmed(cut_lineage(live.join(s, "src").join(t, "dst").filter("_x = _y").select("src", "dst")))
    return found


def within_components(edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) inside strongly connected components, loops aside."""
    place = cut_lineage(strong_components(edges))
    s, t = place.toDF("src", "_x"), place.toDF("dst", "_y")
    return cut_lineage(edges.select("src", "dst").filter("src <> dst").distinct().join(s, "src").join(t, "dst").filter("_x = _y").select("src", "dst"))


def simple_cycles(edges: DataFrame) -> DataFrame:
    """Simple cycles of any length, each once, from its smallest node. Paths inside strongly connected components grow
    from their smallest node by an edge a round; the rounds end with the longest path, as many as a graph's paths are."""
    found = edges.select("src", "dst").distinct().filter("src = dst").select(F.array("src").alias("cycle"))
    live = within_components(edges)
    paths = cut_lineage(live.filter("src < dst").select(F.array("src", "dst").alias("path")))
    while not paths.isEmpty():
        ahead = paths.join(live, F.element_at("path", -1) == live["src"])
        found = found.union(cut_lineage(ahead.filter(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"))))
        on = ahead.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst")))
        paths = cut_lineage(on.select(F.array_append("path", F.col("dst")).alias("path")))
    return found


def contradictions(atoms: DataFrame, group: str, atom: str, positive: str) -> DataFrame:
    """Groups that state an atom with both signs: they can't be satisfied."""
    return atoms.groupBy(group, atom).agg(F.min(positive).alias("_lo"), F.max(positive).alias("_hi")).filter("_lo <> _hi").select(group, atom)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of all nodes, each named after its smallest node."""
    every = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct()
    return every.join(strong_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def bottom_up(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level, recursive): the order in which components can be worked on so that what a component points
    to comes before it. Level 0 points to no other component; each further level to one that is a level lower at least, so
    a level is the longest way down. A component is recursive if an edge stays inside it.

    Each round takes the components off whose last open edge went to the level before; rounds are the height of the
    condensed graph, and a round's join reads only edges into that level."""
    place = cut_lineage(components(nodes, edges))
    to, of = place.toDF("dst", "_to"), place.toDF("src", "_of")
    condensed = edges.select("src", "dst").distinct().join(of, "src").join(to, "dst").select("_of", "_to", "src", "dst")
    condensed = cut_lineage(condensed)
    recursive = condensed.filter("_of = _to").select(F.col("_of").alias("component")).distinct().withColumn("recursive", F.lit(True))
    down = cut_lineage(condensed.filter("_of <> _to").select("_of", "_to").distinct())
    opened = cut_lineage(down.groupBy("_of").agg(F.count(F.lit(1)).alias("open")))
    every = place.select("component").distinct()
    front = cut_lineage(every.join(opened, F.col("component") == F.col("_of"), "left_anti").withColumn("level", F.lit(0)))
    done, level = front, 0
    while True:
        level += 1
        closed = down.join(front, F.col("_to") == F.col("component")).groupBy("_of").agg(F.count(F.lit(1)).alias("closed"))
        opened = cut_lineage(opened.join(closed, "_of", "left").select("_of", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        front = cut_lineage(opened.filter("open = 0").select(F.col("_of").alias("component"), F.lit(level).alias("level")))
        if front.isEmpty():
            break
        opened = opened.filter("open > 0")
        done = done.unionByName(front)
    return place.join(done, "component").join(recursive, "component", "left").select("node", "component", "level", F.coalesce("recursive", F.lit(False)).alias("recursive"))


def dominators_fail(edges: DataFrame, entries: DataFrame, gates: DataFrame, targets: DataFrame) -> DataFrame:
    """The pairs (unit, gate, target) for which a way leads from the unit's entry to the target past the gate: the gate does
    not dominate it.

    edges (unit, src, dst), entries (unit, node), gates (unit, gate, src, dst): the edge that a gate lets through, and
    targets (unit, gate, target). For each gate, what the entry reaches without that edge spreads by an edge a round."""
    edges = edges.select("unit", "src", "dst")
    big = big_units(edges, entries)
    small = lambda df: df.join(big, "unit", "left_anti")
    held = lambda df, c, name: df.groupBy("unit", "gate").agg(F.collect_set(c).alias(name))
    asks = held(small(targets).filter("gate is not null"), "target", "wanted").join(held(gates, F.struct("src", "dst"), "cut"), ["unit", "gate"], "left")
    asks = asks.join(small(entries).groupBy("unit").agg(F.collect_set("node").alias("first")), "unit")
    found = reached_in_units(small(edges), asks, ["unit", "gate"]).select("unit", "gate", F.col("node").cast(targets.schema["target"].dataType).alias("target"))
    if big.isEmpty():
        return found
    return found.unionByName(_dominators_fail(*[df.join(big, "unit", "left_semi") for df in (edges, entries, gates, targets)]))


def _dominators_fail(edges: DataFrame, entries: DataFrame, gates: DataFrame, targets: DataFrame) -> DataFrame:
    """The same in units of any size, by rounds over tables."""
    cut = gates.select("unit", "gate", F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    asked = cut_lineage(targets.select("unit", "gate").distinct())
    seen = Growing(asked.join(entries, "unit").select("unit", "gate", "node").distinct())
    front = seen.rows()
    while not front.isEmpty():
        ahead = front.join(edges.withColumnRenamed("src", "node"), ["unit", "node"])
        barred = (ahead["unit"] == cut["unit"]) & (ahead["gate"] == cut["gate"]) & (ahead["node"] == cut["_s"]) & (ahead["dst"] == cut["_d"])
        ahead = ahead.join(cut, barred, "left_anti").select("unit", "gate", F.col("dst").alias("node")).distinct()
        front = seen.add(ahead.join(seen.rows(), ["unit", "gate", "node"], "left_anti"))
    return targets.join(seen.rows().withColumnRenamed("node", "target"), ["unit", "gate", "target"], "left_semi").select("unit", "gate", "target").distinct()


def big_units(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(unit) of those with more edges than SMALL_EDGES or more entries than SMALL_ENTRIES."""
    many = edges.distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL_EDGES).select("unit")
    if entries is not None:
        many = many.union(entries.distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL_ENTRIES).select("unit")).distinct()
    return cut_lineage(many)


def reached_in_units(edges: DataFrame, asks: DataFrame, keys: list[str], beyond: bool = False) -> DataFrame:
    """(*keys, node): for each row of `asks` the nodes of `wanted` that its unit's edges lead to.

    edges (unit, src, dst) of small units, asks (unit, *keys, first, wanted; stops, cut): a way begins at the nodes of `first`
    (with `beyond`: behind them), goes on from no node of `stops` and takes no edge (src, dst) of `cut`. A unit's edges meet
    its rows, so that all steps are taken in one task, over the rows of a batch at once, with nodes as bits of a number."""
    kept = edges.filter("src is not null and dst is not null").groupBy("unit").agg(F.collect_set(F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))).alias("edges"))
    lists = {"edges": "array<struct<src:long,dst:long>>", "cut": "array<struct<src:long,dst:long>>", "first": "array<long>", "stops": "array<long>", "wanted": "array<long>"}
    have = {*asks.columns, "edges"}
    rows = asks.join(kept, "unit", "left").select(*keys, *[(F.coalesce(F.col(c).cast(t), F.array().cast(t)) if c in have else F.array().cast(t)).alias(c) for c, t in lists.items()])

    def batches(found):
        for batch in found:
            yield _reached(batch, keys, beyond)

    return rows.mapInArrow(batches, StructType([*rows.select(*keys).schema.fields, StructField("node", LongType())]))


def _reached(batch: pa.RecordBatch, keys: list[str], beyond: bool) -> pa.RecordBatch:
    n = batch.num_rows

    def flat(name):
        """The rows and values of a list column."""
        c = batch.column(name)
        values, row = c.flatten(), np.repeat(np.arange(n), np.diff(c.offsets.to_numpy()))
        if pa.types.is_struct(values.type):
            return row, values.field("src").to_numpy(zero_copy_only=False), values.field("dst").to_numpy(zero_copy_only=False)
        return row, values.to_numpy(zero_copy_only=False)

    (er, src, dst), (fr, first), (cr, csrc, cdst) = flat("edges"), flat("first"), flat("cut")
    # Nodes of a row are numbered in order; what isn't a node of an edge or a first one is nowhere.
    row, node = np.concatenate([er, er, fr]), np.concatenate([src, dst, first])
    names = np.unique(node)
    every = np.unique(row * len(names) + np.searchsorted(names, node))
    begin = np.searchsorted(every, np.arange(n + 1) * len(names))

    def found(sorted_values, values):
        at = np.searchsorted(sorted_values, values)
        return at, np.isin(values, sorted_values) if len(sorted_values) else np.zeros(len(values), bool)

    def place(row, node):
        name, known = found(names, node)
        at, also = found(every, np.where(known, row * len(names) + name, -1))
        return at - begin[row], known & also

    def mask(name):
        out, (row, node) = np.zeros(n, np.uint64), flat(name)
        at, known = place(row, node)
        np.bitwise_or.at(out, row[known], np.uint64(1) << at[known].astype(np.uint64))
        return out

    width = int(np.diff(begin).max(initial=0))
    ahead = np.zeros((n, width), np.uint64)
    bit = lambda at: np.uint64(1) << at.astype(np.uint64)
    np.bitwise_or.at(ahead, (er, place(er, src)[0]), bit(place(er, dst)[0]))
    (cs, known), (cd, also) = place(cr, csrc), place(cr, cdst)
    known &= also
    np.bitwise_and.at(ahead, (cr[known], cs[known]), ~bit(cd[known]))
    one, none, goes = np.uint64(1), np.uint64(0), ~mask("stops")
    step = lambda at, i: np.where((at >> np.uint64(i)) & one, ahead[:, i], none)
    got = begun = mask("first")
    if beyond:
        got = np.zeros(n, np.uint64)
        for i in range(width):
            got = got | step(begun, i)
    while True:
        before = got
        for i in range(width):
            got = got | step(got & goes, i)
        if (got == before).all():
            break
    got = got & mask("wanted")
    rows, places = np.nonzero((got[:, None] >> np.arange(width, dtype=np.uint64)) & one)
    kept = [batch.column(k).take(pa.array(rows)) for k in keys]
    return pa.RecordBatch.from_arrays([*kept, pa.array(names[every[begin[rows] + places] % max(len(names), 1)], pa.int64())], [*keys, "node"])
