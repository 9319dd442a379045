"""Borůvka-style contraction: minimum edges out of every component, pointer jumping, persisted rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save


def _jump(parent: DataFrame) -> DataFrame:
    """Roots of a pointer forest (node, up): doubling until nothing moves; at most log2(depth) written rounds."""
    at = save(parent, "pointers")
    while True:
        up = at.select(F.col("node").alias("up"), F.col("up").alias("top"))
        nxt = save(at.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("new"), F.col("up").alias("old")), "pointers")
        if nxt.filter(F.col("new") != F.col("old")).isEmpty():
            return nxt.select("node", F.col("new").alias("root"))
        at = nxt.select("node", F.col("new").alias("up"))


def spanning_forest(edges: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of an undirected graph with edges (a, b[, weight]).

    Every round each component takes its least edge by (weight, ends), so the chosen edges have no cycle but
    the two-cycle of a pair that chose the same edge; components merge by pointer jumping and the edges between
    them are written to the shared folder.  Rounds are at most log2 of the nodes.
    labels: (node, root), root one node of the component, the same in every run; forest: (a, b) the chosen edges.
    Loops and null ends are left out; an empty graph has empty results.
    """
    clean = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    w = F.col(weight).cast("double") if weight else F.lit(0.0)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    live = save(clean.select(*pair, w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"), "edges")
    labels = save(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    chosen = live.select("a", "b").limit(0)
    while not live.isEmpty():
        both = live.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "w", "a", "b").unionByName(live.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "w", "a", "b"))
        best = save(both.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("c", "e.to", "e.a", "e.b"), "chosen")
        chosen = chosen.unionByName(best.select("a", "b"))
        # Of two components that chose each other the lesser is the root.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = best.join(back, "to", "left").select(F.col("c").alias("node"), F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        roots = _jump(up)
        labels = save(labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        ra, rb = roots.select(F.col("node").alias("ca"), F.col("root").alias("na")), roots.select(F.col("node").alias("cb"), F.col("root").alias("nb"))
        moved = live.join(ra, "ca").join(rb, "cb").filter(F.col("na") != F.col("nb"))
        live = save(moved.select(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb"), "w", "a", "b"), "edges")
    return labels, chosen.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (a, b)."""
    return spanning_forest(edges)[0]
