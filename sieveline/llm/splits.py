"""Splits that keep related records together: a persisted spanning forest, dealt by size bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group_key
from ..sources.shared import save
from .components import spanning_forest

#: A component of this part of all records is placed on the driver; there are at most so many.
GIANT = 200


def relation_forest(records: DataFrame, keys: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(members, forest): the component of every record and key value, and the chosen edges.

    ``records`` has id; ``keys`` names the relations (author, source, entity) and gives their key, null for none.
    A record is tied to each of its key values; nodes are 'r:' + id and name + ':' + value.  A hot key is one node
    with many edges, of which minima are pre-aggregated; it is never gathered.  Rows delivered twice count once.
    members: (root, kind, value), kind 'r' for records; a record without any key is its own component.
    """
    rows = records.filter(F.col("id").isNotNull())
    ties = [rows.select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("a"), F.concat(F.lit(f"{name}:"), key).alias("b")).filter(F.col("b").isNotNull()) for name, key in keys.items()]
    edges = ties[0]
    for t in ties[1:]:
        edges = edges.unionByName(t)
    labels, forest = spanning_forest(edges)
    nodes = rows.select(F.concat(F.lit("r:"), F.col("id").cast("string")).alias("node")).distinct()
    alone = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = labels.select("node", "root").unionByName(alone)
    cut = F.expr("instr(node, ':')")
    return save(every.select("root", F.expr("substring(node, 1, instr(node, ':') - 1)").alias("kind"), F.col("node").substr(cut + 1, F.length("node")).alias("value")), "members"), forest


def deal(components: DataFrame, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """(root, size, split): every component in one split, the splits near their shares of all records.

    Components of at least 1 / GIANT of all records (at most GIANT of them) go, largest first, to the split that lacks
    most.  The others are stratified by size band (binary magnitude) and, in hash order within the band, dealt
    systematically to what the splits still lack: the middle of a component's place in the running size of its band
    picks the split whose interval of the period holds it.  Running sums go by hash bucket first, so that no band is
    one task.
    """
    total = components.agg(F.sum("size")).first()[0] or 0
    lack = {k: v / sum(shares.values()) * total for k, v in shares.items()}
    giants = []
    for r in components.filter(F.col("size") * GIANT >= total).orderBy(F.desc("size"), "root").collect():
        k = max(lack, key=lambda k: lack[k])
        lack[k] -= r.size
        giants.append((r.root, r.size, k))
    shares = {k: max(v, 1e-9) for k, v in lack.items()}
    components = components.filter(F.col("size") * GIANT < total)
    h = components.withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("_h", F.xxhash64("root", F.lit(seed)))
    h = h.withColumn("_b", F.shiftrightunsigned("_h", 54).cast("int"))
    sums = h.groupBy("band", "_b").agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_c"))  # at most 64 x 1024 rows
    before = Window.partitionBy("band").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("band", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("band", "_b").orderBy("_h", "root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = h.join(F.broadcast(sums), ["band", "_b"]).withColumn("_mid", F.col("_start") + F.sum("size").over(inner) - F.col("size") / 2)
    # A period of about 16 components of the band is cut in the shares; the golden ratio spreads the start of bands.
    period = F.pow(F.lit(2.0), F.col("band")) * 16
    place = (F.col("_mid") / period + F.col("band") * 0.6180339887) % 1.0
    whole, upto, split = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        upto += share / whole
        split = F.when(place < upto, name) if split is None else split.when(place < upto, name)
    dealt = at.select("root", "size", split.otherwise(list(shares)[-1]).alias("split"))
    return dealt.unionByName(components.sparkSession.createDataFrame(giants, dealt.schema)) if giants else dealt


def assign_splits(records: DataFrame, shares: dict[str, float], keys: dict[str, Column]) -> DataFrame:
    """(id, root, size, split) of every different record id; records that share a key value share the split."""
    members, _ = relation_forest(records, keys)
    own = members.filter("kind = 'r'")
    dealt = deal(own.groupBy("root").agg(F.count(F.lit(1)).alias("size")), shares)
    return own.select(F.col("value").alias("id"), "root").join(dealt, "root").select("id", "root", "size", "split")


def divided(records: DataFrame, name: str, key: Column) -> DataFrame:
    """(group_key, roles, records) of the groups whose records carry more than one role at present; null roles don't count."""
    members, _ = relation_forest(records, {name: key})
    role = records.select(F.col("id").cast("string").alias("value"), "role").filter("role is not null").distinct()
    roles = members.filter("kind = 'r'").join(role, "value").groupBy("root").agg(F.countDistinct("role").alias("roles"), F.countDistinct("value").alias("records")).filter("roles > 1")
    return members.filter(F.col("kind") == name).join(roles, "root").select(F.col("value").alias("group_key"), "roles", "records")


def normal_group(raw: Column) -> Column:
    """group_key of the test tables."""
    return group_key(raw)
