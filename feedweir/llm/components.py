"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.llm.common import materialize

#: So many tasks share the neighbourhood of one node.
SALTS = 32


def _star(pairs: DataFrame, lower_only: bool) -> DataFrame:
    """Around each node u with least neighbour m (u itself counts): join the neighbours above u (large star),
    or those below u and u itself (small star), to m.

    A neighbourhood is dealt over SALTS tasks by its other ends: each has a minimum of its own, the minimum of these, SALTS
    rows a node at most, goes back to them."""
    if lower_only:
        around = pairs.where("v < u")
    else:
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = around.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = around.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select("u", F.least("u", "m").alias("m"), F.explode("salts").alias("salt"))
    back = around.join(least, ["u", "salt"])
    if lower_only:
        made = back.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m").distinct())
    else:
        made = back.where("v > u").select(F.col("v").alias("a"), "m")
    return made.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame) -> DataFrame:
    """Rows node, component for every node of the links (u, v); the component is its least node.

    Loops and repeated links change nothing, links with a null end are ignored, no links give no rows.
    Every round ends in a written table, so a lost executor costs one round at most. The links are read twice. The rounds
    grow with the logarithm of the longest chain.
    """
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        pairs = materialize(_star(_star(pairs, False), True).distinct(), "links")
        if pairs.select(F.col("v").alias("u")).join(pairs, "u", "left_semi").isEmpty():  # no centre is a leaf: stars alone
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
