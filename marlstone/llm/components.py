"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a shuffle of the edges, written to the shared folder to cut the lineage; nothing but
two counts per step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Staged, small

MAX_ROUNDS = 60
#: A node of more edges is a hub; of E edges at most 2 E / HUB nodes are.
HUB = 1000


def _grouped(staged: Staged, edges: DataFrame) -> DataFrame:
    """(u, v, least): each neighbour v of u with the least of u and its neighbours."""
    # the least is pre-aggregated on the map side; hubs are few, so what is joined to their edges is broadcast (if
    # it is small), and no task gets all edges of one
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("n"))
    least = staged.keep(least, "least")
    hubs = least.where(F.col("n") > HUB).select("u", F.col("least").alias("of_hub"))
    if hubs.isEmpty() or not small(hubs):
        return edges.join(least.drop("n"), "u")
    tagged = edges.join(F.broadcast(hubs), "u", "left")
    rest = tagged.where("of_hub IS NULL").select("u", "v").join(least.where(F.col("n") <= HUB).drop("n"), "u")
    return rest.unionByName(tagged.where("of_hub IS NOT NULL").select("u", "v", F.col("of_hub").alias("least")))


def components(staged: Staged, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), root being the least node reachable.

    Self-edges and repeated edges are allowed; an edge with a null end is ignored; no edges give no rows.
    """
    now = staged.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stats) == seen or stats[0] == 0:
            break
        seen = tuple(stats)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _grouped(staged, both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        large = staged.keep(large.distinct(), "large")
        part = _grouped(staged, large)
        after = (
            part.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(part.select("u", F.col("least").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = staged.keep(after, "small")
        staged.drop(large, now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
