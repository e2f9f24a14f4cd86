"""Connected components of a link table by alternating star contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every id in ``links`` (columns ``a``, ``b``).

    Each round hangs the larger neighbours of every node below its smallest neighbour, then the smaller ones
    (large-star, small-star), until nothing moves: a logarithmic number of rounds. A node's neighbours are only
    ever aggregated (minimum), so a hub with a third of all links needs no task of its own. Self links keep their
    node; null ends are ignored; repeated links change nothing.
    """
    both = links.where("a is not null and b is not null").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    nodes = both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct()
    edges = materialize(both.where("a <> b").distinct())
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        mirrored = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = mirrored.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            mirrored.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = materialize(large.where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialize(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if now == sums:
            break
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
