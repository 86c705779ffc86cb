"""Connected components of a link table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepspark.session import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b), two columns of one type; root is the smallest node reachable.

    Alternates large-star and small-star: every node hands its larger, then its smaller neighbours to the smallest it knows,
    until nothing changes. Each round shuffles the links twice with map-side minima; no component meets in one task, and
    the number of rounds grows with the logarithm of the longest chain. Every round ends in a written table. Null ends and
    loops are ignored; an empty table gives none.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    before = None
    for _ in range(max_rounds):
        links = materialize(_small_star(materialize(_large_star(links), "star")), "links")
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node point to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, point to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return kept.where("a <> b").distinct()
