"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.session import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's least node.

    Alternates two star steps. Large star: every node points its larger neighbours at
    its least neighbour; small star: it points itself and its smaller neighbours at the
    least of them. Links never outgrow their first number by more than the nodes, and
    the steps settle in a number of rounds that is logarithmic for practical graphs.
    A node with very many neighbours is one row on the joins' other side, so its rows
    may be split over tasks. Each round is stored, and the round before deleted.
    """
    now = stored(links.where("a <> b")
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "links")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").union(least.select("a", "m")).distinct())
        after = stored(small, "links")
        discard(now)
        discard(large)
        now = after
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())
