"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and is not a root; root is the smallest node that it reaches.

    edges: (a, b) of any orderable type, any direction, repeats and loops allowed. Each step is two equi-joins on small keys; nothing goes to the
    driver but a count and a checksum. A star's hub may have any number of edges: it is only ever the key of a sum or of
    the larger side of a join.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = state
