"""Connected components of an edge table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matfold.llm.common import filed, saved


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, comp) for every node that has an edge, written; comp is the smallest node reachable.

    Alternates "every larger neighbour links to the smallest neighbour" and
    "every node links its smaller neighbours to the smallest" until the edges
    are stars, a number of rounds logarithmic in practice.  Each round is one
    aggregation and one join per half on the remaining edges and is written once
    to the shared folder, in files by the number of edges (``rows``: about how
    many there are at first, if known).  A node of very many edges is aggregated
    partially before the shuffle, and its join partition can be split.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.groupBy().agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())

    new = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo != hi").distinct()
    new = saved(new if rows is None else filed(new, rows))
    before, after = None, mark(new)
    while before != after:
        both = new.select(F.col("lo").alias("x"), F.col("hi").alias("y")).union(new.select(F.col("hi").alias("x"), F.col("lo").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("m", F.explode(F.array("lo", "hi")).alias("other"))
        small = small.where("other != m").select(F.col("m").alias("lo"), F.col("other").alias("hi")).distinct()
        new = saved(filed(small, after[0]))
        before, after = after, mark(new)
    found = new.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(new.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
    return saved(filed(found, after[0]))
