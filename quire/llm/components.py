"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace


def components(ws: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the component is its smallest node.

    Alternates large-star and small-star steps. Each is a minimum by key (combined before the shuffle) joined back to
    the links, so that a node with a third of all links is a skewed join, which adaptive execution splits."""
    links = ws.save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v"), F.col("u")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select("v", "m").union(small.select(F.col("u"), F.col("m"))).toDF("u", "v").where("u <> v").distinct()
        new = ws.save(small)
        ws.drop(links)
        links = new
        # settled when every link goes from a node with one link to a node that has none of its own
        size = links.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if size.n == size.d and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    tops = links.select(F.col("v").alias("node")).distinct()
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))
    out._quire_path = links._quire_path
    return out
