"""Connected components by parallel hooking and shortcutting over a parent table.

``parent(v, p)`` is a forest.  In each round every vertex hears the smallest grandparent among
its neighbours; the vertex and its parent hook onto it, and every vertex shortcuts to its
grandparent.  The number of rounds grows with the logarithm of the longest chain.  Rounds are
joined tables, written to the shared folder; nothing but a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.session import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; ``root`` is the smallest node it reaches.

    NULL ends and self-loops are ignored (a node with nothing but self-loops has no row);
    repeated edges count once; an empty table gives none.
    """
    plain = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = cut(plain.select("a", "b").unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parent = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).withColumnRenamed("a", "v"))
    for _ in range(most_rounds):
        grand = parent.select(F.col("v").alias("gv"), F.col("p").alias("g"))
        up = cut(parent.join(grand, F.col("p") == F.col("gv")).select("v", "p", "g"))
        heard = both.join(up.select(F.col("v").alias("b"), F.col("g").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        news = up.join(heard.withColumnRenamed("a", "v"), "v")
        offers = news.select("v", F.least("g", "m").alias("o")).unionByName(news.select(F.col("p").alias("v"), F.least("g", "m").alias("o")))
        lowest = offers.groupBy("v").agg(F.min("o").alias("o"))
        step = cut(up.join(lowest, "v").select("v", F.least("p", "o").alias("q"), (F.least("p", "o") != F.col("p")).alias("moved")))
        parent = step.select("v", F.col("q").alias("p"))
        if not step.where("moved").limit(1).count():
            return parent.select(F.col("v").alias("node"), F.col("p").alias("root"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
